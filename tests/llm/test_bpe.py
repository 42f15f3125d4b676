import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from ledgerwind.llm import bpe_transducer as bt

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bt.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(1)
    letters = ["the", "ing", "er", " ", "  ", "\n", "\t", "a", "Z", "é", "ß", "日本", "😀", "'s", "'", "0", "12", "!!", "\x1c", "\x85", "\xa0", "̸", "\ufeff", "ab", "-", "="]
    yield from ["", " ", "hello world", "a" * 5000, " " * 700, "ab" * 2000, "=" * 3000, "<|endoftext|>", "日本語" * 900, "\x00\x01"]
    for _ in range(500):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))


def test_ids_are_those_of_the_library(library, monkeypatch):
    monkeypatch.setattr(bt, "STATES", 3000)
    monkeypatch.setattr(bt, "PAIRS", 3000)
    monkeypatch.setattr(bt, "CHECK_EVERY", 64)
    enc = bt.Encoder(PATH, public_tokenizers.PATTERN)
    for text in texts():
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode_ordinary(text), text[:50]


def test_tokens_come_after_bounded_lookahead(library, monkeypatch):
    monkeypatch.setattr(bt, "CHECK_EVERY", 64)
    machine, read = bt.encoder(PATH, public_tokenizers.PATTERN).transducer, 0

    class Bytes(bytes):
        def __iter__(self):
            nonlocal read
            for b in bytes(self):
                read += 1
                yield b

    emitted = 0
    for token in machine.encode(Bytes(b"therwhich" * 400)):
        emitted += machine.lengths[token]
        assert read - emitted <= 64 + 2 * 128 or read == 3600
    assert emitted == 3600


def test_streaming_decode_waits_for_whole_characters():
    words = [b"\xe2\x82", b"\xac!", b"\xff", b"a", b"\xf0\x9f"]
    assert list(bt.decode_stream(words, map(np.array, ([0], [1], [2, 3], [4])))) == ["", "€!", "\ufffda", "", "\ufffd"]


def test_spark_results(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([None, *list(texts())[:40]])] + [(3, "hello world", "x"), (None, "no id", "x")]
    got = bt.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert bt.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0
