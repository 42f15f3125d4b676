import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwind.llm import packing, records
from ledgerwind.llm.shared import shared_path
from ledgerwind.llm.word_tokens import WordEncoder, default_path

TEXTS = [None, "", " ", "Hello, world! it's 2024", "naïve é Ünï   x y\x1cz\x85w", "<|endoftext|> and<|startoftext|>", "ΑΣ ΣΑΣ İstanbul", "日本語テキスト 한국어", "a" * 3000, "tick 'S don'T " * 400, "x̸ ̸y"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_chunkwise_ids_are_those_of_the_whole_text(library):
    rng, enc = random.Random(1), WordEncoder(default_path())
    letters = "abAB É́é's09.,!<|>\t\n Σß😀한̸"
    for text in [*TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400))]:
        assert np.frombuffer(enc.encode((text or "").encode()), enc.dtype).tolist() == ids(library, text)


def frame_of(spark, texts=TEXTS):
    rows = [(7 * i % 11, t, f"s{i % 3}" if i % 4 else None, "x") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, start string")


def test_records_round_trip(spark, library):
    rows, docs = frame_of(spark)
    rows += [(None, "no id", "s", "x"), (3, "again", "s", "x")]
    docs = spark.createDataFrame(rows, docs.schema)
    folder = shared_path(spark, "records-test")
    records.write_records(docs, folder, default_path(), end=1, shards=3)
    got = records.digests(spark, folder).collect()
    start, want = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        x = np.array([*ids(library, text), 1], "<u4")
        want.append((doc, len(x), crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert at == start
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    one, two = (records.read_shuffled(spark, folder, s).select("doc_id", "ids").collect() for s in (1, 2))
    assert sorted(one, key=str) == sorted(two, key=str) and one != two


def test_damaged_records_are_found():
    data = bytearray(records.frame(5, b"\1\0\2\0", False))
    assert records.ids_of(records.unframe(memoryview(bytes(data)), 0)[0])[0] == 5
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)), 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    folder = shared_path(spark, "records-test")
    records.write_records(empty, folder, default_path(), end=1)
    assert records.digests(spark, folder).count() == 0
    assert packing.pack(empty, default_path(), 2).count() == 0


def check_packing(pieces, rows, library, size):
    docs = {}
    for doc, text, *_ in rows:
        docs.setdefault(doc, []).append([*ids(library, text), 2])
    sequences = {}
    for p in pieces:
        assert 0 < p.length and len(p.ids) == p.length and crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append(p)
    for number, parts in sequences.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    for doc, wanted in docs.items():
        own = [p for p in pieces if p.doc_id == doc]
        assert sum(p.length for p in own) == sum(map(len, wanted))
        if len(wanted) == 1:
            own.sort(key=lambda p: p.start)
            assert [i for p in own for i in p.ids] == wanted[0]
            assert all(p.doc_tokens == len(wanted[0]) for p in own)


@pytest.mark.parametrize(("size", "targets"), [(16, None), (64, None), (64, {"s0": 0.7, "s1": 0.2}), (4096, None)])
def test_every_id_is_packed_once(spark, library, size, targets):
    rows, docs = frame_of(spark, TEXTS + ["token soup " * n for n in (1, 50, 300)])
    rows += [(None, "no id here", "s2", "x"), (1, "a second row", "tiny", "x")]
    pieces = packing.pack(spark.createDataFrame(rows, docs.schema).repartition(3), default_path(), 2, size, targets).collect()
    check_packing(pieces, rows, library, size)


def test_windows_keep_the_mixture(spark):
    rows = [(i, "word " * (20 + i % 60), ("a", "a", "a", "b", "b", "c")[i % 6]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = packing.pack(docs, default_path(), 2, 128).join(docs.select("doc_id", "source"), "doc_id")
    total = {r[0]: r[1] for r in pieces.groupBy("source").agg(F.sum("length")).collect()}
    given = {}
    for r in sorted(pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()):
        given[r.source] = given.get(r.source, 0) + r.n
        if r.sequence_id < max(total.values()) // 128:
            assert abs(given[r.source] - total[r.source] / sum(total.values()) * 128 * (r.sequence_id + 1)) < 1


def test_deficit_round_robin_loop_gives_the_same_counts():
    tokens = [1000, 313, 77, 41]
    mix = packing.mixture(tokens, [Fraction(t, sum(tokens)) for t in tokens], 64)
    for w in range(mix.windows):
        assert sum(mix.given(q, w + 1) - mix.given(q, w) for q in range(4)) == min(64, sum(tokens) - 64 * w)
        for q in range(4):
            assert abs(mix.given(q, w) - Fraction(tokens[q] * 64 * w, sum(tokens))) < 1
            assert mix.given(q, w + 1) >= mix.given(q, w)
    assert [mix.given(q, mix.windows) for q in range(4)] == tokens


def test_thousands_of_small_sources_are_mixed(spark):
    """Of 3000 sources of 8 equal documents and 1000 of a single one, each has given its share by each quarter of the windows."""
    rows = [(s * 8 + i, f"s{s}", "word") for s in range(3000) for i in range(8)] + [(10**6 + s, f"t{s}", "word") for s in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    pieces = packing.pack(docs, default_path(), 2, 128).select("doc_id", "sequence_id", "start", "length", "doc_tokens").collect()
    assert sum(p.length for p in pieces) == 2 * len(rows)
    last, source = max(p.sequence_id for p in pieces), {r[0]: r[1] for r in rows}
    for quarter in (1, 2, 3):
        given = dict.fromkeys(source.values(), 0)
        for p in pieces:
            if 4 * p.sequence_id < quarter * last and p.start + p.length == p.doc_tokens:
                given[source[p.doc_id]] += 1
        assert all(abs(n - 2 * quarter) <= 1 for s, n in given.items() if s[0] == "s")
        assert abs(sum(n for s, n in given.items() if s[0] == "t") - 250 * quarter) < 80


def test_small_sources_beside_large_ones_are_spread(spark):
    rows = [(i, "large", "word " * 200) for i in range(60)] + [(1000 + i, f"small{i % 4}", "word") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    pieces = packing.pack(docs, default_path(), 2, 128).collect()
    few, last = [p.sequence_id for p in pieces if p.doc_id >= 1000], max(p.sequence_id for p in pieces)
    assert min(few) < last / 5 and max(few) > last * 4 / 5
    assert all(sum(n in range(q * last // 4, (q + 1) * last // 4 + 1) for n in few) >= 5 for q in range(4))


def test_targets_hold_for_small_sources_and_rest_is_shared(spark):
    rows = [(i, "large", "word " * 200) for i in range(60)] + [(1000 + i, "rare", "word") for i in range(12)] + [(2000 + i, "late", "word " * 9) for i in range(9)] + [(3000 + i, "b", "word " * 100) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    pieces = packing.pack(docs, default_path(), 2, 128, {"rare": 0.01, "late": 0.0}).collect()
    assert sum(p.length for p in pieces) == 60 * 201 + 12 * 2 + 9 * 10 + 30 * 101
    first = [p.sequence_id for p in pieces if p.doc_id // 1000 == 1]
    assert max(first) <= 24 / 1.28 + 1  # 24 tokens at 1.28 a window
    assert min(p.sequence_id for p in pieces if p.doc_id // 1000 == 2) >= max(p.sequence_id for p in pieces if p.doc_id // 1000 != 2)
    share = sum(p.length for p in pieces if p.doc_id < 1000 and p.sequence_id < 40) / sum(p.length for p in pieces if p.doc_id // 1000 == 3 and p.sequence_id < 40)
    assert abs(share - 60 * 201 / (30 * 101)) < 0.2


def test_allotments_with_many_phases_never_shrink_and_keep_the_shares():
    rng = random.Random(8)
    for i in range(300):
        size = rng.choice([4, 16, 64])
        tokens = [rng.randrange(1, 900) for _ in range(rng.randrange(1, 7 if size > 4 else 3))]
        weights = [Fraction(rng.choice([0, 1, 2, 5, 9, rng.randrange(1, 200)]), rng.choice([1, 3, 7, 400])) for _ in tokens]
        try:
            mix = packing.mixture(tokens, weights, size)
        except ValueError:
            assert size == 4
            continue
        queues = range(len(tokens))
        assert [mix.given(q, mix.windows) for q in queues] == tokens, i
        for w in range(mix.windows):
            step = [mix.given(q, w + 1) - mix.given(q, w) for q in queues]
            assert min(step) >= 0 and sum(step) == min(size, sum(tokens) - size * w), (i, w)
        shared = [q for q in queues if weights[q]]
        if shared:  # until the first queue ends, each is near its share
            end = min(next(x for x in range(mix.windows + 1) if mix.given(q, x) == tokens[q]) for q in shared)
            assert all(abs(mix.given(q, x) - x * size * weights[q] / sum(weights)) < 1 + len(tokens) for q in queues for x in range(end)), i


def test_shards_are_read_by_offset(spark, library):
    rows, docs = frame_of(spark)
    folder = shared_path(spark, "records-test")
    records.write_records(docs, folder, default_path(), end=1, shards=4)
    index = records.read_index(spark, folder)
    wanted = index.filter("doc_id in (2, 7)").select("shard", "offset")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.read_at(spark, folder, wanted).collect()}
    assert got == {doc: [*ids(library, text), 1] for doc, text, *_ in rows if doc in (2, 7)}


def test_rows_of_one_doc_id_are_spread_over_shards(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i} " * 20) for i in range(3000)], "doc_id long, text string").repartition(6)
    folder = shared_path(spark, "records-test")
    records.write_records(docs, folder, default_path(), end=1, shards=8)
    sizes = [r[1] for r in records.read_index(spark, folder).groupBy("shard").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 3 * 3000 / 8
    got = records.read_index(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: -1 if d is None else d)
