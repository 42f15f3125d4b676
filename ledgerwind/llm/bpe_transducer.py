"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

For every prefix of an input, the BPE encoding has one last token, and a sequence of tokens is an encoding exactly if
each two neighbours are (their joint bytes encode to just the two). So the encoder is a nondeterministic transducer
whose states are pairs (last token before a boundary, trie node of the bytes since it); a token may end at a node if it
may follow that last token. Determinised on demand, its states are tuples of such pairs, one for each boundary that a
token longer than what was read may still start from, and each transition names the token that ends the prefix just
read. A boundary is certain once all open boundaries' paths go through it; tokens before it are emitted, after a
lookahead that is bounded by the longest token. States and transitions are made when first needed and kept up to a
bound.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.shared import text_bytes

#: States, neighbour checks and bytes of encoded pieces that a worker keeps at most.
STATES, PAIRS, CACHE_BYTES = 250_000, 400_000, 48_000_000
#: Bytes read between two searches for certain boundaries in a long piece, and ids decoded at a time.
CHECK_EVERY, DECODE_IDS = 1024, 8192
#: Rows of a result batch.
ROWS = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.lengths = dict(zip(ranks.values(), map(len, ranks), strict=True))
        self.bytes = dict(zip(ranks.values(), ranks, strict=True))
        self.arcs: dict[int, int] = {}  # trie: node << 8 | byte -> node
        self.token: list[int] = [-1]  # by node
        self.inner: list[bool] = [False]  # nodes that have arcs
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                self.inner[node] = True
                node = self.arcs.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(depth)
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}  # by both tokens
        self._forget()

    def _forget(self) -> None:
        self.tuples: list[tuple[int, ...]] = []  # of each state: last token + 1 << 20 | trie node
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[int, int] = {}  # state << 8 | byte -> token << 32 | state
        self.start = self._number((0,))

    def _number(self, state: tuple[int, ...]) -> int:
        if (n := self.numbers.get(state)) is None:
            n = self.numbers[state] = len(self.tuples)
            self.tuples.append(state)
        return n

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: join the pair of least rank, leftmost first, while there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            if (least := min(ranked)) == 1 << 60:
                break
            at = ranked.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        if (known := self.pairs.get(key := before + 1 << 20 | token)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            whole = [self.bytes[t] for t in (before, token) if t >= 0]
            known = self.pairs[key] = self.merged(b"".join(whole)) == whole
        return known

    def _step(self, number: int, byte: int) -> int:
        """The state after a byte, below the token that ends there."""
        state, last = [], -1
        for pair in self.tuples[number]:
            before, node = (pair >> 20) - 1, pair & 0xFFFFF
            if (to := self.arcs.get(node << 8 | byte)) is not None:
                if last < 0 and self.token[to] >= 0 and self.follows(before, self.token[to]):
                    last = self.token[to]
                if self.inner[to]:
                    state.append(pair - node + to)
        state.append(last + 1 << 20)
        if full := len(self.tuples) >= STATES:  # the caller's state number is void then, but it goes on with the new one
            self._forget()
        found = last << 32 | self._number(tuple(state))
        if not full:
            self.steps[number << 8 | byte] = found
        return found

    def encode(self, piece: bytes) -> Iterator[int]:
        """Tokens of one piece, each emitted when no later byte can change it."""
        if (whole := self.ranks.get(piece)) is not None:
            yield whole
            return
        state, steps, ends, sure = self.start, self.steps, [], 0  # ends: the last token at each place after the first `sure` bytes
        for at, byte in enumerate(piece, 1):
            if (step := steps.get(state << 8 | byte)) is None:
                step = self._step(state, byte)
                steps = self.steps
            state = step & 0xFFFFFFFF
            ends.append(step >> 32)
            if at % CHECK_EVERY == 0:
                # all open boundaries lie within the longest token; follow their paths back until they are one
                open_at = {at - self.depth[pair & 0xFFFFF] for pair in self.tuples[state]}
                while len(open_at) > 1:
                    far = max(open_at)
                    open_at = (open_at - {far}) | {far - self.lengths[ends[far - sure - 1]]}
                yield from self._back(ends, (to := open_at.pop()) - sure)
                ends, sure = ends[to - sure :], to
        yield from self._back(ends, len(ends))

    def _back(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= self.lengths[out[-1]]
        return out[::-1]


class Encoder:
    """Whole texts: each match of the pattern by the transducer, with two bounded generations of encoded matches."""

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer, self.split = Transducer(read_ranks(path)), regex.compile(pattern).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        pieces = self.split(text)
        if fresh := set(pieces).difference(self.new):
            if self.size > CACHE_BYTES:
                self.old, self.new, self.size = self.new, {}, 0
                fresh = set(pieces)
            for piece in fresh:
                if (ids := self.old.get(piece)) is None:
                    tokens = list(self.transducer.encode(piece.encode()))
                    ids = struct.pack(f"<{len(tokens)}I", *tokens)
                self.new[piece] = ids
                self.size += len(piece) + len(ids) + 180
        return b"".join(map(self.new.__getitem__, pieces))


def decode_stream(vocabulary: list[bytes], ids: Iterable[np.ndarray]) -> Iterator[str]:
    """Text of a stream of id arrays, as far as it is certain: a character cut by a token waits for its last byte.

    The state is that of an incremental UTF-8 machine, at most three pending bytes; bytes that are no UTF-8 become U+FFFD.
    """
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for some in ids:
        yield machine.decode(b"".join(map(vocabulary.__getitem__, some.tolist())))
    yield machine.decode(b"", final=True)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@cache
def vocabulary(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _encoded(path: str, pattern: str, batch: pa.RecordBatch) -> Iterator[bytes]:
    enc = encoder(path, pattern)
    return (enc.encode(x.as_py().decode("utf-8", "replace")) for x in batch.column("text"))


def _decoded(path: str, data: bytes | None) -> str:
    words, ids = vocabulary(path), np.frombuffer(data or b"", "<u4")
    return "".join(decode_stream(words, (ids[at : at + DECODE_IDS] for at in range(0, len(ids), DECODE_IDS))))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): little-endian unsigned 32-bit ids of each whole text.

    Null counts as empty and has no ids; bytes that are no UTF-8 count as U+FFFD. Repeated rows each return a row,
    a null doc_id stays null, other columns are ignored and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(_encoded(path, pattern, batch)), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [_decoded(path, x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, and decoded again from the ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(_decoded(path, ids).encode()).hexdigest()) for ids in _encoded(path, pattern, batch)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
