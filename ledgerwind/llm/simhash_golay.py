"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded to the 23 bits of the perfect binary Golay code
[23, 12, 7]. Every 23-bit word lies within 3 bits of exactly one codeword. The codewords of all words within
one bit of x are either one (x is within 2 bits of its codeword) or six. Hence

* two words that differ in at most 2 bits share one of these codeword indices (both are within one bit of a
  common word), and
* if they differ in at most 1 bit, the codeword of either one is among the indices of the other.

With at most 4 differing bits, the three segments' errors, sorted, are (0, <=2, .) or (1, 1, <=2), so every
pair to be linked meets under one of these keys:

* the exact bits of segment i with an index of segment j, for the six ordered (i, j);
* for i < j, an index of segment i with the codeword of segment j, on one side, and the codeword of segment i
  with an index of segment j, on the other.

Rows that meet under a key are verified on the whole fingerprint. A key with m rows emits at most m - 1 links,
a spanning forest of its verified pairs, never all pairs; keys with more than `crowd` rows are dealt out as pairs
of blocks, so that no task holds them whole and no pair is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.components import components
from ledgerwind.llm.shared import text_bytes, written

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Bits of the three segments, from the highest bit of the fingerprint down.
SEGMENTS = (22, 21, 21)
#: Rows of one key that a single task compares; more are dealt out in blocks of BLOCK.
CROWD, BLOCK = 20_000, 4_096
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: bytes) -> bytes:
    """The 8 bytes, highest first, of the SimHash of a UTF-8 text; zero if it has no word."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    if len(words) <= SHINGLE:
        return xxhash.xxh64_digest(joined, SEED)
    digest = xxhash.xxh64_digest
    count, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, count, 8192):
        to = min(at + 8192, count)
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(ends[at:to], ends[at + SHINGLE : to + SHINGLE], strict=True)])
        ones += np.add.reduce(np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = b"".join([fingerprint(x) for x in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", "fp"])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error of at most 3 bits for each remainder."""

    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
        return words

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    one = 1 << np.arange(23)
    two = (one[:, None] | one[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], one, two, (two[:, None] | one[None, :]).ravel()]))
    error = np.zeros(1 << 11, np.int64)
    error[remainder(errors)] = errors
    return low, high, error


def codeword(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within 3 bits of each 23-bit word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for all distinct codeword indices within one bit of each word: one or six a word."""
    near = np.stack([codeword(words), *(codeword(words ^ (1 << bit)) for bit in range(23))], axis=1)
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(fresh)
    return row, near[row, col]


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    words, shift = prints.view(np.uint64), 64
    out = []
    for bits in SEGMENTS:
        shift -= bits
        out.append((words >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64))
    return out


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) under which fingerprints that differ in at most 4 bits are sure to meet."""
    parts = _segments(prints)
    codes, near = [codeword(p) for p in parts], [indices(p) for p in parts]
    rows, keys = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                row, index = near[j]
                rows.append(row)
                keys.append((3 * i + j) << 40 | parts[i][row] << 12 | index)
        for j in range(i + 1, 3):
            tag = (9 + 3 * i + j) << 40
            for row, key in ((near[i][0], near[i][1] << 12 | codes[j][near[i][0]]), (near[j][0], codes[i][near[j][0]] << 12 | near[j][1])):
                rows.append(row)
                keys.append(tag | key)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            prints, nodes = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            row, key = golay_keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row]), pa.array(nodes[row])], ["key", "fp", "node"])


def _close(x: np.ndarray, y: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS  # of signed numbers it would count the absolute value's bits


def spanning(prints: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs within MAX_BITS bits."""
    links: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        close = _close(prints[rest], prints[at])
        found, rest = rest[close], rest[~close]
        links += [(int(nodes[at]), int(nodes[x])) for x in found if nodes[x] != nodes[at]]
        queue += found.tolist()
    return links


def _runs(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    edge = np.flatnonzero(np.diff(key)) + 1
    starts, sizes = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(key)]]))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, n in zip(starts[sizes > 24], sizes[sizes > 24], strict=True):
        if found := spanning(fp[s : s + n], node[s : s + n]):
            pairs = np.array(found, np.int64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    left = (np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1) * np.repeat(sizes <= 24, sizes)  # rows that follow in the run
    for lag in range(1, 24):
        at = np.flatnonzero(left >= lag)
        if not len(at):
            break
        at = at[_close(fp[at], fp[at + lag]) & (node[at] != node[at + lag])]
        a.append(node[at])
        b.append(node[at + lag])
    return np.concatenate(a), np.concatenate(b)


def _link(crowd: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key. kind 0: a link (a, b); kind 1: a row (fp, node) of a crowded key."""

        def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(key), pa.array(a), pa.array(b)], ["kind", "key", "a", "b"])

        held, crowded = [np.empty(0, np.int64)] * 3, None

        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _runs(*rows)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return out(0, np.zeros(pairs.shape[1], np.int64), pairs[0], pairs[1])

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("key", "fp", "node")]
            if crowded is not None:
                n = int(np.searchsorted(rows[0], crowded, "right"))
                if n:
                    yield out(1, *(x[:n] for x in rows))
                    rows = [x[n:] for x in rows]
            if not len(rows[0]):
                continue
            crowded = None
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                yield done([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
            if len(held[0]) > crowd:
                yield out(1, *held)
                crowded, held = held[0][0], [x[:0] for x in held]
        if len(held[0]):
            yield done(held)

    return links


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(spanning(pdf["a"].to_numpy(), pdf["b"].to_numpy()), columns=["a", "b"], dtype="int64")


def _crowds(rows: DataFrame) -> DataFrame:
    """Links of crowded keys: each key's rows in blocks, each pair of blocks compared once."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("a", "b"), blocks).cast("int")
    dealt = rows.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "a", "b").groupBy("key", "p", "q").applyInPandas(_block_links, "a long, b long")


def link_fingerprints(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the nodes of (fp, node) that span all pairs within MAX_BITS bits."""
    keys = nodes.mapInArrow(_keys, "key long, fp long, node long")
    found = written(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_link(crowd), "kind byte, key long, a long, b long"), "simhash-links")
    links, rest = found.filter("kind = 0").select("a", "b"), found.filter("kind = 1").select("key", "a", "b")
    return links if rest.isEmpty() else links.unionByName(_crowds(rest))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs (doc_id, text).

    Null and empty texts, and those of white space only, have fingerprint zero and are linked like any other.
    Rows with equal fingerprints, so all exact copies, are one node before any key is made. Repeated rows and
    doc_ids each return a row. A null doc_id returns its fingerprint's component, null if no row that has an id
    shares that fingerprint. Other columns of docs are ignored; an empty table gives an empty result.
    """
    prints = written(docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), "simhash-nodes")
    labels = components(link_fingerprints(nodes, crowd))
    of = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component, the rows of the smallest doc_id stay, each text once.

    Different texts that share this doc_id all stay, as none of them is known to be the other's copy. Rows without a
    doc_id all stay, as nothing tells them apart; columns are those of docs. Texts move in one shuffle, by doc_id.
    """
    kept = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    whole = docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return whole.unionByName(docs.filter("doc_id is null"))
