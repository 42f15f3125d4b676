"""Shards of nearly equal bytes by a histogram sort; only DataFrame functions are used.

Documents are ordered by (hash of the text, hash of the id, hash of the row's place), so that equal texts stand together.
Splitters are found by counting: a first histogram holds the exact bytes and rows between PROBES equally spaced keys. The
range between two probes is opened, and probed again between its least and largest key, if a splitter's target (i / shards of
all bytes) lies within or if it holds more than one task should sort. A range of one text is probed by ids, and one of equal
text and id by place, so any hot group can be cut. A splitter is final at the end of a text's group within `snap` of its
target, or else at the document edge nearest to it.

The ranges then deal all documents out in one exchange, one partition a piece (some ranges of one shard) of at most about
PIECE_BYTES; each is sorted and numbered on its own, and a slot is the number plus the rows of the shard's earlier pieces.
The driver holds a few numbers for each probe and piece (100 TB in pieces of 256 MB: 400,000), never a row or a text.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.llm.shared import written

PROBES, PIECE_BYTES = 1 << 14, 256 << 20
#: A text's group is not cut if one of its ends is within this share of a shard from the target (1 / SNAP).
SNAP = 200
#: Bytes that a document counts for besides its text.
OVERHEAD = 8
#: Keys are below 2^KEY_BITS: 15 hexadecimal digits.
KEY_BITS = 60
#: Larger tables of ranges are joined by a shuffle.
BROADCAST_RANGES = 1 << 20
KEYS = ["_k0", "_k1", "_k2"]


class Range(NamedTuple):
    """Documents between two probes: bytes before it, its own bytes and rows, least and largest keys; first: cut by text alone."""

    number: int
    start: int
    size: int
    rows: int
    low: tuple[int, ...]
    high: tuple[int, ...]
    first: bool

    @property
    def level(self) -> int | None:
        """The first key in which its documents differ."""
        return next((i for i in range(len(KEYS)) if self.low[i] != self.high[i]), None)


class Probe(NamedTuple):
    """How a range is cut: by the key of a level into steps of a width, numbered from base."""

    number: int
    level: int
    low: int
    width: int
    base: int


def size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _key(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, KEY_BITS // 4), 16, 10).cast("long")


def _keys(text: str, name: str) -> list[Column]:
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS)
    keys = [_key(F.coalesce(F.col(text).cast("binary"), F.lit(b""))), _key(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), place]
    return [k.alias(c) for k, c in zip(keys, KEYS, strict=True)]


def _step(level: Column, low: Column, width: Column, base: Column) -> Column:
    key = F.when(level == 0, F.col(KEYS[0])).when(level == 1, F.col(KEYS[1])).otherwise(F.col(KEYS[2]))
    return base + F.call_function("div", key - low, width)


def _counted(rows: DataFrame) -> list:
    """Bytes, rows and extreme keys of each range that has rows, in order; PROBES rows at most, or two a range opened."""
    ends = [f(k).alias(f"{f.__name__}{k}") for k in KEYS for f in (F.min, F.max)]
    return rows.groupBy("_range").agg(F.sum("_size").alias("size"), F.count("*").alias("rows"), *ends).orderBy("_range").collect()


def _ranges(counted: list, start: int, first: bool) -> list[Range]:
    out = []
    for r in counted:
        out.append(Range(r["_range"], start, r["size"], r["rows"], *(tuple(r[f"{f}{k}"] for k in KEYS) for f in ("min", "max")), first))
        start += r["size"]
    return out


def _nearest(start: int, end: int, target: int, shards: int) -> int:
    """The edge nearer to target / shards, the later one of two."""
    return end if 2 * target >= (start + end) * shards else start


def settle(ranges: list[Range], shards: int, snap: int, splitters: dict[int, int]) -> set[int]:
    """Puts splitters that are final (bytes before them, by number) into splitters; returns the ranges that hold the others."""
    starts = [r.start for r in ranges]
    total = ranges[-1].start + ranges[-1].size
    held = set()
    for i in (i for i in range(1, shards) if i not in splitters):
        target = i * total
        at = bisect_right(starts, target // shards) - 1
        r = ranges[at]
        if target == r.start * shards:
            splitters[i] = r.start
            continue
        edge = _nearest(r.start, r.start + r.size, target, shards)
        if r.level is None or r.first and r.level > 0 and snap * abs(edge * shards - target) <= total:
            splitters[i] = edge
        else:
            held.add(r.number)
    return held


def plan(rows: DataFrame, shards: int, snap: int, tasks: int) -> tuple[list[list[Probe]], list[tuple[int, int, int]]]:
    """Probes by round, and (range, piece, shard) of all final ranges in order. rows: KEYS and _size of all documents."""
    width = (1 << KEY_BITS) // PROBES
    ranges = _ranges(_counted(rows.withColumn("_range", F.call_function("div", F.col(KEYS[0]), F.lit(width)))), 0, True)
    rounds: list[list[Probe]] = []
    splitters: dict[int, int] = {}
    if not ranges:
        return rounds, []
    total = ranges[-1].start + ranges[-1].size
    piece = max(1, min(PIECE_BYTES, -(-total // max(tasks, shards))))
    rows = rows.withColumn("_range", F.call_function("div", F.col(KEYS[0]), F.lit(width)))
    base = PROBES
    while True:
        held = settle(ranges, shards, snap, splitters)
        opened = [r for r in ranges if r.level is not None and (r.number in held or r.size > piece)]
        if not opened:
            break
        steps, probes = max(2, PROBES // len(opened)), []
        for r in opened:
            low, high = r.low[r.level], r.high[r.level]
            probe = Probe(r.number, r.level, low, -(-(high - low + 1) // steps), base)
            base += (high - low) // probe.width + 1
            probes.append(probe)
        rounds.append(probes)
        rows = written(_probed(rows, probes, "inner"), "probed")
        found, at = _counted(rows), 0
        cut: dict[int, list[Range]] = {}
        for r, probe, after in zip(opened, probes, [*(p.base for p in probes[1:]), base], strict=True):
            own = at
            while at < len(found) and found[at]["_range"] < after:
                at += 1
            cut[r.number] = _ranges(found[own:at], r.start, r.first and probe.level == 0)
        ranges = [x for r in ranges for x in cut.get(r.number, [r])]
    edges = [splitters[i] for i in range(1, shards)]
    dealt: list[tuple[int, int, int]] = []
    number, held_bytes, last = -1, 0, None
    for r in ranges:
        shard = bisect_right(edges, r.start)
        if shard != last or held_bytes + r.size > piece:
            number, held_bytes, last = number + 1, 0, shard
        held_bytes += r.size
        dealt.append((r.number, number, shard))
    return rounds, dealt


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RANGES else df


def _probed(rows: DataFrame, probes: list[Probe], how: str) -> DataFrame:
    """Rows with the range that a round of probes puts them in; by a left join, rows of ranges that stay closed keep theirs."""
    table = rows.sparkSession.createDataFrame(probes, "_range long, _level int, _low long, _width long, _base long")
    joined = rows.join(_small(table, len(probes)), "_range", how)
    step = _step(F.col("_level"), F.col("_low"), F.col("_width"), F.col("_base"))
    return joined.withColumn("_range", F.coalesce(step, "_range")).drop("_level", "_low", "_width", "_base")


def deal(docs: DataFrame, shards: int = 24, snap: int = SNAP, text: str = "text", name: str = "doc_id") -> DataFrame:
    """docs with shard int and slot long (gapless from 0 in each shard, in the order of the sort); columns of these names are replaced.

    A document counts for the UTF-8 bytes of its text (null: none) and OVERHEAD more. Either end of a shard is at most half a
    document from its target, or 1 / snap of a shard where that keeps equal texts together.
    Every row is dealt once: nulls in any column count like empty ones, repeated rows stay and can be parted, and with fewer
    documents than shards some shards stay empty. An empty table gives none. docs is read twice and must give the same rows
    both times; if equal rows come in another order, only how many of them go to which shard can change.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds, dealt = plan(written(docs.select(*_keys(text, name), size(text).alias("_size")), "keys"), shards, snap, tasks)
    rows = docs.select(F.struct("*").alias("_doc"), *_keys(text, name))
    rows = rows.withColumn("_range", F.call_function("div", F.col(KEYS[0]), F.lit((1 << KEY_BITS) // PROBES)))
    for probes in rounds:
        rows = _probed(rows, probes, "left")
    pieces = spark.createDataFrame(dealt, "_range long, _piece int, _shard int")
    lost = F.raise_error(F.lit("the documents have changed between two readings")).cast("int")
    rows = rows.join(_small(pieces, len(dealt)), "_range", "left").withColumn("_piece", F.coalesce("_piece", lost))
    n = dealt[-1][1] + 1 if dealt else 1
    order = Window.partitionBy("_piece").orderBy(*KEYS)
    sorted_ = written(rows.repartitionById(n, "_piece").withColumn("_at", F.row_number().over(order) - 1).select("_doc", "_piece", "_shard", "_at"), "dealt")
    of, before = dict({(p, s) for _, p, s in dealt}), {}
    starts: dict[int, int] = {}
    for r in sorted_.groupBy("_piece").count().orderBy("_piece").collect():
        shard = of[r["_piece"]]
        before[r["_piece"]] = starts.get(shard, 0)
        starts[shard] = before[r["_piece"]] + r["count"]
    firsts = spark.createDataFrame(list(before.items()), "_piece int, _before long")
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    slot = (F.col("_before") + F.col("_at")).cast("long").alias("slot")
    return sorted_.join(_small(firsts, len(before)), "_piece").select(*kept, F.col("_shard").alias("shard"), slot)
