"""Mixture-controlled packing of token streams into windows by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A window of `size` tokens visits the queues in turn; a queue's
credit grows by its quantum, share * size, and it gives as many whole tokens as its credit holds. What is left of the
credit, the deficit, passes to the next window. As documents are cut freely, a queue's deficit after w windows has a
closed form: with the queues' summed shares F_q(x) after x tokens in all, queue q has given

    C_q(w) = floor(F_q(w * size)) - floor(F_(q-1)(w * size))

tokens, never a whole token off its share, and the queues together exactly w * size. Queues whose quantum is below a token
give floor(share * w * size) instead, their credit below one carrying on, and the others share what these leave. So every
task cuts its own documents with the deficits of all earlier windows and partitions carried in, and no task follows another.

Shares are the sources' own by default (all queues end together), or given targets; sources without one share what the
targets leave, in proportion to their tokens. The window in which a queue runs out is filled by the others, which from then on
have its share, in their proportions. A source without a target and with under two tokens a window joins a common queue of
small sources; so there are at most size / 2 + 1 queues besides the targets', a proven bound for what the driver and the
tasks hold.
In the common queue documents stand by their place as a fraction of their source's tokens, so that at each point of it every
small source has given its share to within about a document. Every window serves every queue, but a common queue with
under one token a window is served in some windows only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate
from math import lcm
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.llm.shared import text_bytes, written
from ledgerwind.llm.word_tokens import encoder, slices

SIZE = 4096
#: Sum of a phase's rates up to which weights are exact; beyond, they are rounded to this sum.
EXACT = 1 << 64
#: Rows of the table of queue offsets up to which it is broadcast (about 60 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass
class Phase:
    """Windows from `start` on in which the same queues have tokens, and what queues have given before: sums over queues."""

    start: int
    base: list[int]
    rates: list[int]
    tiny: list[tuple[int, int]]
    d: int

    def upto(self, queue: int, tokens: int) -> int:
        """What the queues up to this one have given when all have given so many tokens in this phase."""
        if not self.d:
            return self.base[queue]
        if not self.tiny:
            return self.base[queue] + self.rates[queue] * tokens // self.d
        rest = tokens - sum(rate * tokens // self.d for _, rate in self.tiny)
        return self.base[queue] + self.rates[queue] * rest // self.rates[-1] + sum(rate * tokens // self.d for q, rate in self.tiny if q <= queue)


@dataclass
class Mixture:
    """The queues' cumulative allotments by window, phase by phase."""

    size: int
    total: int
    phases: list[Phase]

    @property
    def windows(self) -> int:
        return -(-self.total // self.size)

    def bounds(self, queue: int, window: int) -> tuple[int, int]:
        """Tokens that the queues before this one, and with it, have given by the start of a window."""
        phase = self.phases[bisect_right(self.phases, window, key=lambda p: p.start) - 1]
        tokens = (window - phase.start) * self.size
        return phase.upto(queue - 1, tokens) if queue else 0, phase.upto(queue, tokens)

    def given(self, queue: int, window: int) -> int:
        low, high = self.bounds(queue, window)
        return high - low

    def window_of(self, queue: int, token: int) -> int:
        return bisect_right(range(self.windows + 1), token, key=lambda w: self.given(queue, w)) - 1

    def pieces(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset in it) for a document at a place in its queue."""
        at, window = 0, self.window_of(queue, start)
        (low, high) = self.bounds(queue, window)
        while at < length:
            next_low, next_high = self.bounds(queue, window + 1)
            if (n := min(length - at, next_high - next_low - start - at)) > 0:
                yield at, n, window, next_low - low + start + at - (high - low)
                at += n
            window, low, high = window + 1, next_low, next_high


def _rates(weights: list[Fraction], left: list[int]) -> list[int]:
    """Whole rates of the queues that have tokens left; weights of zero count only among themselves."""
    some = [w if n else 0 for w, n in zip(weights, left, strict=True)]
    some = some if any(some) else left
    scale = lcm(*(Fraction(w).denominator for w in some))
    if scale * sum(some) > EXACT:
        scale = Fraction(EXACT, 1) / sum(some)
    return [max(int(w * scale), 1) if w else 0 for w in some]


def _phase(start: int, given: list[int], rates: list[int], size: int) -> Phase:
    """The next phase; if a quantum is below a token, quanta below two are tiny, which keeps the others' gifts from shrinking."""
    d, tiny = sum(rates), []
    if any(r and r * size < d for r in rates):
        tiny = [(q, r) for q, r in enumerate(rates) if r and r * size < 2 * d]
        if 2 * len(tiny) > size - sum(r * size / d for _, r in tiny):
            raise ValueError("too many targets of under two tokens a window")
    small = {q for q, _ in tiny}
    return Phase(start, list(accumulate(given)), list(accumulate(0 if q in small else r for q, r in enumerate(rates))), tiny, d)


def mixture(tokens: list[int], weights: list[Fraction], size: int) -> Mixture:
    """Allotments of queues with so many tokens, served in proportion to the weights until each has run out."""
    given, start, phases, queues = [0] * len(tokens), 0, [], range(len(tokens))
    while given != tokens:
        left = [n - g for n, g in zip(tokens, given, strict=True)]
        rates = _rates(weights, left)
        phase = _phase(start, given, rates, size)
        phases.append(phase)
        own = lambda q, w: phase.upto(q, w * size) - (phase.upto(q - 1, w * size) if q else 0)  # noqa: B023, E731
        # a queue surely lasts for the first and has surely ended after the last of these windows
        last = min((2 * n + 4 * size) * phase.d // (r * size) + 2 for n, r in zip(left, rates, strict=True) if r)
        whole = bisect_right(range(min(last, sum(left) // size) + 1), False, key=lambda w: any(own(q, w) > tokens[q] for q in queues if rates[q])) - 1  # noqa: B023
        now = [own(q, whole) for q in queues]
        wanted = [own(q, whole + 1) - g if r else 0 for q, (g, r) in enumerate(zip(now, rates, strict=True))]
        room = min(size, sum(tokens) - sum(now))
        for q in queues:  # the window in which a queue runs out, or the last one
            gift = min(wanted[q], tokens[q] - now[q], room)
            now[q], room = now[q] + gift, room - gift
        while room:
            open_ = [q for q in queues if now[q] < tokens[q]]
            part = _rates([weights[q] for q in open_], [tokens[q] - now[q] for q in open_])
            gifts = {q: min(room * r // sum(part), tokens[q] - now[q]) for q, r in zip(open_, part, strict=True)}
            if not any(gifts.values()):
                gifts = {next(q for q, r in zip(open_, part, strict=True) if r): 1}
            for q, gift in gifts.items():
                now[q], room = now[q] + gift, room - gift
        given, start = now, start + whole + 1
    phases.append(Phase(start, list(accumulate(tokens)), [], [], 0))
    return Mixture(size, sum(tokens), phases)


def _tokens(path: str, end: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, given = encoder(path), TaskContext.get().partitionId(), {}
        last = np.array([end], enc.dtype).tobytes()
        for batch in slices(batches):
            ids = [enc.encode(x.as_py()) + last for x in batch.column("text")]
            counts, before = [len(x) // enc.dtype.itemsize for x in ids], []
            for source, n in zip(batch.column("source").to_pylist(), counts, strict=True):
                before.append(given.get(source, 0))
                given[source] = before[-1] + n
            arrays = [pa.array([part] * len(ids), pa.int32()), batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "source", "n", "before", "ids"])

    return encoded


def _pieces(mix: Mixture, width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{width}"
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows, parts = whole.slice(at, 256), [], []
                for doc, queue, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "start", "n", "ids")), strict=True):
                    view = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                    for begin, length, window, offset in mix.pieces(queue, start, n):
                        part = view[4 * begin : 4 * (begin + length)]
                        rows.append((doc, begin, length, crc32(part), n, window, offset))
                        parts.append(part)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
                values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], [*NAMES, "ids"])

    return cut


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _prefix(amount: str, window) -> F.Column:
    return F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, given = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = given + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), batch.column("n"), pa.array(ends - n), batch.column("ids")], ["part", "doc_id", "n", "before", "ids"])
        given = int(ends[-1]) if len(n) else given


def _weights(queues: list[str | None], counts: list[int], targets: dict[str, float]) -> list[Fraction]:
    """Targets of the queues that have one; the others share the rest by their tokens."""
    given = {q: Fraction(str(t)) for q, t in targets.items()}
    if any(t < 0 for t in given.values()):
        raise ValueError("a target must not be negative")
    rest, others = max(Fraction(1) - sum(given.values()), Fraction(0)), sum(n for q, n in zip(queues, counts, strict=True) if q not in given)
    return [given[q] if q in given else rest * n / others for q, n in zip(queues, counts, strict=True)]


PLACED = ["doc_id", "queue", "start", "n", "ids"]


def _interleaved(few: DataFrame, queue: int) -> DataFrame:
    """The small sources' documents placed in their common queue, all sources advancing together.

    A document's place lies in its own span of its source's tokens, at a point that the source's hash tells, so that
    sources of a single document are spread over the whole queue.
    """
    point = F.pmod(F.xxhash64("s"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    order = ["place", "s", "part", "before"]
    ordered = few.withColumn("place", (F.col("start") + point * F.col("n")) / F.col("source_n")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ordered.select("doc_id", "n", "ids").mapInArrow(_running, "part int, doc_id long, n long, before long, ids binary"), "small-sources")
    bases = rows.groupBy("part").agg(F.sum("n").alias("n")).select("part", _prefix("n", Window.partitionBy(F.lit(0)).orderBy("part")).alias("base"))  # a row a task
    return rows.join(F.broadcast(bases), "part").select("doc_id", F.lit(queue).alias("queue"), (F.col("base") + F.col("before")).alias("start"), "n", "ids")


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text, source) in sequences of `size` tokens; only the last sequence may be shorter.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (array<int>). Each document is
    its text's ids (null: none) and the end id; all ids lie in exactly one piece. A null source is a queue as any
    other. targets holds shares of tokens by source, small sources included; a source with target 0 comes last. Repeated rows and ids are packed each for itself; other columns are ignored; an empty table gives none.
    """
    spark, width = docs.sparkSession, encoder(tokenizer).dtype.itemsize
    tokens = written(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_bytes()).mapInArrow(_tokens(tokenizer, end), "part int, doc_id long, source string, n long, before long, ids binary"), "tokens")
    parts = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-parts")
    sums = parts.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    named = F.coalesce(F.col("source").isin(list(targets or {})), F.lit(False))
    large = sums.filter((F.col("n") * size >= 2 * total) | named).orderBy("source").collect() if total else []  # at most size / 2 rows and the targets'
    queues, counts = [r["source"] for r in large], [r["n"] for r in large]
    if small := total - sum(counts):
        counts.append(small)
    mix = mixture(counts, _weights([*queues, *[None] * (len(counts) - len(queues))], counts, targets or {}), size)
    known = spark.createDataFrame([(q, i) for i, q in enumerate(queues)], "source string, queue int")
    of = sums.join(F.broadcast(known), sums["source"].eqNullSafe(known["source"]), "left").select(sums["source"].alias("s"), F.col("n").alias("source_n"), "queue")
    starts = parts.withColumn("in_source", _prefix("n", Window.partitionBy("source").orderBy("part")))
    starts = starts.join(of, starts["source"].eqNullSafe(of["s"])).select("s", F.col("part").alias("p"), "queue", "source_n", "in_source")
    if parts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, tokens["source"].eqNullSafe(starts["s"]) & (tokens["part"] == starts["p"])).withColumn("start", F.col("in_source") + F.col("before"))
    if small:
        placed = placed.filter("queue is not null").select(*PLACED).unionByName(_interleaved(placed.filter("queue is null"), len(queues)))
    else:
        placed = placed.select(*PLACED)
    return placed.mapInArrow(_pieces(mix, width), ", ".join(f"{c} long" for c in NAMES) + ", ids array<int>")
