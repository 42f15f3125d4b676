"""Hard negatives by product quantisation with stored residual norms; all returned scores are exact integers.

Components are scaled to whole numbers and cut into parts of PART. Each part has a codebook of at most CENTROIDS whole-number
centroids, fitted to about SAMPLE rows of its length; every row is encoded, as a centroid of each part and the norm of what
the centroid leaves, rounded up to 1/255 of the row's largest. An anchor a then scores a row between

    sum_p T_p[code_p] - sum_p |a_p| * norm_p   and   sum_p T_p[code_p] + sum_p |a_p| * norm_p

where T_p is the table of a's products with the centroids of part p. Rows are dealt into shards, anchors into blocks. A task
looks up one block's bounds in one shard and takes exact products only of rows that the bounds leave open: for positives,
those whose upper bound reaches the k-th lower bound; for negatives, those whose bounds meet the window below the positive's
score and reach the k-th lower bound of rows that are surely inside. It returns k rows an anchor (or positive) at most, and the
best of all shards are the result. A codebook that fits badly costs time, never a row.

Of equal vectors with one label only the k + 1 smallest ids can matter, so the rest are set aside before any anchor asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.llm.shared import written
from ledgerwind.llm.va_file import inner
from ledgerwind.llm.vectors import unpack, whole

SCALE, PART, CENTROIDS, ROUNDS = 256, 2, 256, 8
#: Rows that a length's codebooks are fitted to, on average, and their components at most; bytes of all codebooks.
SAMPLE, SAMPLE_COMPONENTS, CODEBOOK_BYTES = 8192, 1 << 23, 1 << 28
#: Rows of a shard and anchors of a block at most, on average, and components; shards are smaller only as far as there are tasks for them.
SHARD, LEAST_SHARD, BLOCK, SHARD_COMPONENTS, BLOCK_COMPONENTS = 1 << 16, 256, 1 << 14, 1 << 22, 1 << 21
#: Bounds that a task holds at once, and components of exact products.
HELD, PRODUCTS = 1 << 21, 1 << 22
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, parts, PART); the last part is filled up with noughts."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PART))).reshape(len(x), -1, PART)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, packed = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
        for dim in np.unique(dims).tolist():
            x = _parts(unpack([packed[i] for i in np.flatnonzero(dims == dim)], dim))
            n, parts = x.shape[:2]
            cut = [p.tobytes() for p in np.ascontiguousarray(x).reshape(-1, PART)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n * parts, dim, np.int32)), pa.array(np.tile(np.arange(parts, dtype=np.int32), n)), pa.array(cut, pa.binary())], ["dim", "part", "x"])


def codebook(x: np.ndarray, centroids: int) -> np.ndarray:
    """At most so many whole-number centroids of the rows of x, by Lloyd's rounds from rows spread over their order."""
    values, weight = np.unique(x, axis=0, return_counts=True)
    if len(values) <= centroids:
        return values
    scale = max(1.0, np.abs(values).max())  # squares of the largest components would overflow
    points = values / scale
    found = points[np.linspace(0, len(points) - 1, centroids).astype(int)]
    for _ in range(ROUNDS):
        at = _closest(points, found)
        sums = np.stack([np.bincount(at, points[:, j] * weight, len(found)) for j in range(x.shape[1])], axis=1)
        total = np.bincount(at, weight, len(found))
        found = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], found)
    return np.unique(np.rint(found * scale), axis=0)


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def codebooks(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """By length, the centroids of each part; a task fits a part."""
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    if not counts:
        return {}
    centroids = max(1, min(CENTROIDS, CODEBOOK_BYTES // (8 * sum(counts))))
    rates = [(dim, int((1 << 20) * min(1.0, max(1, min(SAMPLE, SAMPLE_COMPONENTS // dim)) / n))) for dim, n in counts.items()]
    rate = rows.sparkSession.createDataFrame(rates, "dim int, rate long")  # a row a length
    sample = rows.join(F.broadcast(rate), "dim").filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < F.col("rate"))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = codebook(np.frombuffer(b"".join(part["x"]), np.float64).reshape(-1, PART), centroids)
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "found": [found.astype("<f8").tobytes()]})

    cut = sample.select("dim", "v").mapInArrow(_cut, "dim int, part int, x binary")
    fitted = {(r["dim"], r["part"]): np.frombuffer(r["found"], "<f8").reshape(-1, PART) for r in cut.groupBy("dim", "part").applyInPandas(fit, "dim int, part int, found binary").collect()}
    nought = np.zeros((1, PART))  # of a length without a row in the sample
    return {dim: [fitted.get((dim, p), nought) for p in range(-(-dim // PART))] for dim in counts}


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and residual norms by row and part, as bytes, and the norm that 255 stands for."""
    parts = _parts(x)
    codes, norms = np.empty(parts.shape[:2], np.uint8), np.empty(parts.shape[:2])
    for p, book in enumerate(books):
        scale = max(1.0, np.abs(book).max(), np.abs(parts[:, p]).max(initial=0))
        codes[:, p] = _closest(parts[:, p] / scale, book / scale)
        norms[:, p] = np.linalg.norm((parts[:, p] - book[codes[:, p]]) / scale, axis=1) * scale
    most = norms.max(axis=1)
    return codes, np.minimum(np.ceil(norms / np.maximum(most, 1e-300)[:, None] * 255), 255).astype(np.uint8), most


def _encoded(books: dict[int, list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, packed = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            for dim in np.unique(dims).tolist():
                some = np.flatnonzero(dims == dim)
                codes, norms, most = encode(unpack([packed[i] for i in some], dim), books[dim])
                new = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([c.tobytes() for c in norms], pa.binary()), pa.array(most)]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some)).columns, *new], [*batch.schema.names, "codes", "norms", "most"])

    return run


class Shard:
    """A shard's rows: labels, exact vectors, codes and residual norms."""

    def __init__(self, rows: pd.DataFrame, books: list[np.ndarray], dim: int):
        self.ids, self.labels, self.books = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), books
        self.x = unpack(list(rows["v"]), dim)
        self.codes, norms = (np.frombuffer(b"".join(rows[c]), np.uint8).reshape(len(rows), -1) for c in ("codes", "norms"))
        self.norms = norms * (rows["most"].to_numpy() * ((1 + 1e-9) / 255))[:, None]
        self.reach = np.abs(self.x).max(axis=0, initial=0)

    def bounds(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest scores of some rows (down) for anchors (across)."""
        parts = _parts(q)
        between = np.zeros((len(rows), len(q)))
        codes = self.codes[rows]
        for p, book in enumerate(self.books):
            between += (book @ parts[:, p].T)[codes[:, p]]
        size = np.abs(q) @ self.reach + sum(np.abs(parts[:, p]) @ np.abs(b).max(axis=0) for p, b in enumerate(self.books))
        slack = np.where(size < 2**51, 0.0, size * max(2.0**-40, (q.shape[1] + 16) * 2.0**-52))  # whole numbers below 2**52 are exact
        spread = self.norms[rows] @ np.linalg.norm(parts, axis=2).T * (1 + 1e-9) + slack
        return between - spread, between + spread

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact products of one anchor with some rows."""
        out, step = np.empty(len(rows), np.int64), max(1, PRODUCTS // len(q))
        for at in range(0, len(rows), step):
            x = self.x[rows[at : at + step]]
            if (np.abs(x) @ np.abs(q)).max(initial=0) < 2**52:
                out[at : at + step] = x @ q
                continue
            exact = inner(np.broadcast_to(q, x.shape), x)
            if max(map(abs, exact)) >= 1 << 63:
                raise OverflowError("a score does not fit a long")
            out[at : at + step] = exact
        return out

    def best(self, scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest scores, ties to the smaller id."""
        order = np.lexsort((self.ids[rows], ~scores))[:k]
        return self.ids[rows[order]], scores[order]

    def by_label(self, asked: pd.DataFrame, q: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, rows of their label or of all others, bounds), a few anchors at a time; rows of the anchor's own id have none."""
        labels, ids = asked["label"].to_numpy(), asked["vec_id"].to_numpy()
        for label in pd.unique(labels):
            anchors, rows = np.flatnonzero(labels == label), np.flatnonzero((self.labels == label) == same)
            step = max(1, HELD // max(len(rows), 1))
            for at in range(0, len(anchors) if len(rows) else 0, step):
                some = anchors[at : at + step]
                low, high = self.bounds(q[some], rows)
                own = self.ids[rows][:, None] == ids[some]
                low[own] = high[own] = -np.inf
                yield some, rows, low, high


def positives(asked: pd.DataFrame, shard: Shard, q: np.ndarray, k: int) -> pd.DataFrame:
    """(q, vec_id, score): each anchor's k best rows of its own label in a shard."""
    out: list[tuple] = []
    for some, rows, low, high in shard.by_label(asked, q, True):
        least = np.partition(low, -k, axis=0)[-k] if len(rows) > k else np.full(len(some), -np.inf)
        for j, i in enumerate(some):
            open_ = rows[(high[:, j] >= least[j]) & (high[:, j] > -np.inf)]
            ids, scores = shard.best(shard.scores(q[i], open_), open_, k)
            out += zip([asked["q"].iloc[i]] * len(ids), ids, scores, strict=True)
    return pd.DataFrame(out, columns=["q", "vec_id", "score"])


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole numbers from least to most hundredths of a score."""
    return -(-least * score // 100), most * score // 100


def negatives(asked: pd.DataFrame, shard: Shard, q: np.ndarray, k: int, least: int, most: int) -> pd.DataFrame:
    """(q, at, vec_id, score): for each of an anchor's positives (at), the k best rows of other labels inside its window in a shard."""
    out: list[tuple] = []
    for some, rows, low, high in shard.by_label(asked, q, False):
        for j, i in enumerate(some):
            windows = [window(int(s), least, most) for s in asked["scores"].iloc[i]]
            near = np.flatnonzero(high[:, j] >= min(float(w[0]) for w in windows))
            down, up = low[near, j], high[near, j]
            chosen = []
            for a, b in windows:
                inside = down[(down >= a) & (up <= b)]
                floor = np.partition(inside, -k)[-k] if len(inside) >= k else float(a)
                chosen.append((up >= max(floor, float(a))) & (down <= b) if a <= b else np.zeros(len(near), bool))
            open_ = np.flatnonzero(np.logical_or.reduce(chosen))
            scores = shard.scores(q[i], rows[near[open_]])
            for at, (a, b) in enumerate(windows):
                fit = (scores >= a) & (scores <= b)
                ids, found = shard.best(scores[fit], rows[near[open_[fit]]], k)
                out += zip([asked["q"].iloc[i]] * len(ids), [at] * len(ids), ids, found, strict=True)
    return pd.DataFrame(out, columns=["q", "at", "vec_id", "score"])


def mine(vectors: DataFrame, anchors: DataFrame, positive: int = 5, negative: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """NAMES, for the rows of vectors (vec_id, embedding, label) whose vec_id stands in anchors (vec_id).

    An anchor's positives are the `positive` best rows of its own label, a positive's negatives the `negative` best rows of
    other labels that score from least to most hundredths of it; ties go to the smaller vec_id, and fewer are all there are.
    Rows without vec_id or label, null or empty vectors and ones with null or non-finite components take no part; vectors of
    another length than the anchor's don't meet it. Rows of the anchor's own vec_id are neither. Other rows that repeat an id
    count apiece; an anchor that is repeated with vector and label counts once, and ones that differ are anchors of their
    own. Labels may have any type and are compared as text. Components of 2^492 and more are an error, as are scores that no
    long can hold. Other columns are ignored; empty tables give none.
    """
    spark = vectors.sparkSession
    whole_rows = whole(vectors.filter("vec_id is not null and label is not null"), SCALE, {"vec_id": "long", "label": "string"})
    k = max(positive, negative)
    counted = written(whole_rows.groupBy("vec_id", "label", "dim", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m")), "vectors")
    equal = Window.partitionBy("v", "label").orderBy("vec_id")
    kept = counted.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1)
    books = codebooks(counted)
    columns = "vec_id long, label string, dim int, v binary"
    rows = kept.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("m")))).select("vec_id", "label", "dim", "v")
    rows = written(rows.mapInArrow(_encoded(books), f"{columns}, codes binary, norms binary, most double").withColumn("row", F.monotonically_increasing_id()), "codes")
    asked = counted.join(anchors.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi").select("vec_id", "label", "dim", "v")
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "anchors")
    n, n_asked, widest = rows.count(), asked.count(), max(books, default=1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard, per_block = max(min(SHARD, SHARD_COMPONENTS // widest), 16), max(min(BLOCK, BLOCK_COMPONENTS // widest), 16)
    shards, blocks = max(-(-n // per_shard), min(-(-n // LEAST_SHARD), tasks), 1), max(-(-n_asked // per_block), 1)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["dim", "shard", "block"]
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("block", all_of(blocks)).drop("row").groupBy(*keys)

    def met(asking: DataFrame, schema: str, found):
        def both(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or shard.empty:
                return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
            dim = int(asked["dim"].iloc[0])
            return found(asked, Shard(shard, books[dim], dim), unpack(list(asked["v"]), dim))

        dealt = asking.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("shard", all_of(shards))
        return dealt.groupBy(*keys).cogroup(sharded).applyInPandas(both, schema)

    pool = met(asked, "q long, vec_id long, score long", lambda a, s, q: positives(a, s, q, positive))
    order = [F.desc("score"), F.col("vec_id")]
    best = pool.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(*order)) - 1).filter(F.col("at") < positive)
    chosen = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("chosen"))  # `positive` of them at most
    pairs = written(asked.join(chosen, "q").select("q", "vec_id", "label", "dim", "v", F.col("chosen.vec_id").alias("positives"), F.col("chosen.score").alias("scores")), "positives")
    pool = met(pairs, "q long, at int, vec_id long, score long", lambda a, s, q: negatives(a, s, q, negative, least, most))
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("q", "at").orderBy(*order)).cast("int")).filter(F.col("rank") <= negative)
    named = pairs.select("q", F.col("vec_id").alias("anchor_id"), "positives", "scores")
    at = F.col("at") + 1
    return ranked.join(named, "q").select("anchor_id", F.element_at("positives", at).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.element_at("scores", at).alias("positive_score"), F.col("score").alias("negative_score"))
