"""Exact top-k search by inner product with vector-approximation files.

Components are scaled to whole numbers and each dimension's range is cut into at most CELLS cells of equal width w; a vector's
approximation is the cell c of each component, one byte each. A query q scores an unread vector between

    s + sum_j min(q_j, 0) * (w_j - 1)   and   s + sum_j max(q_j, 0) * (w_j - 1),   s = sum_j q_j * (low_j + c_j * w_j).

Approximations are dealt into shards and queries into blocks; a block scans a shard's cells alone, and of these only vectors
whose upper bound reaches the k-th highest lower bound go on, as (query, row, bound). The bounds of a query's shards meet, and
exact vectors are read in order of the bound: FIRST * k of them first, then those whose bound still reaches the k-th exact
score. After that no unread vector can belong to the result. Exact vectors are moved for these rows only.

Of equal vectors only the k + 1 smallest ids can matter, so the rest are set aside before any query is asked. Scaled
components are held as 64-bit floats, in which each is exact, and scores are summed in the cheapest exact way: floats
below 2^52, 64-bit integers below 2^62, Python's integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwind.llm.shared import written

SCALE, CELLS, FIRST = 64, 256, 2
#: Vectors of a shard and queries of a block at most, on average, and components; shards are smaller only as far as there are tasks for them.
SHARD, LEAST_SHARD, BLOCK, SHARD_COMPONENTS, BLOCK_COMPONENTS = 1 << 17, 256, 1 << 14, 1 << 23, 1 << 21
#: Bounds that a task holds at once.
HELD = 1 << 22
#: Scaled components of this size are an error: sums of their products can overflow a float, and no long can hold them.
LARGEST = 2.0**500


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, dims, rows = [], [], []
        for vec, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if vec is None or not values.is_valid or not len(values.values) or values.values.null_count:
                continue
            x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            if np.abs(x).max() >= LARGEST / SCALE:
                raise OverflowError(f"vector {vec} has a component of 2**494 or more")
            ids.append(vec)
            dims.append(len(x))
            rows.append((np.floor(SCALE * x) + 0.0).astype("<f8").tobytes())  # + 0.0: no negative zeros
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(rows, pa.binary())], ["vec_id", "dim", "v"])


def scaled(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, dim, v, m) of the vectors that take part; m is how often a row stands there, k at most."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_scaled, "vec_id long, dim int, v binary")
    return rows.groupBy("vec_id", "dim", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least: dict[int, np.ndarray] = {}
    most: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, v in zip(batch.column("dim").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x = np.frombuffer(v, "<f8")
            least[dim] = np.minimum(least[dim], x) if dim in least else x
            most[dim] = np.maximum(most[dim], x) if dim in most else x
    for dim in least:
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(least[dim]), pa.array(most[dim])], ["dim", "j", "least", "most"])


def grids(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors: lower end, cell width and upper end of each component (a row a component comes to the driver)."""
    found = rows.select("dim", "v").mapInArrow(_ranges, "dim int, j int, least double, most double").groupBy("dim", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim", "j").collect()
    out = {}
    for dim in {r["dim"] for r in found}:
        low, high = (np.array([r[c] for r in found if r["dim"] == dim]) for c in ("least", "most"))
        out[dim] = low, np.floor((high - low) / CELLS) + 1, high
    return out


def _approximated(grid: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dim, v in zip(batch.column("dim").to_pylist(), batch.column("v").to_pylist(), strict=True):
                low, width, _ = grid[dim]
                cells.append(np.clip((np.frombuffer(v, "<f8") - low) // width, 0, CELLS - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], [*batch.schema.names, "cells"])

    return run


def scan(queries: pd.DataFrame, shard: pd.DataFrame, grid: tuple, k: int) -> pd.DataFrame:
    """(q, row, upper, floor): the rows of a shard that may be among a query's k best by their cells, with their upper bounds.

    floor is the k-th highest lower bound of the shard; rows of the query's own vec_id take no part.
    """
    low, width, high = grid
    rows, ids, dim = shard["row"].to_numpy(), shard["vec_id"].to_numpy(), len(low)
    cells = np.frombuffer(b"".join(shard["cells"]), np.uint8).reshape(-1, dim).astype(np.float64)
    asked, asked_ids, numbers = np.frombuffer(b"".join(queries["v"]), "<f8").reshape(-1, dim), queries["vec_id"].to_numpy(), queries["q"].to_numpy()
    reach = np.abs(low) + np.abs(high) + width * CELLS
    found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
    step = max(1, HELD // max(len(rows), 1))
    for at in range(0, len(asked), step):
        q = asked[at : at + step]
        bounds = (q * width) @ cells.T
        size = np.abs(q) @ reach
        slack = np.where(size < 2**52, 0.0, size * max(2.0**-40, (dim + 16) * 2.0**-52))  # whole numbers below 2**52 are exact
        up = q @ low + np.maximum(q, 0) @ (width - 1) + slack
        down = q @ low + np.minimum(q, 0) @ (width - 1) - slack
        bounds[asked_ids[at : at + step, None] == ids] = -np.inf
        least = np.partition(bounds, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(q), -np.inf)
        i, j = np.nonzero((bounds + up[:, None] >= (least + down)[:, None]) & (bounds > -np.inf))
        found.append((numbers[at + i], rows[j], bounds[i, j] + up[i], (least + down)[i]))
    return pd.DataFrame(dict(zip(("q", "row", "upper", "floor"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def inner(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact inner products, row by row, of whole numbers held as floats."""
    size, out = np.einsum("ij,ij->i", np.abs(q), np.abs(x)), np.einsum("ij,ij->i", q, x)
    small = size < 2**52
    sums = np.where(small, out, 0).astype(np.int64)
    if len(some := np.flatnonzero(~small & (size < 2**62))):
        with np.errstate(invalid="ignore"):  # a component beyond 64 bits can only meet zeros here
            sums[some] = (q[some].astype(np.int64) * x[some].astype(np.int64)).sum(axis=1)
    exact = sums.tolist()
    for i in np.flatnonzero(size >= 2**62):
        exact[i] = sum(int(a) * int(b) for a, b in zip(q[i], x[i], strict=True))
    return exact


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Null stands for a score below all longs; one above them is an error, as it surely belongs to the result."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            dims, scores = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, object)
            q, v = batch.column("qv").to_pylist(), batch.column("v").to_pylist()
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                one, two = (np.frombuffer(b"".join([x[i] for i in some]), "<f8").reshape(-1, dim) for x in (q, v))
                scores[some] = inner(one, two)
            if max(scores, default=0) >= 1 << 63:
                raise OverflowError("a score does not fit a long")
            fitting = pa.array([s if s >= -1 << 63 else None for s in scores], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "query_id", "vec_id", "times")), fitting], ["q", "query_id", "vec_id", "times", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of queries (vec_id) in vectors (vec_id, embedding).

    Scores are inner products of floor(64 * x), ties go to the smaller vec_id. Vectors that are null or empty, hold null or
    non-finite components, or have no vec_id take no part, neither as queries nor as candidates; nor do vectors of another
    length than the query's. Rows that repeat a vec_id are candidates of their own, none of them for a query of that id; the
    results of queries that repeat one are ranked together. Queries with fewer than k candidates get all of them. Vectors may
    have any length and components of any size below 2**494, larger ones are an error, as is a score of the result that no
    long can hold. Other columns are ignored; empty tables give none.
    """
    spark = vectors.sparkSession
    every = written(scaled(vectors, k), "vectors")
    grid = grids(every)
    distinct = every.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    rows = written(distinct.mapInArrow(_approximated(grid), "vec_id long, dim int, v binary, m int, cells binary").withColumn("row", F.monotonically_increasing_id()), "approximations")
    asked = every.join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi")
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    n, n_asked, widest = rows.count(), asked.count(), max(grid, default=1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard, per_block = max(min(SHARD, SHARD_COMPONENTS // widest), 16), max(min(BLOCK, BLOCK_COMPONENTS // widest), 16)
    shards, blocks = max(-(-n // per_shard), min(-(-n // LEAST_SHARD), tasks), 1), max(-(-n_asked // per_block), 1)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = rows.select("row", "vec_id", "dim", "cells", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), all_of(blocks).alias("block"))
    asking = asked.select("q", "vec_id", "dim", "v", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), all_of(shards).alias("shard"))
    keys = ["dim", "shard", "block"]

    def both(asking: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        return scan(asking, shard, grid[int((asking if shard.empty else shard)["dim"].iloc[0])], k)

    bounds = asking.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(both, "q long, row long, upper double, floor double")
    of = Window.partitionBy("q")
    open_ = bounds.withColumn("least", F.max("floor").over(of)).filter("upper >= least")
    open_ = written(open_.withColumn("at", F.row_number().over(of.orderBy(F.desc("upper")))).select("q", "row", "upper", "at"), "bounds")
    exact = rows.select("row", "vec_id", "dim", "v", "m")
    question = asked.select("q", F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("m").alias("qm"))

    def read(some: DataFrame) -> DataFrame:
        pairs = some.select("q", "row").join(exact, "row").join(question, "q").withColumn("times", F.least(F.col("m") * F.col("qm"), F.lit(k)))
        return pairs.select("q", "query_id", "vec_id", "times", "dim", "qv", "v").mapInArrow(_scores, "q long, query_id long, vec_id long, times int, score long")

    first = written(read(open_.filter(F.col("at") <= FIRST * k)), "exact")
    kth = first.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter((F.col("at") == k) & F.col("score").isNotNull()).select("q", F.col("score").alias("kth"))
    later = open_.filter(F.col("at") > FIRST * k).join(kth, "q", "left").filter("kth is null or upper >= kth")
    scored = first.unionByName(read(later)).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scored.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    score = F.coalesce("score", F.raise_error(F.lit("a score of the result does not fit a long")).cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
