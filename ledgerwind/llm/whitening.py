"""Whitening of embeddings by a tall-skinny QR (TSQR) of the centred vectors; no covariance matrix is formed.

The fit list is each distinct vector of scaled whole numbers once. Its sums by dimension are exact (halves of 32 bits in
tasks, decimals between them), so x - S / n is centred to the last bit of a double whatever the offset. Each task reduces
its centred rows to an upper triangle R, block by block, and triangles are stacked and reduced again, FAN at a time, in a
tree of shuffles by node. The last task of a length takes the singular values s and right vectors of the final R: the
components are those vectors, their eigenvalues s^2 / n, and a row's whitened values (x - S / n) . v / sqrt(s^2 / n).

Only sums (a row a dimension) and components (`components` rows of numbers a length) come to the driver; the rows never do.
Vectors of different lengths have fits of their own. Triangles have dim^2 numbers, so a task holds FAN of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.shared import written
from ledgerwind.llm.vectors import unpack_longs, whole

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Triangles that meet in a node of the tree; numbers of a block of rows at most.
FAN, BLOCK = 8, 1 << 21
#: Bytes of components that one pass over the rows carries; more lengths than that take more passes.
MODEL_BYTES = 1 << 27
#: An eigenvalue below this share of the largest is nought: its component's whitened values are null.
NOUGHT = 1e-24


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, length, positions, x - OFFSET as longs) of each batch's vectors by length, a block at a time."""
    for batch in batches:
        dims, packed = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
        for dim in np.unique(dims).tolist():
            some = np.flatnonzero(dims == dim)
            step = max(1, BLOCK // dim)
            for at in range(0, len(some), step):
                rows = some[at : at + step]
                if any(packed[i][0] == 4 for i in rows):
                    raise OverflowError("a scaled component does not fit a long")
                yield batch, dim, rows, unpack_longs([packed[i] for i in rows], dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By length and dimension: rows and sum of x - OFFSET, as text; halves of 32 bits can't overflow."""
    held: dict[int, list] = {}
    for _, dim, rows, x in _blocks(batches):
        n, low, high = held.get(dim, (0, 0, 0))
        part = (x & 0xFFFFFFFF).sum(axis=0).astype(object), (x >> 32).sum(axis=0).astype(object)
        held[dim] = [n + len(rows), low + part[0], high + part[1]]
    for dim, (n, low, high) in held.items():
        total = [str(a + (b << 32)) for a, b in zip(low, high, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total)], ["dim", "j", "n", "total"])


class Centre:
    """Number of vectors of a length and their exact sums of x - OFFSET as quotient and remainder by it."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.quotient = np.array([s // n for s in sums], np.int64)
        self.remainder = np.array([s % n for s in sums], np.int64)
        self.fraction = self.remainder / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles; the difference of whole numbers is exact."""
        return self._apart(x).astype(np.float64) - self.fraction

    def _apart(self, x: np.ndarray) -> np.ndarray:
        y = x - self.quotient
        if ((x ^ self.quotient) & (x ^ y) < 0).any():
            raise OverflowError("a scaled component is too far from the mean for a long")
        return y

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n * x - S)^2 over the dimensions."""
        y = self._apart(x)
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if len(self.quotient) * most * most < 1 << 63:
            z = self.n * y - self.remainder
            return (z * z).sum(axis=1).tolist()
        z = self.n * y.astype(object) - self.remainder.astype(object)
        return (z * z).sum(axis=1).tolist()


def centres(fit: DataFrame) -> dict[int, Centre]:
    """The centre of each length of a fit list."""
    parts = fit.select("dim", "v").mapInArrow(_sums, "dim int, j int, n long, total string")
    sums = parts.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim", "j").collect()
    by: dict[int, list] = {}
    for r in sums:
        by.setdefault(r["dim"], []).append(r)
    return {dim: Centre(own[0]["n"], [int(r["total"]) for r in own]) for dim, own in by.items()}


def triangle(*parts: np.ndarray) -> np.ndarray:
    """R of the rows of all parts."""
    return np.linalg.qr(np.concatenate(parts), mode="r")


def _triangles(centre: dict[int, Centre], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One triangle for each run of vectors of one length; rows are sorted by length, so there is one run a length."""
    held: tuple[int, np.ndarray] | None = None

    def out(dim: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([r.astype("<f8").tobytes()])], ["dim", "r"])

    for _, dim, _, x in _blocks(batches):
        if held and held[0] != dim:
            yield out(*held)
            held = None
        rows = centre[dim].centred(x)
        held = dim, triangle(held[1], rows) if held else triangle(rows)
    if held:
        yield out(*held)


def _merged(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    dim = int(key[0])
    r = triangle(*(np.frombuffer(x, "<f8").reshape(-1, dim) for x in nodes["r"]))
    return pd.DataFrame({"dim": [dim], "node": [int(key[1])], "r": [r.astype("<f8").tobytes()]})


def _decomposed(components: int, nodes: pd.DataFrame) -> pd.DataFrame:
    dim = int(nodes["dim"].iloc[0])
    r = triangle(*(np.frombuffer(x, "<f8").reshape(-1, dim) for x in nodes["r"]))
    _, s, right = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    return pd.DataFrame({"dim": [dim], "singular": [s.tolist()], "right": [right[:components].ravel().tolist()]})


def components(fit: DataFrame, centre: dict[int, Centre], most: int = COMPONENTS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: all singular values of the centred fit list and its first right vectors, by a tree of triangles."""
    parts = max(fit.rdd.getNumPartitions(), 1)
    rows = fit.select("dim", "v").sortWithinPartitions("dim").mapInArrow(partial(_triangles, centre), "dim int, r binary")
    nodes = rows.select("dim", F.spark_partition_id().alias("node"), "r")
    while parts > FAN:
        parts = -(-parts // FAN)
        nodes = nodes.withColumn("node", F.expr(f"int(node div {FAN})")).groupBy("dim", "node").applyInPandas(_merged, "dim int, node int, r binary")

    def decomposed(nodes: pd.DataFrame) -> pd.DataFrame:
        return _decomposed(most, nodes)

    last = nodes.select("dim", "r").groupBy("dim").applyInPandas(decomposed, "dim int, singular array<double>, right array<double>")
    return {r["dim"]: (np.array(r["singular"]), np.array(r["right"]).reshape(-1, r["dim"])) for r in last.collect()}


class Whitener:
    """Centre and components of one length."""

    def __init__(self, centre: Centre, singular: np.ndarray, right: np.ndarray):
        self.centre, self.right = centre, right
        squares = singular**2
        self.values = squares[: len(right)] / centre.n
        self.sound = self.values > NOUGHT * max(squares.max(initial=0) / centre.n, 1e-300)
        total = squares.sum()
        self.explained = [float(e) if total > 0 else None for e in squares[: len(right)] / (total or 1)]
        self.scales = np.sqrt(np.where(self.sound, self.values, 1))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.right.T / self.scales


def _products(whiteners: dict[int, Whitener], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By length: sums of products of whitened vectors, which are centred already."""
    held: dict[int, np.ndarray] = {}
    for _, dim, _, x in _blocks(batches):
        w = whiteners[dim].whitened(x)
        held[dim] = held.get(dim, 0) + w.T @ w
    for dim, p in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * p.size, pa.int32()), pa.array(range(p.size), pa.int32()), pa.array(p.ravel())], ["dim", "at", "value"])


def identity_errors(fit: DataFrame, whiteners: dict[int, Whitener]) -> dict[int, float | None]:
    """By length: the largest absolute entry of the whitened fit list's covariance minus the identity; null without a sound component."""
    sums = fit.select("dim", "v").mapInArrow(partial(_products, whiteners), "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value"))
    by: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        by.setdefault(r["dim"], {})[r["at"]] = r["value"]
    out: dict[int, float | None] = {}
    for dim, own in whiteners.items():
        k = len(own.right)
        products = np.array([by[dim][i] for i in range(k * k)]).reshape(k, k) / own.centre.n
        error = np.abs(products - np.eye(k))[np.ix_(own.sound, own.sound)]
        out[dim] = float(error.max()) if error.size else None
    return out


def _applied(whiteners: dict[int, Whitener], errors: dict[int, float | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, dim, rows, x in _blocks(batches):
        own = whiteners[dim]
        k, n = len(own.right), len(rows)
        values, sound = own.whitened(x), np.tile(own.sound, n)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(pa.array(np.repeat(rows, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, own.centre.n)),
                pa.array([Decimal(d) for d in own.centre.deviations(x)], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(values.ravel(), mask=~sound),
                pa.array(own.explained * n, pa.float64()),
                pa.array([errors[dim]] * (n * k), pa.float64()),
            ],
            NAMES,
        )


NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """For each vector (vec_id, embedding) that takes part and each of its first components: NAMES.

    n is the number of distinct vectors of the row's length, deviation the exact sum of (n * x - S)^2 as decimal(38,0) (a
    larger one is an error). Vectors that are null or empty or hold null or non-finite components get no row; a null vec_id
    stays null, and repeated rows and repeated ids get rows of their own. Vectors of different lengths are fitted apart, and
    one of fewer than `most` dimensions has as many components. A component without variance (as of one vector alone, or of
    equal ones) has null for whitened; if no dimension varies, explained and identity_error are null too. Scaled components
    that no long can hold are an error. Other columns are ignored; an empty table gives none.
    """
    rows = written(whole(vectors, SCALE, {"vec_id": "long"}), "scaled")
    fit = written(rows.select("dim", "v").distinct(), "fit")
    centre = centres(fit)
    found = components(fit, centre, most)
    chunks: list[list[int]] = [[]]
    size = 0
    for dim in sorted(found):
        size += 8 * dim * (most + 4)
        if size > MODEL_BYTES and chunks[-1]:
            chunks.append([])
            size = 8 * dim * (most + 4)
        chunks[-1].append(dim)
    out = None
    for chunk in chunks:
        whiteners = {dim: Whitener(centre[dim], *found[dim]) for dim in chunk}
        some = lambda df, chunk=chunk: df if len(chunks) == 1 else df.filter(F.col("dim").isin(chunk))
        errors = identity_errors(some(fit), whiteners)
        part = some(rows).mapInArrow(partial(_applied, whiteners, errors), "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
        out = part if out is None else out.unionByName(part)
    return out
