"""Scaled vectors of whole numbers as compact bytes, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of the first byte: the narrowest of these holds a vector's whole numbers; floats are whole numbers beyond 64 bits.
KINDS = (np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"), np.dtype("<f8"))
#: Scaled components of this size are an error: sums of their products can overflow a float.
LARGEST = 2.0**500


def pack(x: np.ndarray) -> bytes:
    """Whole numbers held as floats, in the narrowest kind: equal vectors have equal bytes."""
    low, high = x.min(), x.max()
    for code, kind in enumerate(KINDS[:4]):
        most = 2.0 ** (8 * kind.itemsize - 1)
        if -most <= low and high < most:
            return bytes([code]) + x.astype(kind).tobytes()
    return bytes([4]) + (x + 0.0).astype("<f8").tobytes()


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length as rows of floats (whole numbers below 2^53 are exact)."""
    out, codes = np.empty((len(rows), dim)), np.fromiter((r[0] for r in rows), np.uint8, len(rows))
    for code in np.unique(codes):
        some = np.flatnonzero(codes == code)
        out[some] = np.frombuffer(b"".join(rows[i][1:] for i in some), KINDS[code]).reshape(-1, dim)
    return out


def unpack_longs(rows: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length as rows of 64-bit integers, none of them held as floats."""
    out, codes = np.empty((len(rows), dim), np.int64), np.fromiter((r[0] for r in rows), np.uint8, len(rows))
    for code in np.unique(codes):
        some = np.flatnonzero(codes == code)
        out[some] = np.frombuffer(b"".join(rows[i][1:] for i in some), KINDS[code]).reshape(-1, dim)
    return out


def _whole(scale: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, dims, packed = [], [], []
            for at, values in enumerate(batch.column("embedding")):
                if not values.is_valid or not len(values.values) or values.values.null_count:
                    continue
                x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                if np.abs(x).max() >= LARGEST / scale:
                    raise OverflowError("a vector has a component that is too large to score")
                rows.append(at)
                dims.append(len(x))
                packed.append(pack(np.floor(scale * x)))
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], [*keep, "dim", "v"])

    return run


def whole(vectors: DataFrame, scale: int, keep: dict[str, str]) -> DataFrame:
    """(the columns of keep, cast to its types; dim, v): floor(scale * x) of the vectors that take part, see pack.

    Vectors that are null or empty or hold null or non-finite components take no part.
    """
    columns = [F.col(c).cast(kind).alias(c) for c, kind in keep.items()]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in keep.items()), "dim int, v binary"])
    return vectors.select(*columns, F.col("embedding").cast("array<double>")).mapInArrow(_whole(scale, list(keep)), schema)
