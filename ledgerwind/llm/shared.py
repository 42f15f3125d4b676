"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwind.functions.stored import shared_path
from ledgerwind.functions.stored import stored as written

#: ASCII white space, as one Java/Python character class.
WORD = r"[^\x20\x09-\x0D]+"


__all__ = ["WORD", "shared_path", "table", "text_bytes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)
