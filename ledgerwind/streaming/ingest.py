"""Structured Streaming ingest: late rows are linked by later batches and never dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerwind.functions.stored import stored
from ledgerwind.sources.prices import exists


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def ingest(stream: DataFrame, table: str, keys: list[str], checkpoint: str, relink: Callable[[DataFrame], None] | None = None) -> None:
    """Appends rows whose keys the table lacks, batch by batch, and runs relink on the table after each.

    Each batch is a folder of its own named by the batch, overwritten if the batch is run again, and compared with the
    earlier batches only; so a replay after a failure changes nothing. The table is read as one, its partition column telling
    the batches apart, and one anti-join of the keys leaves the new rows. Runs what is there and ends.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark, rest = rows.sparkSession, [c for c in rows.columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else rows.distinct()
        if number and exists(spark, table):
            known = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(table).filter(F.col("batch") < number)
            one = one.join(known.select(*keys), keys, "left_anti")
        one.select(*rows.columns).write.mode("overwrite").parquet(f"{table}/batch={number}")
        if relink:
            relink(spark.read.parquet(table).drop("batch"))

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compact(spark: SparkSession, table: str, number: int) -> None:
    """Joins batches up to a number, none of which will be run again, into one folder, so that a long-lived table stays short to list."""
    merged = spark.read.parquet(table).filter(F.col("batch") <= number)
    kept = stored(merged.drop("batch"), "compacted")
    for n in sorted(r["batch"] for r in merged.select("batch").distinct().collect() if r["batch"] < number):  # a row a batch
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/batch={n}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    kept.write.mode("overwrite").parquet(f"{table}/batch={number}")


def first_per_key(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The stream without rows that repeat a key within the watermark; state of older keys is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def rate_windows(stream: DataFrame, at: str, key: str, length: str, slide: str, delay: str) -> DataFrame:
    """(start, key, n): rows by sliding windows of event time."""
    counts = stream.withWatermark(at, delay).groupBy(F.window(at, length, slide), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there; complete results are rewritten as a whole by each batch."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
