"""Intermediate tables in the folder that driver and executors share, so that a result used twice is made once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is broadcast.
SMALL = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that is unset, a session in one process (master local) gets a temporary folder that goes when it ends; any
    other must name a folder that all its machines see, since executors would write to disks that no other one reads.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ledgerwind-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and it survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def small(df: DataFrame) -> DataFrame:
    """df, of a few narrow columns and cheap to count, to be broadcast if it has few rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def changed(spark: SparkSession, path: str) -> int | None:
    """When a file or folder was last changed, by the file system that Spark reads it with; null if it is not there."""
    system, at = _file(spark, path)
    return system.getFileStatus(at).getModificationTime() if system.exists(at) else None


def whole(spark: SparkSession, owner: object) -> bool:
    """Whether all stored tables that an object holds are still there."""
    held = [x.stored_at for x in vars(owner).values() if isinstance(x, DataFrame) and hasattr(x, "stored_at")]
    return all(changed(spark, path) is not None for path in held)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has stored; results that read them can't be read after that."""
    system, at = _file(spark, shared_dir(spark))
    system.delete(at, True)
