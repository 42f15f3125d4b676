"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A data set is a folder with `data`, one shard file a partition, and `index`, a Parquet table with a row a record.
Shards hold records in ascending doc_id order, shard after shard. One record is

    length   unsigned 64 bits, bytes of the payload
    check    unsigned 32 bits, masked CRC-32 of the length
    payload  flags (1 byte: 1 = it has a doc_id, 2 = ids of 4 bytes), doc_id (signed 64 bits), then the ids
    check    unsigned 32 bits, masked CRC-32 of the payload
    end      one byte, 0x0A

all little-endian. A mask turns the checksum by 15 bits and adds a constant, so that a checksum over data that
hold checksums stays meaningful. Spark's text writer commits the shards (its line end is the records' end byte), so
any file system that Spark writes to will do and a lost task leaves nothing behind.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwind.llm.shared import text_bytes, written
from ledgerwind.llm.word_tokens import encoder, slices

MASK = 0xA282EAD8
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<Bq")
#: Bytes of text of a shard, on average. A task reads a shard whole, and no row of Spark can hold 2 GB.
SHARD_BYTES = 256 << 20
#: Shards whose token counts one task adds up.
SHARDS_A_BLOCK = 4096


def masked(data: bytes) -> int:
    check = crc32(data)
    return ((check >> 15 | check << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = BODY.pack((doc_id is not None) | wide << 1, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), b"\n"))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at a byte offset, and the next record's offset; an error if a checksum fails."""
    length, check = HEAD.unpack_from(data, at)
    start = at + HEAD.size
    if masked(data[at : at + 8]) != check or start + length + 5 > len(data):
        raise ValueError(f"damaged record length at byte {at}")
    payload = data[start : start + length]
    if masked(payload) != struct.unpack_from("<I", data, start + length)[0] or data[start + length + 4] != 10:
        raise ValueError(f"damaged record at byte {at}")
    return payload, start + length + 5


def ids_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = BODY.unpack_from(payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload[BODY.size :], "<u4" if flags & 2 else "<u2")


def _framed(path: str, end: int):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        last, wide = np.array([end], enc.dtype).tobytes(), enc.dtype.itemsize == 4
        for batch in slices(batches):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
            out = [frame(doc, enc.encode(text.as_py()) + last, wide)[:-1] for doc, text in rows]  # the writer adds the end byte
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return frames


def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int, shards: int | None = None) -> None:
    """Writes docs (doc_id, text), encoded with an end id each, as shards in ascending doc_id order, and their index.

    Null texts count as empty, null doc_ids come first, repeated rows are all written (in any order among one
    doc_id's rows, which may fill several shards); other columns are ignored. An empty table gives an empty index. There are
    `shards` shards, or as many as Spark shuffles to, or more if these would hold over SHARD_BYTES of text on average; the
    table's own estimate of its size tells, or, where it has none, a sum over the texts. A single text must stay well
    below 2 GB, as in Spark itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_size(rows) // SHARD_BYTES))
    tie = [F.xxhash64("text"), F.spark_partition_id()]  # rows of one doc_id are dealt by these
    ordered = rows.repartitionByRange(shards, "doc_id", *tie).sortWithinPartitions("doc_id")
    ordered.mapInArrow(_framed(tokenizer, end), "record binary").select(F.col("record").cast("string")).write.text(f"{folder}/data")
    found = written(_shards(spark, folder).mapInArrow(_scan, "shard long, record long, offset long, length long, doc_id long, n_tokens long"), "record-offsets")
    _with_starts(found).write.parquet(f"{folder}/index")


def _size(rows: DataFrame) -> int:
    """Bytes of the texts, about: compressed files are taken to hold three times their size."""
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 3 * estimate if estimate < 1 << 60 else rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    shard = F.regexp_extract("path", r"part-([0-9]+)[^/]*$", 1).cast("long")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select(shard.alias("shard"), "content")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    for batch in batches:
        for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
            data, at, found = memoryview(content.as_buffer()), 0, []
            while at < len(data):
                payload, to = unframe(data, at)
                found.append((at, payload))
                at = to
            yield shard, found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, found in _records(batches):
        docs = [ids_of(p) for _, p in found]
        columns = [[shard] * len(found), range(len(found)), [at for at, _ in found], [len(p) for _, p in found], [d for d, _ in docs], [len(i) for _, i in docs]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["shard", "record", "offset", "length", "doc_id", "n_tokens"])


def _with_starts(index: DataFrame) -> DataFrame:
    """Adds start, the tokens before each record: sums within shards, within blocks of shards, and over blocks."""
    block = F.floor(F.col("shard") / SHARDS_A_BLOCK)
    none = F.lit(0).cast("long")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", block)
    in_block = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), none)
    blocks = shards.groupBy("block").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), none))
    bases = shards.withColumn("in_block", in_block).join(blocks.select("block", "base"), "block").select("shard", (F.col("base") + F.col("in_block")).alias("shard_start"))
    in_shard = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)), none)
    return index.withColumn("in_shard", in_shard).join(bases, "shard").select("shard", "record", "offset", "length", (F.col("shard_start") + F.col("in_shard")).alias("start"), "doc_id", "n_tokens")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, found in _records(batches):
        docs = [ids_of(p) for _, p in found]
        columns = [pa.array([shard] * len(found), pa.int64()), pa.array([at for at, _ in found], pa.int64()), pa.array([d for d, _ in docs], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([i.astype("<u4").tobytes() for _, i in docs], pa.binary())], ["shard", "offset", "doc_id", "ids"])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, offset, doc_id, ids) of all records, checksums verified; ids are little-endian unsigned 32-bit numbers."""
    return _shards(spark, folder).mapInArrow(_sequences, "shard long, offset long, doc_id long, ids binary")


def _sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, content, wanted in zip(batch.column("shard").to_pylist(), batch.column("content"), batch.column("wanted").to_pylist(), strict=True):
            data = memoryview(content.as_buffer())
            for at in range(0, len(wanted), 4096):
                part = wanted[at : at + 4096]
                docs = [ids_of(unframe(data, w["offset"])[0]) for w in part]
                columns = [pa.array([shard] * len(part), pa.int64()), pa.array([w["offset"] for w in part], pa.int64()), pa.array([w["order"] for w in part], pa.int64()), pa.array([d for d, _ in docs], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([i.astype("<u4").tobytes() for _, i in docs], pa.binary())], ["shard", "offset", "order", "doc_id", "ids"])


def _seek(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Records at (shard, offset, order), by jumping there; a row a shard is joined, not a row a record."""
    places = wanted.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("offset", "order"))).alias("wanted"))
    return _shards(spark, folder).join(places, "shard").mapInArrow(_sought, "shard long, offset long, order long, doc_id long, ids binary")


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(shard, offset, doc_id, ids) of the records at wanted (shard, offset), rows of the index; no other record is read or checked."""
    return _seek(spark, folder, wanted.select("shard", "offset", F.lit(0).cast("long").alias("order"))).drop("order")


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """All records in a random order that the seed fixes: the index is shuffled, and its places are read from the shards."""
    order = read_index(spark, folder).select("shard", "offset", F.xxhash64("shard", "offset", F.lit(seed)).alias("order"))
    return _seek(spark, folder, order).orderBy("order", "shard", "offset").drop("order")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, found in _records(batches):
        docs = [ids_of(p) for _, p in found]
        columns = [[shard] * len(found), [at for at, _ in found], [d for d, _ in docs], [len(i) for _, i in docs], [crc32(i.astype("<u4").tobytes()) for _, i in docs]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "offset", "doc_id", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all records, read back from the shards; start is the index's."""
    read = _shards(spark, folder).mapInArrow(_digested, "shard long, offset long, doc_id long, n_tokens long, ids_crc32 long")
    return read.join(read_index(spark, folder).select("shard", "offset", "start"), ["shard", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")
