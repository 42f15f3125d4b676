"""Polling a feed: new filings are read, parsed and stored a batch at a time, each item apart from the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwind.functions.stored import stored
from ledgerwind.sources import filings
from ledgerwind.sources.feeds import FeedPages
from ledgerwind.sources.prices import exists

def stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FeedPages)
    return spark.readStream.format("feed_pages").option("path", path).load()


def poll(spark: SparkSession, pages: str, documents: DataFrame, folder: str, checkpoint: str) -> None:
    """Reads the pages that are new since the last poll and stores their filings under a folder; ends when no page is left.

    documents (accession, xml) are the filings' texts. Tables, each with a folder a batch: `filings` (accession, form,
    accepted_at, url, cik, page, position, document_type), `lines` as filings.document_lines() has them, and `rejects` (page,
    position, accession, fault) of entries, pages and documents that can't be used. A rejected filing isn't stored, so it is
    tried again if the feed still has it. A batch that is run again after a failure overwrites its own folders only, and is
    compared with the earlier ones, so nothing is lost or doubled.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = stored(rows, "entries")
        new = filings.first_entries(rows)
        if number and exists(spark, f"{folder}/filings"):
            new = new.join(spark.read.parquet(f"{folder}/filings").filter(F.col("batch") < number).select("accession"), "accession", "left_anti")
        parsed = stored(filings.parsed_documents(new.join(documents, "accession", "left")), "polled")
        faulty = rows.filter("fault is not null and (fault = 'malformed page' or form in ('4', '4/A'))").select("page", "position", "accession", "fault")
        rejects = faulty.unionByName(parsed.filter("fault is not null").select("page", "position", "accession", "fault"))
        good = parsed.filter("fault is null")
        rejects.write.mode("overwrite").parquet(f"{folder}/rejects/batch={number}")
        filings.document_lines(parsed).write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")
        good.select("accession", "form", "accepted_at", "url", "cik", "page", "position", F.col("doc.documentType").alias("document_type")).write.mode("overwrite").parquet(f"{folder}/filings/batch={number}")

    stream(spark, pages).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
