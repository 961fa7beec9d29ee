"""A folder of page tables as a stream: each batch goes through the same extraction, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import ingest

PAGE_SCHEMA = "document_id bigint, page_number int, raw_text string"


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, mode: str = "auto", once: bool = True) -> StreamingQuery:
    """Extracts records of new page files; a batch overwrites its own folder, so a repeated batch leaves no duplicates."""

    def batch(pages: DataFrame, number: int) -> None:
        ingest.records(pages, mode).write.mode("overwrite").parquet(f"{out}/records/batch={number}")

    stream = spark.readStream.schema(PAGE_SCHEMA).parquet(inbox).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and type with a watermark: works on a stream and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
