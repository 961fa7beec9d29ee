"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; a row's place in its source, as a fraction, places it in the
whole; the sequence is then cut into shards of equal row counts. Every contiguous cut holds each source in
its proportion (to within one row of each source). The fractions of a source begin
at a place that follows from its name: so the many sources of one row or two do not all meet in the same places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Rows in a cell of (source, bucket) and in a slice of the final order, about; never more slices than MOST.
CELL_ROWS = 100_000
LEAST, MOST = 256, 65_536


def interleave(docs: DataFrame, shards: int, seed: str = "shard", source: str = "source", row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: row_id, source, size, text_crc32, shard (from 0) and slot (gapless from 0 in its shard).

    Null and empty texts have size 16 (no bytes) and CRC-32 0; null sources form one source; repeated rows and
    ids each keep a place of their own; very long texts count whole; rows that tie in fraction are in order of their source,
    then of their shuffled key; an empty table gives an empty result; other columns are ignored, whatever they are called.
    """
    rows = docs.select(
        F.col(row_id).alias("row_id"),
        F.col(source).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("text_crc32"),
    )
    rows = shared.cut(rows.withColumn("h", shared.seeded_key(seed, F.col("row_id"), F.col("text_crc32"))), "shard")
    n = rows.count()
    cells = min(MOST, max(LEAST, n // CELL_ROWS))
    rows = rows.withColumns({"bucket": shared.key_bucket(F.col("h"), cells), "s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(), "one": F.lit(1)})
    tie = ["none", "s", "h", "row_id", "size"]
    ranked = shared.prefix_within(rows, ["s", "none"], "bucket", ["h", "row_id", "size"], "one")
    named = F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("none"), F.lit("null")).otherwise(F.concat(F.lit("source:"), "s"))))
    begin = F.conv(F.substring(named, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    placed = ranked.withColumn("f", (F.col("rank") - 1 + begin) / F.col("key_rows")).withColumn("slice", F.floor(F.col("f") * cells).cast("int"))
    # The table of slices has at most MOST rows, whatever the input.
    counts = placed.groupBy("slice").agg(F.count("*").alias("n"))
    starts = counts.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    local = placed.withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy("f", *tie)))
    at = F.col("n0") + F.col("r") - 1
    out = local.join(F.broadcast(starts), "slice").withColumn("at", at).withColumn("shard", F.floor(F.col("at") * shards / F.lit(max(n, 1))).cast("int"))
    first = F.ceil(F.col("shard") * F.lit(n) / shards)
    return out.select(F.col("row_id").alias(row_id), "source", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))
