"""Cards of pages of any length: lines as rows, in chunks that carry their state on.

cards.sequential has a page's lines in one array. Here a page is cut into chunks of lines, which are worked through side by
side; what one chunk has to know of those before it (their last line, how many cards they begin) comes from a table with a row
for each chunk. No task holds more than a chunk, or the lines of a card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions import text as T
from . import cards

#: Lines in a chunk.
CHUNK = 10_000
_KEYS = ["document_id", "page_number"]


def page_lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """document_id, page_number, line_no (from 0) and line of all lines that are not blank, without white space at their ends."""
    each = pages.select(*_KEYS, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("line_no", "line"))
    return each.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")


def numbered_runs(lines: DataFrame, begins: Column) -> DataFrame:
    """lines (written files) with run: how many lines of the page, up to this one, begin a run; and runs, those of the whole page.

    begins is a condition on line and before, the line before it on its page (null for the first).
    """
    spark = lines.sparkSession
    own = lines.withColumn("chunk", F.floor(F.col("line_no") / CHUNK))
    within = Window.partitionBy(*_KEYS, "chunk").orderBy("line_no")
    over = Window.partitionBy(*_KEYS).orderBy("chunk")
    last = own.groupBy(*_KEYS, "chunk").agg(F.max_by("line", "line_no").alias("last"))
    carried = last.select(*_KEYS, "chunk", F.lag("last").over(over).alias("carried"))
    marked = own.withColumn("before", F.lag("line").over(within)).join(carried, [*_KEYS, "chunk"])
    marked = marked.withColumn("before", F.coalesce("before", "carried")).withColumn("begins", F.coalesce(begins, F.lit(False)).cast("long"))
    at = storage.scratch(spark, "marked")
    marked.select(*lines.columns, "chunk", "begins").write.parquet(at)
    marked = spark.read.parquet(at)
    sums = marked.groupBy(*_KEYS, "chunk").agg(F.sum("begins").alias("own"))
    earlier = F.coalesce(F.sum("own").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*_KEYS, "chunk", earlier.alias("earlier"), F.sum("own").over(Window.partitionBy(*_KEYS)).alias("runs"))
    out = marked.withColumn("run", F.sum("begins").over(within)).join(sums, [*_KEYS, "chunk"])
    return out.withColumn("run", F.col("run") + F.col("earlier")).select(*lines.columns, "run", "runs")


def sequential(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """What cards.sequential finds: document_id, page_number, card_no, data, source_text. A page on which no card begins is read as one."""
    spark = pages.sparkSession
    at = storage.scratch(spark, "page-lines")
    page_lines(pages, text).write.parquet(at)
    lines = numbered_runs(spark.read.parquet(at), cards.begins(F.col("line"), F.col("before")))
    whole = lines.where("runs > 0").select(*_KEYS).distinct()
    each = lines.where("run > 0").groupBy(*_KEYS, "run").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("chunk"), F.first("runs").alias("cards"))
    each = each.withColumn("card_no", (F.col("run") - 1).cast("int")).withColumn("data", cards.card_fields(F.col("chunk")))
    found = cards.is_card(F.col("data"), F.col("cards"))
    out = each.where(found).select(*_KEYS, "card_no", "data", T.normalize(F.substr(F.col("chunk"), F.lit(1), F.lit(200))).alias("source_text"))
    return out.unionByName(cards.sequential(pages.join(whole, _KEYS, "left_anti"), text))
