"""Section categories named in page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of names, words of headings, words of table columns.
PATTERNS = [r"Class\s*\d+\s*[-–]\s*Section\s*[A-Za-z0-9]+", r"Class\s*\d+", r"Grade\s*\d+", r"Section\s*[A-Za-z0-9]+", r"Department\s*[:of]*\s*[A-Za-z\s]+"]
HEADING_WORDS = ["report", "summary", "distribution", "details", "list", "roster", "records", "schedule"]
COLUMN_WORDS = ["class", "section", "department", "category", "type", "status"]


def named(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """document_id, page_number, name, confidence, ord (order of detection within the page)."""
    found = F.concat(*[F.transform(F.regexp_extract_all(F.col(text), F.lit(f"(?iuU){p}"), F.lit(0)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) for p in PATTERNS])
    out = pages.select("document_id", "page_number", F.posexplode(found).alias("ord", "name"))
    return out.select("document_id", "page_number", "name", F.lit(0.8).alias("confidence"), "ord")


def headings(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    lines = pages.select("document_id", "page_number", F.posexplode(F.split(text, "\n")).alias("ord", "line")).withColumn("name", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    word = None
    for w in HEADING_WORDS:
        word = F.lower("name").contains(w) if word is None else word | F.lower("name").contains(w)
    out = lines.where((F.length("name") > 4) & (F.length("name") < 50) & (T.is_title(F.col("name")) | T.is_upper(F.col("name"))) & word)
    return out.select("document_id", "page_number", "name", F.lit(0.75).alias("confidence"), (F.col("ord") + 100_000).alias("ord"))


def large_print(blocks: DataFrame) -> DataFrame:
    """From positioned blocks: large and short texts."""
    out = blocks.where((F.col("font_size") > 14) & (F.length("text") < 100) & (F.trim("text") != ""))
    return out.select("document_id", "page_number", F.trim("text").alias("name"), F.lit(0.7).alias("confidence"), (F.col("y0").cast("int") + 200_000).alias("ord"))


def from_columns(tables: DataFrame) -> DataFrame:
    """'Header: value' for the values of columns whose header names a kind of category."""
    each = tables.select("document_id", "page_number", F.posexplode("headers").alias("i", "header"), "rows")
    hit = F.exists(F.array(*[F.lit(w) for w in COLUMN_WORDS]), lambda w: F.contains(F.lower("header"), w))
    cells = each.where(hit).select("document_id", "page_number", "header", F.explode(F.transform("rows", lambda r: F.trim(F.get(r, F.col("i"))))).alias("v"))
    return cells.where("v <> ''").select("document_id", "page_number", F.concat("header", F.lit(": "), "v").alias("name"), F.lit(0.9).alias("confidence")).distinct()


def merge(found: DataFrame) -> DataFrame:
    """One category for each document and lower-cased name: the first spelling, all pages, the highest confidence."""
    at = F.struct("page_number", "ord")
    out = found.groupBy("document_id", F.lower("name").alias("key")).agg(F.min_by("name", at).alias("name"), F.array_sort(F.collect_set("page_number")).alias("pages"), F.max("confidence").alias("confidence"), F.min(at).alias("first"))
    return out.drop("key")


def detect(pages: DataFrame, blocks: DataFrame | None = None, text: str = "raw_text") -> DataFrame:
    found = named(pages, text).unionByName(headings(pages, text))
    return merge(found if blocks is None else found.unionByName(large_print(blocks)))
