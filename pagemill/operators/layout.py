"""Positions for text that has none, lines from words, and box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "struct<text:string,y0:double,size:double>"


def lines(text: Column) -> Column:
    """Blocks of a text's lines, from y 50 down: a blank line takes 15, another its font size and 4; short lines above 100 are headings."""
    start = F.struct(F.lit(50.0).alias("y"), F.array().cast(f"array<{_BLOCK}>").alias("blocks"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
        size = F.when((F.length(line) < 60) & (acc["y"] < 100), 16.0).otherwise(11.0)
        own = F.struct(line.alias("text"), acc["y"].alias("y0"), size.alias("size"))
        return F.when(line == "", F.struct((acc["y"] + 15.0).alias("y"), acc["blocks"].alias("blocks"))).otherwise(F.struct((acc["y"] + size + 4.0).alias("y"), F.concat(acc["blocks"], F.array(own)).alias("blocks")))

    return F.aggregate(F.split(text, "\n"), start, step)["blocks"]


def blocks(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    each = pages.select("document_id", "page_number", F.posexplode(lines(F.col(text))).alias("block_no", "b"))
    return each.select(
        "document_id", "page_number", "block_no", "b.text", F.lit(50.0).alias("x0"), F.col("b.y0").alias("y0"), F.lit(550.0).alias("x1"), (F.col("b.y0") + F.col("b.size")).alias("y1"),
        F.col("b.size").alias("font_size"), F.when(F.col("b.size") > 14, "heading").otherwise("text").alias("block_type"),
    )


def word_lines(words: Column, gap: float = 3.0) -> Column:
    """Lines from words (struct x0, y0, x1, y1, text) sorted by top: a line ends when a top is more than gap from its first word's."""
    start = F.array().cast("array<array<struct<y0:double,x0:double,x1:double,y1:double,text:string>>>")
    order = F.array_sort(F.transform(words, lambda w: F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["text"].alias("text"))))

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.abs(w["y0"] - F.element_at(last, 1)["y0"]) <= gap)
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(w))))).otherwise(F.concat(acc, F.array(F.array(w))))

    return F.transform(F.aggregate(order, start, step), union)


def union(boxes: Column) -> Column:
    """The box around boxes, with their texts in order."""
    ext = lambda f, k: f(F.transform(boxes, lambda b: b[k])).alias(k)
    return F.struct(F.array_join(F.transform(boxes, lambda b: b["text"]), " ").alias("text"), ext(F.array_min, "x0"), ext(F.array_min, "y0"), ext(F.array_max, "x1"), ext(F.array_max, "y1"))


def centred(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corner box from centre and size, clamped to the page."""
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return F.struct(clamp(cx - w / 2, width).alias("x0"), clamp(cy - h / 2, height).alias("y0"), clamp(cx + w / 2, width).alias("x1"), clamp(cy + h / 2, height).alias("y1"))


def mean_confidence(confidence: Column, text: Column) -> Column:
    """Aggregate: mean confidence (0 to 1) of words that are not blank; -1 counts as 0."""
    return F.avg(F.when(F.trim(text) != "", F.greatest(confidence, F.lit(0)) / 100))


def page_facts(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return pages.select("document_id", "page_number", (n > 10).alias("has_text"), F.when(n > 100, 0.8).when(n > 10, 0.3).otherwise(0.0).alias("text_share"), F.coalesce("width", F.lit(612.0)).alias("width"), F.coalesce("height", F.lit(792.0)).alias("height"))


def needs_ocr(text: Column, forced: bool = False) -> Column:
    return F.lit(True) if forced else F.length(F.trim(F.coalesce(text, F.lit("")))) < 30


def kept_text(native: Column, ocr: Column, forced: bool = False) -> Column:
    longer = F.length(F.coalesce(ocr, F.lit(""))) > F.length(F.coalesce(native, F.lit("")))
    return F.when(F.coalesce(ocr, F.lit("")) == "", native).when(F.lit(forced) | longer, ocr).otherwise(native)
