"""Pages to records: routing, extraction, categories, index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cards, categories, fulltext, relational, tables

MODES = ("auto", "voter_list", "table", "form")


def routed(pages: DataFrame, mode: str = "auto", text: str = "raw_text") -> DataFrame:
    """pages with is_cards: pages of cards are not searched for tables or forms."""
    is_cards = {"voter_list": F.lit(True), "auto": cards.is_card_page(F.col(text))}.get(mode, F.lit(False))
    return pages.withColumn("is_cards", is_cards)


def records(pages: DataFrame, mode: str = "auto", blocks: DataFrame | None = None) -> DataFrame:
    """document_id, page_number, data, source_text and origin (card, table, form)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {MODES}")
    # Stored in composed form, as searches and patterns expect it.
    way = routed(T.composed(pages, ("raw_text",)), mode)
    columns = ["document_id", "page_number", "data", "source_text"]
    plain = way.where("NOT is_cards")
    parts = [(cards.extract(way.where("is_cards"), blocks), "card"), (tables.records(tables.detect(plain)), "table"), (cards.form_records(plain), "form")]
    out = [df.select(*columns, F.lit(o).alias("origin")) for df, o in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def run(pages: DataFrame, mode: str = "auto") -> dict[str, DataFrame]:
    """Tables of a workspace from its pages: records (with ids and categories), categories and the search index."""
    pages = T.composed(pages, ("raw_text", "processed_text"))
    # In the order of detection: by page, then as found on it.
    found = categories.detect(pages).withColumn("id", F.xxhash64("document_id", F.lower("name"))).withColumn("ord", F.col("first"))
    rows = records(pages, mode).withColumn("id", F.xxhash64("document_id", "page_number", "origin", "source_text", F.to_json("data")))
    rows = relational.assign_categories(rows, found.select("document_id", "id", "ord", "name", "pages"))
    names = found.select("id", "document_id", "name")
    return {"records": rows, "categories": names, "index": fulltext.build(rows, pages, names)}
