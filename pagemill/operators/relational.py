"""Filters, joins, aggregates and rewrites over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SORTS = ("page_number", "created_at", "updated_at")
#: Columns that a grid can have beside the standard ones.
MOST_COLUMNS = 2_000


def with_category(records: DataFrame, categories: DataFrame, default: str = "") -> DataFrame:
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return records.join(names, "category_id", "left").withColumn("category_name", F.coalesce("category_name", F.lit(default)))


def by_id(df: DataFrame, key, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == key)


def page(pages: DataFrame, document_id: int, number: int) -> DataFrame:
    return pages.where((F.col("document_id") == document_id) & (F.col("page_number") == number)).limit(1)


def of_document(records: DataFrame, document_id=None, category_id=None, page_number=None, sort_by: str | None = None, descending: bool = False, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Records by optional conditions; an unknown sort falls back to rising pages; an offset counts only with a limit."""
    for column, value in (("document_id", document_id), ("category_id", category_id), ("page_number", page_number)):
        if value is not None:
            records = records.where(F.col(column) == value)
    known = sort_by in SORTS
    order = F.col(sort_by if known else "page_number")
    out = records.orderBy(order.desc() if descending and known else order.asc(), "id")
    if limit is not None:
        out = (out.offset(offset) if offset else out).limit(limit)
    return out


def by_ids(records: DataFrame, ids: list | DataFrame) -> DataFrame:
    """In page order; a list of ids becomes an IN filter, a table of ids a semi join."""
    out = records.join(ids, "id", "left_semi") if isinstance(ids, DataFrame) else records.where(F.col("id").isin(*ids) if ids else F.lit(False))
    return out.orderBy("page_number", "id")


def like(records: DataFrame, query: str, document_id: int | None = None) -> DataFrame:
    """Rows whose source or values are LIKE %query%, ASCII letters in either case; % and _ stay wildcards."""
    pattern = f"%{_ascii_lower(query)}%"
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = low(F.col("source_text")).like(pattern) | F.exists(F.map_values("data"), lambda v: low(v).like(pattern))
    out = records.where(F.coalesce(hit, F.lit(False)))
    return out if document_id is None else out.where(F.col("document_id") == document_id)


def _ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def filtered(records: DataFrame, filters: dict, corrections: DataFrame | None = None) -> DataFrame:
    """All of: category_id, page_number, page_range (both ends), has_corrections, search (query, scope), fields (equal, any case)."""
    f = dict(filters)
    for column in ("document_id", "category_id", "page_number"):
        if f.get(column) is not None:
            records = records.where(F.col(column) == f[column])
    if f.get("page_range"):
        lo, hi = f["page_range"]
        records = records.where(F.col("page_number").between(1 if lo is None else lo, 9999 if hi is None else hi))
    if f.get("has_corrections") and corrections is not None:
        records = records.join(corrections.select(F.col("record_id").alias("id")), "id", "left_semi")
    if f.get("search"):
        from . import search

        query, scope = f["search"]
        records = records.where(search.score(F.col("data"), F.col("source_text"), query, scope).isNotNull())
    for key, value in (f.get("fields") or {}).items():
        records = records.where(F.lower(F.col("data")[key]) == str(value).lower())
    return records.orderBy("page_number", "id")


def field_names(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.map_keys("data")).alias("field")).distinct().orderBy("field")


def children(categories: DataFrame) -> DataFrame:
    """Each category with its children's names, in order."""
    kids = categories.select(F.col("parent_id").alias("id"), F.col("name").alias("child"))
    return categories.join(kids, "id").select("id", "name", "child")


def category_counts(categories: DataFrame, records: DataFrame) -> DataFrame:
    n = records.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))
    return categories.join(n, "id", "left").withColumn("record_count", F.coalesce("n", F.lit(0))).drop("n")


def first_seen_groups(records: DataFrame, order: str = "id") -> DataFrame:
    """Categories (null is one) by first appearance, with their sizes."""
    return records.groupBy("category_id").agg(F.count("*").alias("records"), F.min(order).alias("first")).orderBy("first")


def grid(records: DataFrame, categories: DataFrame, standard: list[str]) -> DataFrame:
    """Standard columns, then all other keys in order (but those that begin with _); missing values are ''.

    As columns: at most MOST_COLUMNS of them, beyond which grid_cells() has the same as rows."""
    found = field_names(records).where(~F.col("field").startswith("_") & ~F.col("field").isin(*standard))
    keys = [r[0] for r in found.limit(MOST_COLUMNS + 1).collect()]
    if len(keys) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} different keys: these are data, not columns")
    cells = [F.coalesce(F.col("data")[k], F.lit("")).alias(k) for k in [*standard, *keys]]
    return with_category(records, categories).select("id", "page_number", "category_name", *cells)


def grid_cells(records: DataFrame, categories: DataFrame, standard: list[str]) -> DataFrame:
    """The grid in long form, for any number of keys: id, page_number, category_name, place, key and value of each cell.

    The standard keys of every record come first, '' where missing; then its own other keys in order, but those that begin with _.
    """
    own = F.coalesce("data", F.create_map().cast("map<string,string>"))
    extra = F.array_sort(F.filter(F.map_keys(own), lambda k: ~k.startswith("_") & ~k.isin(*standard)))
    keys = F.concat(F.array(*[F.lit(k) for k in standard]).cast("array<string>"), extra)
    rows = with_category(records.withColumn("data", own).withColumn("_keys", keys), categories)
    each = rows.select("id", "page_number", "category_name", "data", F.posexplode("_keys").alias("place", "key"))
    return each.select("id", "page_number", "category_name", "place", "key", F.coalesce(F.col("data")[F.col("key")], F.lit("")).alias("value"))


def grid_order(df: DataFrame, column: str) -> DataFrame:
    """Numeric order if every cell is a number (blank is lowest), else by lower-cased text; adds position."""
    blank = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    number = F.when(blank == "", -999999.0).otherwise(blank.try_cast("double"))
    numeric = df.agg(F.bool_and(number.isNotNull())).first()[0]
    key = number if numeric else F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return df.withColumn("sort_key", key).orderBy("sort_key")


def grid_text_order(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """The plain order of a small screen's grid: cells as texts, missing ones as ''."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return df.withColumn("sort_key", key).orderBy(F.col("sort_key").desc() if descending else F.col("sort_key").asc())


def statistics(documents: DataFrame, pages: DataFrame, records: DataFrame) -> DataFrame:
    parts = [d.agg(F.lit(n).alias("what"), F.count("*").alias("n")) for n, d in (("documents", documents), ("pages", pages), ("records", records))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def text_size(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """words and characters of all pages."""
    c = F.coalesce(F.col(text), F.lit(""))
    return pages.agg(F.coalesce(F.sum(F.regexp_count(c, F.lit(r"(?U)\S+"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length(c)), F.lit(0)).alias("characters"))


def counts_by_document(records: DataFrame, category_id=None) -> DataFrame:
    own = records if category_id is None else records.where(F.col("category_id") == category_id)
    return own.groupBy("document_id").agg(F.count("*").alias("n"))


def documents_of(rows: DataFrame) -> DataFrame:
    return rows.select("document_id").distinct()


def page_outcomes(pages: DataFrame) -> DataFrame:
    """document_id, total, failed, success and the message of a finished import; a page with an error has failed."""
    out = pages.groupBy("document_id").agg(F.count("*").alias("total"), F.count("error").alias("failed")).withColumn("success", F.col("total") - F.col("failed"))
    shown = F.format_string("Complete - %d/%d pages processed", "success", "total")
    return out.withColumn("message", F.when(F.col("failed") > 0, F.concat(shown, F.format_string(" (%d failed)", "failed"))).otherwise(shown))


def of_parent(rows: DataFrame, parent: str, key, newest: str | None = None) -> DataFrame:
    """Boxes, tables or corrections of one parent: by id, or the newest first."""
    own = rows.where(F.col(parent) == key)
    return own.orderBy(F.col(newest).desc(), F.col("id").desc()) if newest else own.orderBy("id")


def stored_order(rows: DataFrame, kind: str) -> DataFrame:
    """documents: last changed first; categories: by place and name; pages: by document and number."""
    orders = {"documents": [F.col("updated_at").desc(), F.col("id")], "categories": [F.col("sort_order"), F.col("name")], "pages": [F.col("document_id"), F.col("page_number")]}
    return rows.orderBy(*orders[kind])


def box_for_text(boxes: DataFrame, page_id, text: str) -> DataFrame:
    """The first box of a page whose text is LIKE %text%, ASCII letters in either case."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return boxes.where((F.col("page_id") == page_id) & low.like(f"%{_ascii_lower(text)}%")).orderBy("id").limit(1)


def panel_filters(categories: DataFrame, panel: dict) -> dict:
    """filtered()'s conditions from a panel's: a category by name, a page range with open ends."""
    out = {k: v for k, v in panel.items() if k not in ("category", "page_from", "page_to")}
    if panel.get("category"):
        row = categories.where(F.col("name") == panel["category"]).orderBy("id").select("id").first()
        out["category_id"] = row[0] if row else -1
    if panel.get("page_from") is not None or panel.get("page_to") is not None:
        out["page_range"] = (panel.get("page_from"), panel.get("page_to"))
    return out


def editor_view(records: DataFrame, confidence: str = "confidence", sure: float = 0.8) -> DataFrame:
    """id, place, field, value and low_confidence of each field that an editor shows: no id, no key that begins with _.

    confidence names a map column (field to a number from 0 to 1); fields without a number count as certain.
    """
    each = records.select("id", confidence, F.posexplode("data").alias("place", "field", "value"))
    own = F.coalesce(F.col(confidence)[F.col("field")], F.lit(1.0))
    return each.where((F.col("field") != "id") & ~F.col("field").startswith("_")).select("id", "place", "field", "value", (own < sure).alias("low_confidence"))


def first_occurrence(hits: DataFrame, keys: tuple[str, ...] = ("document_id", "page_number", "record_id"), order: str = "result_no") -> DataFrame:
    """The first hit of each place (a null record is a place of its own)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return hits.withColumn("_n", n).where("_n = 1").drop("_n")


def neighbours(hits: DataFrame, order: str = "result_no") -> DataFrame:
    """Hits with the numbers of the next and the previous one; the last is followed by the first."""
    n = F.count("*").over(Window.partitionBy())
    return hits.withColumn("_n", n).withColumns({"next_no": (F.col(order) % F.col("_n") + 1).cast("int"), "previous_no": ((F.col(order) + F.col("_n") - 2) % F.col("_n") + 1).cast("int")}).drop("_n")


def update(df: DataFrame, ids: list, changes: dict[str, object], stamp: Column | None = None) -> DataFrame:
    hit = F.col("id").isin(*ids)
    out = df.withColumns({k: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, v in changes.items()})
    return out.withColumn("updated_at", F.when(hit, F.current_timestamp() if stamp is None else stamp).otherwise(F.col("updated_at"))) if "updated_at" in df.columns else out


def delete(df: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in gone: for a table, and for every table that it cascades to."""
    return df.join(gone, on, "left_anti")


def detach(df: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """All rows; a reference to a row of gone becomes null."""
    lost = gone.select(F.col(on)).distinct().withColumn("_gone", F.lit(True))
    return df.join(lost, on, "left").withColumn(on, F.when(F.col("_gone").isNull(), F.col(on))).select(*df.columns)


def move(records: DataFrame, ids: list, category_id) -> DataFrame:
    return records.withColumn("category_id", F.when(F.col("id").isin(*ids), F.lit(category_id)).otherwise(F.col("category_id")))


def merge_categories(records: DataFrame, categories: DataFrame, sources: list, target) -> tuple[DataFrame, DataFrame]:
    """Records of the sources go to the target, sources go; a target among the sources goes too, and its records lose theirs."""
    lost = target in sources
    to = F.lit(None).cast(records.schema["category_id"].dataType) if lost else F.lit(target)
    moved = records.withColumn("category_id", F.when(F.col("category_id").isin(*sources), to).otherwise(F.col("category_id")))
    return moved, category_counts(categories.where(~F.col("id").isin(*sources)), moved)


def corrections(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each field that differs between two versions of records (id, data)."""
    both = old.select("id", F.col("data").alias("was")).join(new.select("id", "data"), "id")
    keys = F.array_distinct(F.concat(F.map_keys("was"), F.map_keys("data")))
    out = both.select("id", F.explode(keys).alias("field_name"), "was", "data")
    a, b = F.coalesce(F.col("was")[F.col("field_name")], F.lit("")), F.coalesce(F.col("data")[F.col("field_name")], F.lit(""))
    return out.where(a != b).select(F.col("id").alias("record_id"), "field_name", a.alias("original_value"), b.alias("corrected_value"))


def apply_edits(records: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, log) after an editor's changes (id, data, category_id): values are trimmed, every field that differs is
    logged, and the record gets the new data and category and is marked as edited."""
    trimmed = edits.select("id", F.transform_values("data", lambda k, v: F.trim(F.coalesce(v, F.lit("")))).alias("_data"), F.col("category_id").alias("_category"))
    log = corrections(records, trimmed.select("id", F.col("_data").alias("data")))
    hit = F.col("_data").isNotNull()
    out = records.join(trimmed, "id", "left").withColumns({"data": F.when(hit, F.col("_data")).otherwise(F.col("data")), "category_id": F.when(hit, F.col("_category")).otherwise(F.col("category_id"))})
    edited = F.when(hit, 1).otherwise(F.col("is_edited") if "is_edited" in records.columns else F.lit(0))
    return out.withColumn("is_edited", edited.cast("int")).drop("_data", "_category"), log


def blank_row(records: DataFrame, document_id: int, page_number: int, category_id=None) -> DataFrame:
    """A record to append by hand: all of the document's keys with '' (name, roll_no and class if it has none), id after the last."""
    own = records.where(F.col("document_id") == document_id)
    keys = own.select(F.explode(F.map_keys("data")).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("keys"))
    last = records.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    names = F.when(F.size("keys") > 0, F.col("keys")).otherwise(F.array(*[F.lit(k) for k in ("name", "roll_no", "class")]))
    row = keys.select(names.alias("keys")).withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one")
    return row.select(
        (F.col("last") + 1).cast("long").alias("id"), F.lit(document_id).cast("long").alias("document_id"), F.lit(page_number).cast("int").alias("page_number"), F.lit(category_id).cast("long").alias("category_id"),
        F.map_from_arrays("keys", F.transform("keys", lambda k: F.lit(""))).alias("data"), F.lit("Manually added record").alias("source_text"),
    )


def overlay(records: DataFrame, payload: DataFrame) -> DataFrame:
    """Records with the payload's keys put over theirs; standard columns cannot be overlaid."""
    safe = F.map_filter("payload", lambda k, v: ~k.isin("id", "page_number", "category_id", "is_edited"))
    keep = F.map_filter("data", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(safe), k), F.lit(False)))
    return records.join(payload, "id", "left").withColumn("data", F.when(F.col("payload").isNull(), F.col("data")).otherwise(F.map_concat(keep, safe))).drop("payload")


def upsert(meta: DataFrame, news: DataFrame) -> DataFrame:
    return meta.join(news, "key", "left_anti").unionByName(news)


#: Characters of values, and names, that one task compares at once, about.
VALUES_AT_ONCE, NAMES_AT_ONCE = 8 << 20, 20_000


def names_within(values: DataFrame, names: DataFrame) -> DataFrame:
    """record and category: of the names (document_id, category, name, place) of a record's document that its text (document_id,
    record, values) holds, that with the highest place; records that hold none are left out.

    A document's names make one automaton, which reads a text once, whatever their number. Documents with many records, or
    names, are dealt to several tasks, each with a part of either.
    """
    import pyarrow as pa

    size = values.groupBy("document_id").agg(F.ceil(F.sum(F.length("values") + 1) / VALUES_AT_ONCE).cast("int").alias("value_parts"))
    number = names.groupBy("document_id").agg(F.ceil(F.count("*") / NAMES_AT_ONCE).cast("int").alias("name_parts"))
    parts = size.join(number, "document_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = values.join(parts, "document_id").select("document_id", deal("record", "value_parts").alias("v"), every("name_parts").alias("n"), "record", "values")
    right = names.join(parts, "document_id").select(F.col("document_id").alias("of"), every("value_parts").alias("with_v"), deal("category", "name_parts").alias("with_n"), "category", "name", "place")
    record, category = (df.schema[c].dataType.simpleString() for df, c in ((values, "record"), (names, "category")))

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        import ahocorasick

        best: dict[str, int] = {}
        places = dict(zip(own["place"].to_pylist(), range(own.num_rows), strict=True))
        for name, place in zip(own["name"].to_pylist(), own["place"].to_pylist(), strict=True):
            best[name] = max(place, best.get(name, -1))
        always, find = best.pop("", -1), ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, place in best.items():
            find.add_word(name, place)
        if best:
            find.make_automaton()
        rows, found = [], []
        for i, text in enumerate(texts["values"].to_pylist()):
            place = max((p for _, p in find.iter(text)), default=-1) if best else -1
            if max(place, always) >= 0:
                rows.append(i)
                found.append(max(place, always))
        chosen = own["category"].take(pa.array([places[p] for p in found], pa.int64()))
        return pa.table({"record": texts["record"].take(pa.array(rows, pa.int64())), "category": chosen, "place": pa.array(found, pa.int64())})

    met = left.groupBy("document_id", "v", "n").cogroup(right.groupBy("of", "with_v", "with_n")).applyInArrow(run, f"record {record}, category {category}, place bigint")
    return met.groupBy("record").agg(F.max_by("category", "place").alias("category"))


def assign_categories(records: DataFrame, found: DataFrame) -> DataFrame:
    """category_id from found (document_id, id, ord, name, pages): of the record's document, the first in the order of
    detection whose pages hold the record's, else the last whose name is in a value."""
    keys = ["document_id", "page_number"]
    by_page = found.select("document_id", F.explode("pages").alias("page_number"), "id", "ord").groupBy(*keys).agg(F.min_by("id", "ord").alias("by_page"))
    out = records.join(by_page, keys, "left")
    # Only records that no page decides are compared with names, those of their own document.
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "id")).cast("long")
    names = found.select("document_id", F.col("id").alias("category"), F.lower("name").alias("name"), place.alias("place")).where(F.col("name").isNotNull())
    values = out.where("by_page IS NULL").select("document_id", F.col("id").alias("record"), F.lower(F.array_join(F.map_values("data"), "\n")).alias("values")).where(F.col("values").isNotNull())
    by_text = names_within(values, names).withColumnRenamed("category", "by_text")
    out = out.join(by_text, F.col("id") == F.col("record"), "left")
    return out.withColumn("category_id", F.coalesce("by_page", "by_text")).drop("by_page", "by_text", "record")


def row_numbers(df: DataFrame, within: list[str], order: list) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
