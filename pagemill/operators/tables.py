"""Tables in page text, as column expressions over the page's lines; one row for each table found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import cards

#: Words that mark a header cell.
HEADER_WORDS = [
    "name", "no", "number", "date", "phone", "email", "class", "section", "roll", "id", "gender", "age", "address", "city", "status", "type", "department", "dept", "grade", "marks", "score", "total", "rank", "father", "mother", "dob",
    "s.no", "sr", "serial", "sl", "remark", "remarks", "mobile", "contact", "district", "state", "page", "नाम", "क्रमांक", "अनुक्रमांक", "पिता", "माता", "पता", "ग्राम", "उम्र", "आयु", "लिंग", "वर्ग", "श्रेणी", "विषय", "प्राप्तांक", "पूर्णांक", "खाता", "सदस्यता",
]


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _cells(line: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(line, pattern), _trim), lambda c: c != "")


def is_header(row: Column) -> Column:
    """Whether a row of cells reads like headings: words, not data, not card labels, none long."""
    cells = F.filter(F.transform(row, _trim), lambda c: c != "")
    n = F.size(cells)
    label = F.exists(cells, lambda c: c.rlike(cards.NAME_LABEL) | c.rlike(cards.RELATION_LABEL))
    worded = F.filter(cells, lambda c: ~c.rlike(r"(?U)^[\d\s[^\p{L}\p{N}_]_]+$") & ((F.length(c) > 2) | c.rlike("[ऀ-ॿ]")))
    keyed = lambda c: F.exists(F.array(*[F.lit(w) for w in HEADER_WORDS]), lambda w: F.contains(F.lower(c), w))
    points = F.transform(cells, lambda c: F.when(F.lower(c).rlike(r"^\d+\.?\d*$"), -1).otherwise(1) + F.when(keyed(c), 2).otherwise(0) + F.when(T.is_title(c) | T.is_upper(c), 1).otherwise(0))
    score = F.aggregate(points, F.lit(0), lambda a, x: a + x)
    return (n >= 2) & ~label & (F.size(worded) >= 2) & ~F.exists(cells, lambda c: F.length(c) > 50) & (F.exists(cells, keyed) | (score >= n)) & (score > n * 0.5)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), _trim)


def _delimited_cells(line: Column) -> Column:
    tabs = _cells(line, "\t")
    return F.when(line == "", F.lit(None)).when(line.contains("\t") & (F.size(tabs) >= 3), tabs).otherwise(_cells(line, r"(?U)\s{3,}"))


def _step(df: DataFrame) -> DataFrame:
    """df, whose columns later filters and columns use as they are: a generator stops the optimizer from working them out again."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_s")).select("_s.*")


def _runs(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """df with name: the stretches of lines between the places (from 1) that flag, an array of places, holds."""
    df = _step(df.withColumn("_ends", F.concat(flag, F.array(F.size("_lines") + 1))))
    return df.withColumn(name, F.transform("_ends", lambda e, i: F.struct((F.when(i > 0, F.element_at("_ends", i)).otherwise(0) + 1).alias("at"), e.alias("end"))))


def _places(array: Column, test) -> Column:
    return F.filter(F.transform(array, lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())


def candidates(pages: DataFrame, kinds: tuple[str, ...], text: str) -> DataFrame:
    """document_id, page_number, kind, part and rows (cells) of what may be tables. Steps are columns of their own, so nothing is worked out twice.

    delimited: rows of three or more cells parted by tabs or three spaces; a blank line starts anew, or ends a table of
    three rows. piped: all lines with two or more cells between bars, but separators. aligned: runs of three or more
    lines with three or more parts.
    """
    base = _step(pages.select("document_id", "page_number", _lines(F.col(text)).alias("_lines")))
    found = []
    if "delimited" in kinds:
        df = _runs(base, _places(F.col("_lines"), lambda x: x == ""), "_parts").withColumn("_cells", F.transform("_lines", _delimited_cells))
        df = _step(df)
        groups = F.transform("_parts", lambda p: F.filter(F.slice("_cells", p["at"], p["end"] - p["at"]), lambda r: F.size(r) >= 3))
        df = _step(df.withColumn("_groups", groups)).withColumn("_full", F.filter("_groups", lambda g: F.size(g) >= 3))
        found.append(df.select("document_id", "page_number", F.lit("delimited").alias("kind"), F.lit(0).alias("part"), F.coalesce(F.get("_full", F.lit(0)), F.element_at("_groups", -1)).alias("rows")))
    if "piped" in kinds:
        rows = F.transform(F.filter("_lines", lambda x: x.contains("|")), lambda x: _cells(x, r"\|"))
        df = base.withColumn("rows", F.filter(rows, lambda r: (F.size(r) >= 2) & ~F.forall(r, lambda c: c.rlike("^[-:]+$"))))
        found.append(df.select("document_id", "page_number", F.lit("piped").alias("kind"), F.lit(0).alias("part"), "rows"))
    if "aligned" in kinds:
        df = _runs(base, _places(F.col("_lines"), lambda x: (x == "") | (F.size(F.split(x, r"(?U)\s{2,}")) < 3)), "_parts")
        each = df.select("document_id", "page_number", "_lines", F.posexplode(F.filter("_parts", lambda p: p["end"] - p["at"] >= 3)).alias("part", "p"))
        rows = F.filter(F.transform(F.slice("_lines", F.col("p.at"), F.col("p.end") - F.col("p.at")), lambda x: _cells(x, r"(?U)\s{2,}")), lambda r: F.size(r) >= 2)
        each = _step(_step(each.withColumn("rows", rows)).withColumn("_sizes", F.transform("rows", lambda r: F.size(r))))
        votes = F.transform(F.array_distinct("_sizes"), lambda n: F.struct(F.size(F.filter("_sizes", lambda x: x == n)).alias("n"), (-n).alias("s")))
        each = _step(each.withColumn("_mode", -F.array_max(votes)["s"]))
        found.append(each.select("document_id", "page_number", F.lit("aligned").alias("kind"), "part", F.filter("rows", lambda r: F.abs(F.size(r) - F.col("_mode")) <= 1).alias("rows"), F.col("_mode").alias("width")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if "width" not in out.columns:
        out = out.withColumn("width", F.lit(None).cast("int"))
    out = _step(out).where(F.size("rows") >= 2)
    return out.withColumn("width", F.coalesce("width", F.array_max(F.transform("rows", lambda r: F.size(r)))))


def _finished(found: DataFrame, sure: Column, plain: Column, least: int = 3) -> DataFrame:
    """Tables from candidates: rows fitted to the width; the first is the header if it reads like one (always with bars);
    else, with enough rows, columns are numbered."""
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size(r), F.lit(0)))), F.lit(1), F.col("width"))
    df = _step(_step(found).withColumn("rows", F.transform("rows", fit)).withColumn("_first", F.get("rows", F.lit(0))))
    df = _step(df.withColumn("_header", (F.col("kind") == "piped") | is_header(F.col("_first")))).where(F.col("_header") | (F.size("rows") >= least))
    numbered = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("Column_"), i.cast("string")))
    return df.select(
        "document_id", "page_number", "kind", "part", F.when(F.col("_header"), F.col("_first")).otherwise(numbered).alias("headers"),
        F.when(F.col("_header"), F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows")).alias("rows"), F.when(F.col("_header"), sure).otherwise(plain).alias("confidence"),
    )


def detect(pages: DataFrame, kinds: tuple[str, ...] = ("delimited", "piped", "aligned"), text: str = "raw_text") -> DataFrame:
    """document_id, page_number, table_no, headers, rows and confidence of every table of every page.

    Card pages have none. Aligned columns count only on pages without a delimited or a piped table.
    """
    live = pages.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    if tuple(kinds) == ("piped",):
        live = live.where(F.contains(text, F.lit("|")))  # before anything is matched or split
    live = live.where(~cards.is_card_page(F.col(text)))
    kind = F.col("kind")
    out = _finished(candidates(live, kinds, text), F.when(kind == "delimited", 0.7).when(kind == "piped", 0.8).otherwise(0.6), F.when(kind == "delimited", 0.5).otherwise(0.6))
    page = Window.partitionBy("document_id", "page_number")
    out = out.withColumn("_plain", F.max(F.col("kind") != "aligned").over(page)).where((F.col("kind") != "aligned") | ~F.col("_plain"))
    order = F.when(kind == "delimited", 0).when(kind == "piped", 1).otherwise(2)
    return out.withColumn("table_no", F.row_number().over(page.orderBy(order, "part")) - 1).select("document_id", "page_number", "table_no", "headers", "rows", "confidence")


def from_raw(found: DataFrame, confidence: float = 0.85) -> DataFrame:
    """Tables as a PDF library gives them (document_id, page_number, part, rows with null cells): cleaned, with headers or numbered columns."""
    clean = F.transform("rows", lambda r: F.transform(r, lambda c: T.squeeze(F.coalesce(c, F.lit("")))))
    df = found.withColumn("rows", clean).where(F.size("rows") >= 2).withColumns({"kind": F.lit("raw"), "width": F.size(F.get("rows", F.lit(0)))})
    return _finished(df, F.lit(confidence), F.lit(confidence), 2)


def records(tables: DataFrame) -> DataFrame:
    """One record for each row: headers as keys, blank cells left out, the last of equal headers wins."""
    keys = F.transform("headers", lambda h: T.field_name(h))
    live = tables.where(F.exists("headers", lambda h: F.trim(h) != ""))
    each = _step(live.withColumn("keys", keys)).select("document_id", "page_number", "table_no", "keys", F.posexplode("rows").alias("row_no", "row"))
    pairs = F.filter(F.zip_with(F.col("keys"), F.transform("row", lambda c: T.normalize(c)), lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != ""))
    each = _step(each.withColumn("pairs", pairs))
    source = T.normalize(F.array_join(F.filter("row", lambda c: F.trim(c) != ""), " | "))
    out = each.select("document_id", "page_number", "table_no", "row_no", last_wins(F.col("pairs")).alias("data"), source.alias("source_text"))
    return _step(out).where(F.size("data") > 0)


def last_wins(pairs: Column) -> Column:
    """A map from pairs (k, v) in which the last value of a key counts, at its first place."""
    value = lambda ps, k: F.element_at(F.filter(ps, lambda p: p["k"] == k), -1)["v"]
    of = lambda ps, keys: F.map_from_arrays(keys, F.transform(keys, lambda k: value(ps, k)))
    return T.once(pairs, lambda ps: T.once(F.array_distinct(F.transform(ps, lambda p: p["k"])), lambda keys: of(ps, keys)))
