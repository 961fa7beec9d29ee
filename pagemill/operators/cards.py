"""Key/value forms and member cards in page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions import text as T

#: Words and labels of electoral rolls and registers, and the patterns of their fields.
ROLL_WORDS = ["निर्वाचक", "मतदाता", "अनुभाग संख्या", "विधान सभा", "विधानसभा", "वोटर", "elector", "voter list", "electoral roll", "pacs", "प्राथमिक कृषि साख", "पैक्स", "सदस्यता सूची", "मतदाता सूची"]
_NAME = r"(?:निर्वाचक|मतदाता|सदस्य)?\s*का?\s*नाम\s*[:\-=]"
_SERIAL = r"(?:क्र[०.]?\s*सं[०.]?|क[०.]?\s*सं[०.]?|sl\.?\s*no|serial)\s*[:\-\s]*"
NAME_LABEL, RELATION_LABEL = f"(?iuU){_NAME}", r"(?iuU)(?:पिता|पति|माता)\s*का\s*नाम\s*[:\-=]"
HEAD = r"(?mU)^\s*(\d{1,4})\s+([A-Z0-9/]{5,18})(?![\p{L}\p{N}_])"
_VALUE = r"\s*[:\-=\s]\s*([^\n\r|;]+)"
FIELDS = {
    "name": r"(?iuU)(?:निर्वाचक\s*का\s*नाम|मतदाता\s*का\s*नाम|सदस्य\s*का\s*नाम|elector'?s?\s*name|voter\s*name|नाम)" + _VALUE,
    "relation": r"(?iuU)(?:(पिता|पति|माता|अभिभावक|संरक्षक)\s*का\s*नाम|father'?s?\s*name|husband'?s?\s*name|mother'?s?\s*name|guardian'?s?\s*name|सम्बन्धी\s*का\s*नाम)" + _VALUE,
    "house_no": r"(?iuU)(?:मकान\s*संख्या|गृह\s*संख्या|म[०.]?\s*सं[०.]?|गृह\s*सं[०.]?|ग्राम|पता|वार्ड\s*(?:सं[०.]?|नं[०.]?)?|house\s*(?:no\.?|number)?|address)" + _VALUE,
    "age": r"(?iuU)(?:उम्र|आयु|age)\s*[:\-=\s]*([0-9०-९]{1,3})",
    "gender": r"(?iuU)(?:लिंग|gender|sex)\s*[:\-=\s]*(पुरुष|पुरूष|पु[०.]?|महिला|स्त्री|म[०.]?|male|female|m\b|f\b|अन्य|transgender)",
    "epic": r"(?<![\p{L}\p{N}_])([A-Z]{3}[0-9]{7}|[A-Z]{2}/[0-9/]{6,16})(?![\p{L}\p{N}_])",
    "id": r"(?iuU)(?:पहचान\s*पत्र|मतदाता\s*संख्या|epic|id|सदस्यता\s*संख्या|खाता\s*संख्या)\s*[:\-=\s]*([A-Z0-9/]+)",
    "serial": f"(?iuU){_SERIAL}" + r"(\d+)",
}
PHOTO = r"(?iuU)(?:फोटो\s*उपलब्ध\s*है|फोटो\s*उपलब्ध|photo\s*available).*"
PAIR = r"(?dU)([A-Za-zऀ-ॿ0-9\s._\-/]+)[:\-=]\s*([^:\n]+)(?=\n|$)"


def is_card_page(text: Column) -> Column:
    low, hit = F.lower(text), None
    for w in ROLL_WORDS:
        hit = low.contains(w) if hit is None else hit | low.contains(w)
    return F.coalesce(hit | (F.regexp_count(text, F.lit(f"(?U){_NAME}")) >= 2) | (F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{3}[0-9]{7}(?![\p{L}\p{N}_])")) >= 2), F.lit(False))


def pairs(text: Column) -> Column:
    """The map of a form's labels and values; the last value of a label counts."""
    from .tables import last_wins

    keys, values = F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2))
    found = F.zip_with(keys, values, lambda k, v: F.struct(T.field_name(T.squeeze(k)).alias("k"), T.normalize(v).alias("v"), F.length(F.regexp_replace(k, r"(?U)^\s+|\s+$", "")).alias("n")))
    return last_wins(F.filter(found, lambda p: (p["n"] > 0) & (p["n"] < 40) & (p["k"] != "") & (p["v"] != "")))


def form_records(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    # Exploded, not filtered afterwards: a filter on the map would work it out a second time.
    data = F.filter(F.array(pairs(F.col(text))), lambda m: F.size(m) > 0)
    return pages.select("document_id", "page_number", F.explode(data).alias("data"), T.normalize(F.substr(F.col(text), F.lit(1), F.lit(150))).alias("source_text"))


def card_fields(chunk: Column) -> Column:
    """The map of a card's fields; fields not found are left out."""
    got = lambda name, group=1: F.regexp_extract(chunk, FIELDS[name], group)
    full = lambda c: F.nullif(c, F.lit(""))
    head = chunk.rlike(HEAD)
    gender = F.lower(got("gender"))
    sex = F.when(gender.rlike(r"^(?:पुरुष|पुरूष|पु[०.]?|male|m)$"), "पुरुष").when(gender.rlike(r"^(?:महिला|स्त्री|म[०.]?|female|f)$"), "महिला").otherwise(full(T.normalize(got("gender"))))
    relation = full(T.normalize(got("relation", 2)))
    values = {
        "serial_no": F.when(head, F.regexp_extract(chunk, HEAD, 1)).otherwise(got("serial")),
        "voter_id": F.when(head, F.regexp_extract(chunk, HEAD, 2)).otherwise(F.coalesce(full(got("epic")), got("id"))),
        "name": T.normalize(F.regexp_replace(got("name"), PHOTO, "")),
        "relation_name": relation,
        "relation_type": F.when(relation.isNotNull(), F.coalesce(full(got("relation")), F.lit("पिता"))),
        "house_no": T.normalize(got("house_no")),
        "age": got("age"),
        "gender": sex,
    }
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: F.coalesce(v, F.lit("")) != "")


def begins(line: Column, before: Column) -> Column:
    """Whether a card begins at a line: a serial and id line, a name label (unless such a line is before it) or a serial label."""
    named = line.rlike(f"(?iuU)^{_NAME}")
    return F.when(line.rlike(HEAD), True).when(named, before.isNull() | ~before.rlike(HEAD)).otherwise(line.rlike(f"(?iuU)^{_SERIAL}" + r"\d+"))


def is_card(data: Column, cards: Column) -> Column:
    """Whether a part of a page with so many of them is a card."""
    return data["name"].isNotNull() | data["voter_id"].isNotNull() | ((cards > 1) & data["serial_no"].isNotNull())


def chunks(text: Column) -> Column:
    """Texts of single cards: a card starts at a serial and id line, a name label (unless such a line is before it) or a serial label."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    head = lambda x: x.rlike(HEAD)

    def places(ls: Column) -> Column:
        starts = F.transform(ls, lambda x, i: F.when(head(x), True).when(x.rlike(f"(?iuU)^{_NAME}"), (i == 0) | ~head(F.element_at(ls, F.greatest(i, F.lit(1))))).otherwise(x.rlike(f"(?iuU)^{_SERIAL}" + r"\d+")))
        return F.filter(F.transform(starts, lambda s, i: F.when(s, i + 1)), lambda x: x.isNotNull())

    def parts(ls: Column, at: Column) -> Column:
        cut = F.transform(at, lambda a, i: F.array_join(F.slice(ls, a, F.coalesce(F.get(at, i + 1), F.size(ls) + 1) - a), "\n"))
        return F.when(F.size(at) > 0, cut).otherwise(F.array(text))

    return T.once(lines, lambda ls: T.once(places(ls), lambda at: parts(ls, at)))


def sequential(pages: DataFrame, text: str = "raw_text", keep: tuple[str, ...] = ("document_id", "page_number")) -> DataFrame:
    """One record for each card of each text."""
    each = pages.select(*keep, chunks(F.col(text)).alias("_chunks")).select(*keep, F.posexplode(F.transform("_chunks", lambda c: F.struct(c.alias("chunk"), F.size("_chunks").alias("cards")))).alias("card_no", "_c")).select(*keep, "card_no", "_c.*")
    # Exploded, so that a filter does not work the fields out again for each that it names; outer, as Spark would filter the array before.
    out = each.withColumn("data", F.explode_outer(F.filter(F.array(card_fields(F.col("chunk"))), lambda d: is_card(d, F.col("cards")))))
    return out.where(F.col("data").isNotNull()).select(*keep, "card_no", "data", T.normalize(F.substr(F.col("chunk"), F.lit(1), F.lit(200))).alias("source_text"))


def is_matrix(text: Column) -> Column:
    """Whether cards stand side by side: two lines that each hold two name or relation labels."""
    lines = F.split(text, "\n")
    wide = F.filter(lines, lambda x: (F.regexp_count(x, F.lit(f"(?U){_NAME}")) >= 2) | (F.regexp_count(x, F.lit(RELATION_LABEL)) >= 2))
    return F.size(wide) >= 2


def matrix(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Side-by-side cards: the cells of each column, in line order, read as one text."""
    lines = pages.where(is_matrix(F.col(text))).select("document_id", "page_number", F.posexplode(F.split(text, "\n")).alias("line", "t"))
    cells = F.filter(F.transform(F.split("t", r"(?U)\s{3,}"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), lambda c: c != "")
    each = lines.select("document_id", "page_number", "line", F.posexplode(cells).alias("column_no", "cell"))
    joined = each.groupBy("document_id", "page_number", "column_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "cell"))), lambda x: x["cell"]), "\n").alias("raw_text"))
    return sequential(joined, keep=("document_id", "page_number", "column_no"))


def spatial(blocks: DataFrame) -> DataFrame:
    """Cards from positioned blocks: three columns at 35 % and 68 % of the page's text width, each read downwards.

    A record's bbox is the union of the blocks that hold its id or name, else its column's extent.
    """
    page = Window.partitionBy("document_id", "page_number")
    live = blocks.where(F.trim("text") != "").withColumns({"lo": F.min("x0").over(page), "hi": F.max("x1").over(page), "n": F.count("*").over(page)})
    at = ((F.col("x0") + F.col("x1")) / 2 - F.col("lo")) / (F.col("hi") - F.col("lo"))
    live = live.where("n >= 2 AND hi > lo").withColumn("column_no", F.when(at < 0.35, 0).when(at < 0.68, 1).otherwise(2))
    b = F.struct("y0", "x0", "x1", "y1", F.trim("text").alias("text"))
    columns = live.groupBy("document_id", "page_number", "column_no").agg(F.array_sort(F.collect_list(b)).alias("blocks"))
    columns = columns.withColumn("raw_text", F.array_join(F.transform("blocks", lambda x: x["text"]), "\n"))
    found = sequential(columns, keep=("document_id", "page_number", "column_no", "blocks"))
    own = F.filter("blocks", lambda x: F.coalesce(F.contains(x["text"], F.col("data")["voter_id"]), F.lit(False)) | F.coalesce(F.contains(x["text"], F.col("data")["name"]), F.lit(False)))
    ext = lambda a, f, k: f(F.transform(a, lambda x: x[k]))
    box = F.struct(ext(own, F.array_min, "x0").alias("x"), ext(own, F.array_min, "y0").alias("y"), (ext(own, F.array_max, "x1") - ext(own, F.array_min, "x0")).alias("w"), (ext(own, F.array_max, "y1") - ext(own, F.array_min, "y0")).alias("h"))
    whole = F.struct(ext("blocks", F.array_min, "x0").alias("x"), F.lit(0.0).alias("y"), (ext("blocks", F.array_max, "x1") - ext("blocks", F.array_min, "x0")).alias("w"), F.lit(0.0).alias("h"))
    return found.select("document_id", "page_number", "column_no", "card_no", "data", "source_text", F.when(F.size(own) > 0, box).otherwise(whole).alias("bbox"))


def extract(pages: DataFrame, blocks: DataFrame | None = None, text: str = "raw_text") -> DataFrame:
    """Cards of a page by the first way that finds any: positions, side by side, one after another."""
    keys, columns = ["document_id", "page_number"], ["document_id", "page_number", "data", "source_text"]
    out = spatial(blocks).select(*columns) if blocks is not None else None
    for way in (matrix, sequential):
        if out is not None:
            # Cards found are written once: which pages have some, and the cards themselves, are read from there.
            path, schema = storage.scratch(pages.sparkSession, "cards"), out.schema
            out.write.parquet(path)
            out = pages.sparkSession.read.schema(schema).parquet(path)
        found = way(pages if out is None else pages.join(out.select(*keys).distinct(), keys, "left_anti"), text).select(*columns)
        out = found if out is None else out.unionByName(found)
    return out
