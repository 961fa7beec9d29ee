"""Relevance search over records and pages.

A record's best hit is the greatest of (score, earliest rule, label, term) over all rules, one array_max in place of a
loop. Variants are literals, so the plan is one scan with a broadcast join to the categories of a checked size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import snippets
from ..functions import text as T
from ..functions.variants import clean, scope_of, variants
from . import relational

CHECKED = ("name", "relative_name", "relation_name", "relation_type", "voter_id", "epic_no", "house_no")
COLUMNS = ["text", "page_number", "category_name", "context_snippet", "record_id", "rank", "match_field", "document_id"]


def _field(data: Column, *keys: str) -> Column:
    return F.trim(F.coalesce(*[F.nullif(data[k], F.lit("")) for k in keys], F.lit("")))


def whole_word(c: Column, term: str) -> Column:
    return c.rlike(rf"(?iuU)(?:{T.BOUNDARY}|^|\s){_quote(term)}(?:{T.BOUNDARY}|$|\s)")


def _quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s, flags=re.ASCII) if s.isascii() else "".join("\\" + ch if ch in r"\^$.|?*+()[]{}-" else ch for ch in s)


def score(data: Column, source: Column, query: str, scope: str = "all") -> Column:
    """struct(score, at, label, term) of a record's best match, or null."""
    terms, key = variants(query), scope_of(scope)
    name, relation = T.normalize(_field(data, "name")), T.normalize(_field(data, "relation_name", "relative_name"))
    voter, house = _field(data, "voter_id", "epic_no"), T.normalize(_field(data, "house_no"))
    rules: list[Column] = []  # arrays of hits, in order
    made = 0

    def rule(points: Column, label: Column | str, term: str) -> Column:
        nonlocal made
        label = F.lit(label) if isinstance(label, str) else label
        made += 1
        return F.when(points > 0, F.struct(points.cast("double").alias("score"), F.lit(1 - made).alias("at"), label.alias("label"), F.lit(term).alias("term")))

    def tests(c: Column, steps: list[tuple[str, int, str]]) -> None:
        def bound(low: Column) -> Column:
            out = []
            for v in terms:
                t = v.lower()
                kinds = {"equal": low == t, "word": F.array_contains(F.split(low, " "), t), "prefix": low.startswith(t), "part": low.contains(t)}
                points, label = None, None
                for kind, n, name_ in steps:
                    points = F.when(kinds[kind], n) if points is None else points.when(kinds[kind], n)
                    label = F.when(kinds[kind], name_) if label is None else label.when(kinds[kind], name_)
                out.append(rule(points, label, v))
            # Most texts hold no variant: one look at each of them tells.
            return F.when((low != "") & _or([low.contains(v.lower()) for v in terms]), F.array(*out)).otherwise(F.array().cast("array<struct<score:double,at:int,label:string,term:string>>"))

        rules.append(T.once(F.lower(c), bound))

    if key == "voter_id":
        tests(voter, [("equal", 1000, "Voter ID (सटीक EPIC)"), ("part", 800, "Voter ID (EPIC)")])
        # The first matching variant counts here, not the best.
        hits = F.filter(F.concat(*rules), lambda x: x.isNotNull())
        return F.get(hits, F.lit(0))
    if key == "exact":
        bare = T.strip_labels(T.normalize(source))
        for v in terms:
            for c, n, label in ((name, 950, "Name (सटीक शब्द)"), (voter, 850, "Voter ID (सटीक EPIC)"), (relation, 750, "Relative (सटीक शब्द)")):
                rules.append(rule(F.when((c != "") & whole_word(c, v), n), label, v))
            rest = F.filter(F.map_entries(data), lambda e: ~e["key"].isin("name", "voter_id", "epic_no", "relation_name", "relative_name") & whole_word(T.normalize(e["value"]), v))  # noqa: B023
            first = F.get(rest, F.lit(0))
            rules.append(rule(F.when(first.isNotNull(), 700), F.concat(T.label_of(first["key"]), F.lit(" (सटीक शब्द)")), v))
            rules.append(rule(F.when((bare != "") & whole_word(bare, v), 600), "Exact Word (सटीक शब्द)", v))
        return F.get(F.filter(F.array(*rules), lambda x: x.isNotNull()), F.lit(0))
    tests(name, [("equal", 1000, "Name (नाम सटीक)"), ("word", 900, "Name (नाम शब्द)"), ("prefix", 850, "Name (नाम शुरुआत)"), ("part", 700, "Name (नाम अंश)")])
    tests(relation, [("equal", 650, "Relative (संबंधी शब्द)"), ("word", 650, "Relative (संबंधी शब्द)"), ("prefix", 600, "Relative (संबंधी शुरुआत)"), ("part", 500, "Relative (संबंधी)")])
    if key == "name":
        return F.array_max(F.concat(*rules))
    tests(voter, [("equal", 950, "Voter ID (सटीक EPIC)"), ("part", 750, "Voter ID (EPIC)")])
    tests(house, [("equal", 600, "House No (मकान सटीक)"), ("part", 400, "House No (मकान)")])
    fixed = made

    def entry(e: Column, i: Column) -> Column:
        value = T.normalize(F.trim(e["value"]))
        low, label, out = F.lower(value), T.label_of(e["key"]), []
        for j, v in enumerate(terms):
            t = v.lower()
            equal, word, part = low == t, F.array_contains(F.split(low, " "), t), low.contains(t)
            points = F.when(equal, 650.0).when(word, 600.0).when(part, 500.0)
            shown = F.concat(label, F.lit(" ("), F.when(~equal & word, F.lit(v)).otherwise(value), F.lit(")"))
            out.append(F.when((value != "") & points.isNotNull(), F.struct(points.alias("score"), (-(i * len(terms)) - (fixed + j)).alias("at"), shown.alias("label"), F.lit(v).alias("term"))))
        return F.array_max(F.array(*out))

    others = F.transform(F.filter(F.map_entries(data), lambda e: ~e["key"].isin(*CHECKED) & e["value"].isNotNull()), entry)
    best = F.array_max(F.concat(*rules, F.coalesce(others, F.array().cast("array<struct<score:double,at:int,label:string,term:string>>"))))
    # Labels are taken out only of texts that hold all words of a variant, and once.
    rough = _or([_and([T.contains(source, w) for w in v.split()]) for v in terms])

    def content(raw: Column) -> Column:
        def first(text: Column) -> Column:
            found = None
            for v in terms:
                for c, n, label in ((text, 250.0, "Content (विवरण)"), (raw, 200.0, "Template / Label")):
                    if n == 200.0 and len(clean(query)) <= 3:
                        continue
                    hit = F.lower(c).contains(v.lower())
                    value = F.struct(F.lit(n).alias("score"), F.lit(0).alias("at"), F.lit(label).alias("label"), F.lit(v).alias("term"))
                    found = F.when(hit, value) if found is None else found.when(hit, value)
            return found

        return T.once(T.strip_labels(raw), first)

    return F.coalesce(best, F.when(F.coalesce(rough, F.lit(False)), T.once(T.normalize(source), content)))


def _scored(records: DataFrame, query: str, scope: str) -> DataFrame:
    """Records with a hit; query is clean and not empty."""
    records = T.composed(records, ("source_text",), ("data",))
    # Exploded, so that a filter on the hit does not work it out a second time; outer, as Spark would filter the array before.
    hit = F.filter(F.array(score(F.col("data"), F.col("source_text"), query, scope)), lambda h: h.isNotNull())
    return records.withColumn("hit", F.explode_outer(hit)).where(F.col("hit").isNotNull())


def _shown(hit: DataFrame, categories: DataFrame, query: str) -> DataFrame:
    named = relational.with_category(hit, categories)
    snippet = snippets.record(F.col("data"), F.col("source_text"), F.col("hit.term"), variants(query))
    return named.select(
        snippet.alias("text"), "page_number", "category_name", snippet.alias("context_snippet"), F.col("id").cast("long").alias("record_id"), F.col("hit.score").alias("rank"), F.col("hit.label").alias("match_field"), "document_id"
    )


def _first(hit: DataFrame, limit: int) -> DataFrame:
    """The hits that a result of so many rows begins with, before anything is worked out for showing them."""
    return hit.orderBy("page_number", F.col("hit.score").desc(), F.coalesce(F.col("id").cast("long"), F.lit(0)), "document_id").limit(limit)


def _none(spark) -> DataFrame:
    return spark.createDataFrame([], "text string, page_number int, category_name string, context_snippet string, record_id bigint, rank double, match_field string, document_id bigint")


def _asked(query: str) -> str:
    return clean(query.strip().rstrip("*"))


def record_hits(records: DataFrame, categories: DataFrame, query: str, scope: str = "all", limit: int | None = None) -> DataFrame:
    """All hits, or the first in result order."""
    query = _asked(query)
    if not query:
        return _none(records.sparkSession)
    hit = _scored(records, query, scope)
    return _shown(hit if limit is None else _first(hit, limit), categories, query)


def _page_terms(pages: DataFrame, query: str, key: str) -> DataFrame:
    """Pages with own (the text that is searched) and term (the first variant in it)."""
    raw = F.coalesce(F.nullif(F.col("processed_text"), F.lit("")), F.col("raw_text"))
    stored = all(T.is_composed(pages, c) or pages.schema[c].dataType.typeName() == "void" for c in ("raw_text", "processed_text"))
    bare = key == "exact" or len(query) <= 3
    # Labels are taken out, and texts composed, only where they hold the words of a variant, or may once they are composed.
    holds = lambda c: _or([_and([T.contains(c, w) for w in v.split()]) for v in variants(query)])
    pages = pages.withColumn("_raw", raw).drop("raw_text", "processed_text")
    if not stored:
        pages = T.composed(pages.where(holds(F.col("_raw")) | T.unstable(F.col("_raw"))), ("_raw",))
    pages = pages.where(holds(F.col("_raw")))
    term = None
    for v in variants(query):
        test = whole_word(F.col("own"), v) if key == "exact" else F.lower("own").contains(v.lower())
        term = F.when(test, F.lit(v)) if term is None else term.when(test, F.lit(v))
    own = T.normalize(F.col("_raw"))
    return pages.withColumn("own", T.strip_labels(own) if bare else own).withColumn("term", term).where(F.col("term").isNotNull()).drop("_raw")


def _shown_pages(hit: DataFrame, key: str) -> DataFrame:
    snippet = snippets.window(F.col("own"), F.col("term"))
    return hit.select(
        snippet.alias("text"), "page_number", F.lit("").alias("category_name"), snippet.alias("context_snippet"), F.lit(None).cast("long").alias("record_id"), F.lit(150.0 if key == "exact" else 100.0).alias("rank"),
        F.lit("Exact Word (सटीक शब्द)" if key == "exact" else "Page Text (पेज विवरण)").alias("match_field"), "document_id",
    )


def page_hits(pages: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """Pages that hold a variant: 150 for a whole word in exact scope, else 100; short queries ignore labels."""
    query, key = _asked(query), scope_of(scope)
    return _shown_pages(_page_terms(pages, query, key), key) if query else _none(pages.sparkSession)


def ordered(hits: DataFrame, limit: int | None) -> DataFrame:
    rows = hits.orderBy("page_number", F.col("rank").desc(), F.coalesce("record_id", F.lit(0)), "document_id")
    return rows if limit is None else rows.limit(limit)


def search(records: DataFrame, pages: DataFrame, categories: DataFrame, query: str, scope: str = "all", limit: int = 500, document_id: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Record hits; if there are fewer than limit, hits of pages without one (scopes all and exact); full-text hits if there are none at all.

    Records are scored once: the first limit hits come to the driver as keys, and are joined with their records again
    to be shown.
    """
    spark, key, asked = records.sparkSession, scope_of(scope), _asked(query)
    if not asked:
        return _none(spark)
    if document_id is not None:
        records, pages = (x.where(F.col("document_id") == document_id) for x in (records, pages))
    top = _first(_scored(records, asked, scope), limit).select("id", "document_id", "page_number", "hit")
    schema, top = top.schema, top.collect()  # limit rows at most
    hits = None
    if top:
        known = spark.createDataFrame(top, schema)
        hits = _shown(T.composed(records, ("source_text",), ("data",)).join(F.broadcast(known.select("id", "hit")), "id"), categories, asked)
    if key in ("all", "exact") and len(top) < limit:
        # Fewer hits than limit: these are all of them.
        fresh = pages.join(F.broadcast(known.select("document_id", "page_number").distinct()), ["document_id", "page_number"], "left_anti") if top else pages
        fresh = _shown_pages(_page_terms(fresh, asked, key).orderBy("page_number", "document_id").limit(limit), key)
        hits = fresh if hits is None else hits.unionByName(fresh)
    if not top and index is not None and key == "all" and len(asked) >= 2 and not hits.limit(1).count():
        from . import fulltext

        hits = fulltext.first(index, query, limit, document_id=document_id)
    return _none(spark) if hits is None else ordered(hits, limit)


def search_in_category(records: DataFrame, categories: DataFrame, query: str, category_id, scope: str = "all", limit: int | None = 500, index: DataFrame | None = None) -> DataFrame:
    """Hits among a category's records; if there are none, full-text hits with its name. An unknown category has none. limit None: all hits."""
    own = categories.where(F.col("id") == category_id).select("name").first()
    if own is None:
        return _none(records.sparkSession)
    hits = record_hits(records.where(F.col("category_id") == category_id), categories, query, scope, limit)
    if index is not None and len(_asked(query)) >= 2 and not hits.limit(1).count():
        from . import fulltext

        hits = fulltext.first(index, query, limit, category=own[0])
    return ordered(hits, limit)


def find(records: DataFrame, pages: DataFrame, categories: DataFrame, query: str, document_id: int | None = None, category_id=None, limit: int = 500, scope: str = "all", index: DataFrame | None = None) -> DataFrame:
    """One search for all callers: a category, where given, wins over a document."""
    if category_id is not None:
        return search_in_category(records, categories, query, category_id, scope, limit, index)
    return search(records, pages, categories, query, scope, limit, document_id, index)


def records_matching(records: DataFrame, pages: DataFrame, categories: DataFrame, query: str, document_id: int | None = None) -> DataFrame:
    """Records among a search's hits; if it has none, those whose values or source hold the query."""
    found = search(records, pages, categories, query, document_id=document_id).where("record_id IS NOT NULL").select(F.col("record_id").alias("id"))
    out = records.join(found, "id", "left_semi")
    return out if out.limit(1).count() else relational.like(records, query, document_id)


def suggestions(hits: DataFrame, limit: int = 5) -> DataFrame:
    """Distinct snippets of the first hits, in order; the limit comes first, so there can be fewer."""
    first = ordered(hits, limit)
    return first.groupBy("context_snippet").agg(F.min(F.struct("page_number", -F.col("rank"), F.coalesce("record_id", F.lit(0)))).alias("at")).orderBy("at").select("context_snippet")


def page_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.col("page_number").cast("string").alias("page")).agg(F.count("*").alias("hits"))


def numbered(hits: DataFrame) -> DataFrame:
    """1..n in result order: of hits that a limit bounds, which are numbered in one task; number_all() is for the others."""
    return hits.withColumn("result_no", F.row_number().over(Window.orderBy("page_number", F.col("rank").desc(), F.coalesce("record_id", F.lit(0)), "document_id")))


def number_all(hits: DataFrame) -> DataFrame:
    """1..n in result order for any number of hits: numbered within each page, after all hits of earlier pages."""
    order = [F.desc("rank"), F.coalesce("record_id", F.lit(0)), "document_id"]
    pages = hits.groupBy("page_number").agg(F.count("*").alias("_own"))  # a row for each page number
    before = F.coalesce(F.sum("_own").over(Window.orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("page_number").orderBy(*order))
    return hits.withColumn("_n", within).join(pages.select("page_number", before.alias("_before")), "page_number").withColumn("result_no", F.col("_before") + F.col("_n")).drop("_n", "_before")


def envelope(hits: DataFrame, query: str, scope: str = "all") -> dict:
    """What a search page is given: numbered hits with a label and a snippet each, and the hits of each page."""
    label = F.coalesce(F.nullif("match_field", F.lit("")), F.nullif("category_name", F.lit("")), F.lit("Text"))
    shown = F.coalesce(F.nullif("context_snippet", F.lit("")), F.col("text"), F.lit(""))
    rows = numbered(hits).select(F.col("result_no").alias("id"), "page_number", label.alias("field_name"), shown.alias("snippet"), "record_id").orderBy("id").collect()  # as many as the search's limit
    counts: dict[str, int] = {}
    for r in rows:
        counts[str(r.page_number)] = counts.get(str(r.page_number), 0) + 1
    return {"query": query, "scope": scope, "total_matches": len(rows), "page_counts": counts, "results": [r.asDict() for r in rows]}


def highlight_boxes(boxes: DataFrame, records: DataFrame, query: str) -> DataFrame:
    """Boxes of the first kind that has any: word boxes, all boxes, boxes of single words, boxes of records; per page."""
    terms = variants(query)
    low = F.col("text")
    any_of = lambda c, words: F.expr("false") if not words else _or([T.contains(c, w) for w in words])
    words = [w for w in clean(query).split() if len(w) >= 2] if " " in clean(query) else []
    if not T.is_composed(boxes, "text"):
        boxes = T.composed(boxes.where(any_of(low, [*terms, *words]) | T.unstable(low)), ("text",))
    records = T.composed(records, ("source_text",))
    kind = F.when(any_of(low, terms), F.when(F.col("block_type") == "word", 1).otherwise(2)).when(any_of(low, words), 3)
    own = boxes.withColumn("kind", kind).where("kind IS NOT NULL").select("document_id", "page_number", "kind", "x0", "y0", "x1", "y1")
    spread = own.where("kind = 1").withColumn("kind", F.lit(2)).unionByName(own)
    hold = F.exists(F.map_values("data"), lambda v: any_of(v, terms)) | any_of(F.col("source_text"), terms)
    b = F.col("bbox")
    cards = records.where(F.coalesce(hold, F.lit(False)) & (b["w"] > 0)).select("document_id", "page_number", F.lit(4).alias("kind"), b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["w"]).alias("x1"), (b["y"] + b["h"]).alias("y1"))
    ranked = spread.unionByName(cards).withColumn("first", F.min("kind").over(Window.partitionBy("document_id", "page_number")))
    return ranked.where("kind = first").select("document_id", "page_number", "x0", "y0", "x1", "y1").distinct()


def _and(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
