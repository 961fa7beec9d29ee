"""Many queries at once: a table of queries is answered by one pass over the records, the pages, or a stored index.

Relevance search: the variants of a block of queries are compiled into one automaton, which finds in time linear in the
text which query's variants a record or page holds; only such pairs are scored, by the rules of search.score with the variants
as data and not as part of the plan. Full-text search: the queries' prefixes meet the index's dictionary, the terms that they
begin meet the postings, and the shards of these terms alone are read; queries of the same prefixes are one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions import text as T
from ..functions.variants import clean, index_terms, scope_of, variants
from . import fulltext, postings, relational, search

#: Queries whose variants one automaton holds, and sets of prefixes sent to all tasks; more are answered in blocks, each with a pass of its own.
BLOCK = 20_000
_QUERY = "query_id bigint, asked string, scope string, terms array<string>, lows array<string>, patterns array<string>"
COLUMNS = ["query_id", "record_id", "document_id", "page_number", "category_name", "rank", "match_field", "term"]


def prepared(queries: DataFrame, scope: str = "all") -> DataFrame:
    """queries (query_id, query, and scope if they have one) with their variants; those without words are left out."""
    own = queries.select(F.col("query_id").cast("long"), F.coalesce("query", F.lit("")).alias("query"), (F.col("scope") if "scope" in queries.columns else F.lit(scope)).alias("scope"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, query, kind in f.itertuples(index=False):
                asked = clean(query.strip().rstrip("*"))
                if asked:
                    terms = variants(asked)
                    rows.append((key, asked, scope_of(kind), terms, [t.lower() for t in terms], [whole_word_pattern(t) for t in terms]))
            yield pd.DataFrame(rows, columns=["query_id", "asked", "scope", "terms", "lows", "patterns"])

    return own.mapInPandas(run, _QUERY)


def whole_word_pattern(term: str) -> str:
    return rf"(?iuU)(?:{T.BOUNDARY}|^|\s){search._quote(term)}(?:{T.BOUNDARY}|$|\s)"


# ---------------------------------------------------------------- which queries a text may match

_automata: dict[str, tuple] = {}


def _met(rows: DataFrame, queries: list, name: str) -> DataFrame:
    """rows with met: the queries that they may match, each with the place of its first variant in the row's text, or in its
    bare text for short and exact queries. text and bare, both in lower case, are left out, and rows without such a query.
    """
    import pyarrow as pa

    patterns: tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]] = ({}, {})
    for q in queries:
        for place, low in enumerate(q.lows):
            patterns[q.scope == "exact" or len(q.asked) <= 3].setdefault(low, []).append((q.query_id, place))
    sent = rows.sparkSession.sparkContext.broadcast([(list(p), list(p.values())) for p in patterns])
    kept = [c for c in rows.columns if c not in ("text", "bare")]

    def compiled() -> list[tuple]:
        import ahocorasick

        if name not in _automata:
            _automata.clear()
            both = []
            for words, _ in sent.value:
                a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                for i, w in enumerate(words):
                    a.add_word(w, i)
                if words:
                    a.make_automaton()
                both.append(a if words else None)
            _automata[name] = tuple(both)
        return list(zip(_automata[name], [ids for _, ids in sent.value], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = compiled()
        for batch in batches:
            at, ends, ids_, places = [], [0], [], []
            for i in range(batch.num_rows):
                own: dict[int, int] = {}
                for (automaton, ids), text in zip(both, (batch.column("text")[i].as_py(), batch.column("bare")[i].as_py()), strict=True):
                    if automaton is not None and text:
                        for k in {k for _, k in automaton.iter(text)}:
                            for query, place in ids[k]:
                                own[query] = min(place, own.get(query, place))
                if own:
                    at.append(i)
                    ids_ += own
                    places += own.values()
                    ends.append(len(ids_))
            pairs = pa.StructArray.from_arrays([pa.array(ids_, pa.int64()), pa.array(places, pa.int32())], names=["query_id", "place"])
            rest = batch.select(kept).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=[*kept, "met"])

    storage.small_batches(rows.sparkSession)
    schema = rows.select(*kept, F.lit(None).cast("array<struct<query_id:bigint,place:int>>").alias("met")).schema
    return rows.select(*kept, "text", "bare").mapInArrow(run, schema)


# ---------------------------------------------------------------- scores, with the variants as data

_HIT = "struct<score:double,at:int,label:string,term:string>"


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def _own(records: DataFrame) -> DataFrame:
    """records with own: what queries are scored by, worked out once for each record and not for each of its queries."""

    def entry(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.isNotNull().alias("known"), T.normalize(F.trim(value)).alias("value"), T.label_of(key).alias("label"))

    data = F.col("data")
    fields = {
        "name": T.normalize(search._field(data, "name")), "relation": T.normalize(search._field(data, "relation_name", "relative_name")), "voter": search._field(data, "voter_id", "epic_no"), "house": T.normalize(search._field(data, "house_no")),
        "entries": F.transform(F.map_entries(data), lambda e: entry(e["key"], e["value"])), "source": F.col("_source"), "bare": T.strip_labels(F.col("_source")),
    }
    return records.withColumn("_source", T.normalize(F.col("source_text"))).withColumn("own", F.struct(*[c.alias(k) for k, c in fields.items()])).drop("_source")


def score(own: Column, terms: Column, lows: Column, patterns: Column, asked: Column, scope: Column) -> Column:
    """struct(score, at, label, term) of a record's best match, or null: search.score for a query in columns, of a record's own."""
    n = F.size(terms)
    name, relation, voter, house, entries = (own[k] for k in ("name", "relation", "voter", "house", "entries"))

    def hit(points: Column, at: Column, label: Column, term: Column) -> Column:
        return F.when(points > 0, F.struct(points.cast("double").alias("score"), at.cast("int").alias("at"), label.alias("label"), term.alias("term"))).cast(_HIT)

    def tests(c: Column, base: int, steps: list[tuple[str, int, str]]) -> Column:
        def bound(own: Column) -> Column:
            def one(t: Column, j: Column) -> Column:
                kinds = {"equal": own == t, "word": F.array_contains(F.split(own, " "), t), "prefix": F.startswith(own, t), "part": F.contains(own, t)}
                points, label = F.lit(None).cast("int"), F.lit(None).cast("string")
                for kind, p, text in reversed(steps):
                    points, label = F.when(kinds[kind], p).otherwise(points), F.when(kinds[kind], text).otherwise(label)
                return F.when(own != "", hit(points, -(n * base + j), label, terms[j]))

            return F.transform(lows, one)

        return T.once(F.lower(c), bound)

    ids = [("equal", 1000, "Voter ID (सटीक EPIC)"), ("part", 800, "Voter ID (EPIC)")]
    names = tests(name, 0, [("equal", 1000, "Name (नाम सटीक)"), ("word", 900, "Name (नाम शब्द)"), ("prefix", 850, "Name (नाम शुरुआत)"), ("part", 700, "Name (नाम अंश)")])
    relations = tests(relation, 1, [("equal", 650, "Relative (संबंधी शब्द)"), ("word", 650, "Relative (संबंधी शब्द)"), ("prefix", 600, "Relative (संबंधी शुरुआत)"), ("part", 500, "Relative (संबंधी)")])
    voters = tests(voter, 2, [("equal", 950, "Voter ID (सटीक EPIC)"), ("part", 750, "Voter ID (EPIC)")])
    houses = tests(house, 3, [("equal", 600, "House No (मकान सटीक)"), ("part", 400, "House No (मकान)")])

    def entry(e: Column, i: Column) -> Column:
        def bound(low: Column) -> Column:
            def one(t: Column, j: Column) -> Column:
                equal, word = low == t, F.array_contains(F.split(low, " "), t)
                points = F.when(equal, 650).when(word, 600).when(F.contains(low, t), 500)
                shown = F.concat(e["label"], F.lit(" ("), F.when(~equal & word, terms[j]).otherwise(e["value"]), F.lit(")"))
                return F.when(e["value"] != "", hit(points, -(i * n) - (n * 4 + j), shown, terms[j]))

            return F.array_max(F.transform(lows, one))

        return T.once(F.lower(e["value"]), bound)

    others = F.transform(F.filter(entries, lambda e: ~e["key"].isin(*search.CHECKED) & e["known"]), entry)
    none = F.array().cast(f"array<{_HIT}>")
    best = F.array_max(F.concat(names, relations, voters, houses, F.coalesce(others, none)))

    def content() -> Column:
        def one(t: Column, j: Column) -> Column:
            good = hit(F.lit(250), F.lit(0), F.lit("Content (विवरण)"), terms[j])
            rough = hit(F.lit(200), F.lit(0), F.lit("Template / Label"), terms[j])
            return F.when(F.contains(F.lower(own["bare"]), t), good).when((F.length(asked) > 3) & F.contains(F.lower(own["source"]), t), rough)

        return _first(F.transform(lows, one))

    def exact() -> Column:
        def one(p: Column, j: Column) -> Column:
            rows = [F.when((c != "") & F.regexp_like(c, p), hit(F.lit(k), F.lit(0), F.lit(label), terms[j])) for c, k, label in ((name, 950, "Name (सटीक शब्द)"), (voter, 850, "Voter ID (सटीक EPIC)"), (relation, 750, "Relative (सटीक शब्द)"))]
            rest = F.filter(entries, lambda e: ~e["key"].isin("name", "voter_id", "epic_no", "relation_name", "relative_name") & F.regexp_like(e["value"], p))
            value = F.get(rest, F.lit(0))
            rows.append(F.when(value.isNotNull(), hit(F.lit(700), F.lit(0), F.concat(value["label"], F.lit(" (सटीक शब्द)")), terms[j])))
            rows.append(F.when((own["bare"] != "") & F.regexp_like(own["bare"], p), hit(F.lit(600), F.lit(0), F.lit("Exact Word (सटीक शब्द)"), terms[j])))
            return F.coalesce(*rows)

        return _first(F.transform(patterns, one))

    return (
        F.when(scope == "voter_id", _first(tests(voter, 0, ids)))
        .when(scope == "exact", exact())
        .when(scope == "name", F.array_max(F.concat(names, relations)))
        .otherwise(F.coalesce(best, content()))
    )


# ---------------------------------------------------------------- searches


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The queries of each block, BLOCK or so of them at once on the driver."""
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if rows:
            yield rows


def _searchable(records: DataFrame) -> DataFrame:
    """records with own, and all that a query can match of it in lower case: values and source, as they are and without labels."""
    own = _own(records)
    values = F.coalesce(F.array_join(F.transform("own.entries", lambda e: F.when(e["known"], e["value"])), "\x1f"), F.lit(""))
    return own.withColumn("text", F.lower(F.concat_ws("\x1f", values, "own.source"))).withColumn("bare", F.lower(F.concat_ws("\x1f", values, "own.bare")))


def _hits(spark: SparkSession, schema: str, blocks: Iterator[DataFrame]) -> DataFrame:
    """The hits of all blocks, each written when it is found: no plan grows with the blocks, and no hit is scored twice."""
    path = storage.scratch(spark, "hits")
    for found in blocks:
        found.write.mode("append").parquet(path)
    fs, at = storage.filesystem(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at(path)) else spark.createDataFrame([], schema)


def record_hits(records: DataFrame, categories: DataFrame, queries: DataFrame, scope: str = "all") -> DataFrame:
    """All hits of all queries (query_id, query and, if it has one, scope) among records, in COLUMNS."""
    spark = records.sparkSession
    asked = prepared(queries, scope)
    path = storage.scratch(spark, "queries")
    asked.write.parquet(path)
    asked = spark.read.schema(_QUERY).parquet(path)
    # Few bytes of records can meet many queries: they are dealt to all tasks.
    dealt = records.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    own = _searchable(T.composed(dealt, ("source_text",), ("data",))).select(F.col("id").cast("long").alias("record_id"), "document_id", "page_number", "category_id", "own", "text", "bare")
    hit = score(F.col("own"), F.col("terms"), F.col("lows"), F.col("patterns"), F.col("asked"), F.col("scope"))

    def found(block: list) -> DataFrame:
        each = _met(own, block, uuid.uuid4().hex).withColumn("query_id", F.explode("met.query_id")).drop("met")
        # A block's queries, and they alone, are sent to all tasks.
        met = each.join(F.broadcast(spark.createDataFrame(block, asked.schema)), "query_id")
        return met.select("query_id", "record_id", "document_id", "page_number", "category_id", hit.alias("hit")).where(F.col("hit").isNotNull())

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("document_id", "page_number", "category_id"))
    out = _hits(spark, f"query_id bigint, record_id bigint, {kinds}, hit {_HIT}", map(found, _blocks(asked)))
    named = relational.with_category(out, categories)
    return named.select("query_id", "record_id", "document_id", "page_number", "category_name", F.col("hit.score").alias("rank"), F.col("hit.label").alias("match_field"), F.col("hit.term").alias("term"))


def page_hits(pages: DataFrame, queries: DataFrame, scope: str = "all") -> DataFrame:
    """Pages that hold a variant of a query, in COLUMNS, as search.page_hits finds them; queries of scopes without pages have none."""
    spark = pages.sparkSession
    path = storage.scratch(spark, "queries")
    prepared(queries, scope).where(F.col("scope").isin("all", "exact")).write.parquet(path)
    asked = spark.read.schema(_QUERY).parquet(path)
    raw = F.coalesce(F.nullif(F.col("processed_text"), F.lit("")), F.col("raw_text"))
    own = T.composed(pages.select("document_id", "page_number", raw.alias("raw")), ("raw",)).withColumn("own", T.normalize(F.col("raw"))).withColumn("stripped", T.strip_labels(F.col("own")))
    own = own.select("document_id", "page_number", F.lower("own").alias("text"), F.lower("stripped").alias("bare"), "stripped")
    exact = F.col("scope") == "exact"

    def found(block: list) -> DataFrame:
        texts = own if any(q.scope == "exact" for q in block) else own.withColumn("stripped", F.lit(""))
        each = _met(texts, block, uuid.uuid4().hex).withColumn("m", F.explode("met")).select("document_id", "page_number", "stripped", "m.*")
        met = each.join(F.broadcast(spark.createDataFrame(block, asked.schema)), "query_id")
        whole = _first(F.transform("patterns", lambda p, j: F.when(F.regexp_like(F.col("stripped"), p), F.col("terms")[j])))
        term = F.when(exact, whole).otherwise(F.get("terms", F.col("place")))
        return met.select("query_id", "document_id", "page_number", exact.alias("exact"), term.alias("term")).where(F.col("term").isNotNull())

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("document_id", "page_number"))
    out = _hits(spark, f"query_id bigint, {kinds}, exact boolean, term string", map(found, _blocks(asked)))
    label = F.when(F.col("exact"), "Exact Word (सटीक शब्द)").otherwise("Page Text (पेज विवरण)")
    return out.select("query_id", F.lit(None).cast("long").alias("record_id"), "document_id", "page_number", F.lit("").alias("category_name"), F.when(F.col("exact"), 150.0).otherwise(100.0).alias("rank"), label.alias("match_field"), "term")


def search_all(records: DataFrame, pages: DataFrame, categories: DataFrame, queries: DataFrame, scope: str = "all", limit: int = 500) -> DataFrame:
    """Each query's first hits, in COLUMNS and result_no from 1: those of search.search, without its snippets.

    Hits of records come first to mind: a page counts where no record of it is a hit, and where the query has fewer
    than limit hits of records: only such queries are asked of the pages.
    """
    found = record_hits(records, categories, queries, scope)
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    few = found.join(enough, "query_id", "left_anti").select("query_id", "document_id", "page_number").distinct()
    open_ = queries.withColumn("query_id", F.col("query_id").cast("long")).join(enough, "query_id", "left_anti")
    rest = page_hits(pages, open_, scope).join(few, ["query_id", "document_id", "page_number"], "left_anti")
    order = ["page_number", F.desc("rank"), F.coalesce("record_id", F.lit(0)), "document_id"]
    # Only the first hits of records can be among the first of all.
    numbered = found.unionByName(rest).withColumn("result_no", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return numbered.where(F.col("result_no") <= limit).select(*COLUMNS, "result_no")


def match_all(index: postings.Index, queries: DataFrame) -> DataFrame:
    """query_id, gen, what an entry has, and bm25 of all full-text hits of all queries (query_id, query): Index.match for each.

    Queries of the same prefixes are answered once. Entries are gathered once, with the prefixes that they hold; a block of
    answers is sent to them, each met by its rarest prefix and tested there for the others, so that no pair is moved.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, query in f.itertuples(index=False):
                terms = sorted({t for word in index_terms((query or "").rstrip("*")) for t in fulltext.fold(word)})
                if terms:
                    rows.append((key, terms))
            yield pd.DataFrame(rows, columns=["query_id", "terms"])

    spark = index.spark
    asked_at, answers_at, met_at, held_at, planned_at = (storage.scratch(spark, name) for name in ("prefixes", "answers", "met", "held", "planned"))
    queries.select(F.col("query_id").cast("long"), "query").mapInPandas(run, "query_id bigint, terms array<string>").write.parquet(asked_at)
    asked = spark.read.schema("query_id bigint, terms array<string>").parquet(asked_at)
    asked.select("terms").distinct().withColumn("answer", F.monotonically_increasing_id()).write.parquet(answers_at)
    answers = spark.read.schema("terms array<string>, answer bigint").parquet(answers_at)
    prefixes = answers.select("answer", F.explode("terms").alias("prefix"))
    # Each term of the dictionary meets the prefixes of the lengths that are asked for.
    sizes = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())  # lengths of words
    begun = index.terms().select("term").distinct().withColumn("prefix", F.explode(F.array(*[F.substr("term", F.lit(1), F.lit(n)) for n in sizes] or [F.lit(None).cast("string")])))
    begun.distinct().join(prefixes.select("prefix").distinct(), "prefix").write.parquet(met_at)
    met = spark.read.schema("prefix string, term string").parquet(met_at)
    entry = ["gen", "entry", "document_id", "page_number", "record_id", "category_name", "n_tokens"]
    # What an entry holds is moved once, to one place.
    rows = index.counts_of(met.select("term").distinct()).join(met, "term").select("gen", "entry", "prefix", "tf").repartition("gen", "entry")
    each = rows.groupBy("gen", "entry", "prefix").agg(F.sum("tf").alias("c"))
    whole = index.named(each.groupBy("gen", "entry").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "c"))).alias("found"))).select(*entry, "found")
    whole.write.parquet(held_at)
    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in entry)
    gathered = spark.read.schema(f"{kinds}, found map<string,bigint>").parquet(held_at)
    total, mean = index.lengths()
    held = gathered.select(F.explode(F.map_keys("found")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("held"))
    idf = F.greatest(F.log((F.lit(total) - F.col("held") + 0.5) / (F.col("held") + 0.5)), F.lit(fulltext.LEAST_IDF))
    steps = F.sort_array(F.collect_list(F.struct("held", "prefix", idf.alias("idf"))))
    # The rarest prefix comes first; an answer with a prefix that nothing holds is empty.
    plans = prefixes.join(held, "prefix", "left").groupBy("answer").agg(steps.alias("steps"), F.count_if(F.col("held").isNull()).alias("lost")).where("lost = 0")
    plans.select("answer", F.get("steps", F.lit(0))["prefix"].alias("prefix"), "steps").write.parquet(planned_at)
    planned = spark.read.schema("answer bigint, prefix string, steps array<struct<held:bigint,prefix:string,idf:double>>").parquet(planned_at)
    k1, b = fulltext.K1, fulltext.B
    blocks = -(-planned.count() // BLOCK)

    def part(step: Column) -> Column:
        c = F.col("found")[step["prefix"]]
        return -step["idf"] * c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("n_tokens") / mean))

    def block(i: int) -> DataFrame:
        own = planned.where(F.pmod(F.xxhash64("answer"), F.lit(blocks)) == i)
        pairs = gathered.withColumn("prefix", F.explode(F.map_keys("found"))).join(F.broadcast(own), "prefix")
        # A prefix that the entry has not makes the sum null.
        return pairs.select("answer", *entry, F.aggregate("steps", F.lit(0.0), lambda sum_, step: sum_ + part(step)).alias("bm25")).where(F.col("bm25").isNotNull())

    hits = _hits(spark, f"answer bigint, {kinds}, bm25 double", map(block, range(blocks)))
    return hits.join(asked.join(answers, "terms").select("answer", "query_id"), "answer").select("query_id", *entry, "bm25")
