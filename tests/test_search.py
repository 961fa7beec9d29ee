import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagemill.functions.variants import index_terms, scope_of, variants
from pagemill.operators import fulltext, relational, search
from pagemill.plans import catalogue

RECORD = "id bigint, document_id bigint, page_number int, category_id bigint, data map<string,string>, source_text string"
CATEGORY = "id bigint, document_id bigint, name string"


def records(spark, rows):
    return spark.createDataFrame([(i + 1, 1, p, None, d, s) for i, (p, d, s) in enumerate(rows)], RECORD)


def hits(spark, rows, query, scope="all"):
    found = search.ordered(search.record_hits(records(spark, rows), spark.createDataFrame([], CATEGORY), query, scope), 500).collect()
    return found


@pytest.mark.parametrize(("query", "pages"), [("राजेंद्र", [1, 2]), ("सिह", [1, 2]), ("शांति", [2]), ("गोविंद", [3]), ("महिला", [2]), ("अध्यक्ष", [1])])
def test_roster(spark, query, pages):
    found = search.record_hits(catalogue.roster(spark), spark.createDataFrame([], CATEGORY), query).select("page_number").collect()
    assert sorted(r[0] for r in found) == pages


def test_scopes_and_labels(spark):
    rows = [(1, {"name": "मनोज कुमार", "voter_id": "XYZ9999"}, "")]
    assert [h.match_field[:4] for h in hits(spark, rows, "मनोज", "name")] == ["Name"]
    assert not hits(spark, rows, "मनोज", "voter id")
    assert [h.match_field[:8] for h in hits(spark, rows, "xyz9999", "voter id")] == ["Voter ID"]
    assert not hits(spark, rows, "xyz9999", "name")


def test_snippet_and_boilerplate(spark):
    rows = [(1, {"name": "मनोज", "house_no": "42", "voter_id": "EPIC1234"}, "निर्वाचक का नाम: मनोज"), (2, {"name": "सुरेश"}, "निर्वाचक का नाम: सुरेश मकान संख्या: 3")]
    found = hits(spark, rows, "म")
    assert [h.page_number for h in found] == [1]
    assert "<b>म</b>नोज" in found[0].context_snippet and "EPIC1234" in found[0].context_snippet


def test_pages_without_records_are_added(spark):
    rows = records(spark, [(1, {"name": "Rahul Kumar"}, "")])
    pages = spark.createDataFrame([(1, 1, "Rahul here too", None), (1, 2, "only rahul here", None)], "document_id bigint, page_number int, raw_text string, processed_text string")
    found = search.search(rows, pages, spark.createDataFrame([], CATEGORY), "Rahul*").select("page_number", "rank").collect()
    assert [tuple(r) for r in found] == [(1, 900.0), (2, 100.0)]


def test_full_text_is_the_fallback(spark):
    rows = records(spark, [(1, {}, "they were running")])
    empty = spark.createDataFrame([], "document_id bigint, page_number int, raw_text string, processed_text string")
    cats = spark.createDataFrame([], CATEGORY)
    index = fulltext.build(rows, empty, cats)
    assert search.search(rows, empty, cats, "runs", index=index).count() == 1
    assert search.search(rows, empty, cats, "walks", index=index).count() == 0


def test_full_text_gives_all_hits(spark):
    """Against brute force, with more hits than a search returns; the search returns the first of them by page."""
    texts = ["they were running there", "the runs", "a run alone", "nothing"]
    rows = records(spark, [(1 + i * 7 % 1000, {}, texts[i % 4]) for i in range(2000)]).repartition(7)
    pages = spark.createDataFrame([(2, i, texts[i % 4], None) for i in range(200)], "document_id bigint, page_number int, raw_text string, processed_text string")
    cats = spark.createDataFrame([], CATEGORY)
    index = fulltext.build(rows, pages, cats)
    want = [r for r in index.collect() if all(any(t.startswith(p) for t in fulltext.fold(r.text)) for p in ("run", "the"))]
    key = lambda r: (r.page_number, r.record_id or 0, r.document_id)
    got = fulltext.match(index, "runs the").collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 1100
    every = [fulltext.fold(r.text) for r in index.collect()]
    mean = sum(map(len, every)) / len(every)

    def rank(r):
        own, out = fulltext.fold(r.text), 0.0
        for p in ("run", "the"):
            n, c = sum(any(t.startswith(p) for t in d) for d in every), sum(t.startswith(p) for t in own)
            out -= max(math.log((len(every) - n + 0.5) / (n + 0.5)), 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / mean))
        return round(out, 9)

    ranks = {key(r): rank(r) for r in want}
    assert all(abs(r.bm25 - ranks[key(r)]) < 1e-8 for r in got) and len(set(ranks.values())) > 1
    cut = sorted(ranks, key=lambda k: (k[0], ranks[k], *k[1:]))[:500]
    found = search.search(rows, pages, cats, "runned the", index=index)
    assert [key(r) for r in found.collect()] == sorted(cut)


def test_query_side():
    assert variants("12") == ["12", "१२"] and variants("") == []
    assert scope_of("Voter ID") == "voter_id" and scope_of("Name") == "name" and scope_of("Exact") == "exact" and scope_of("All Fields") == "all"
    assert index_terms("(foo) bar!") == ["foo", "bar"]
    assert [fulltext.stem(w) for w in ("running", "ponies", "relational", "hopping", "agreed", "cats")] == ["run", "poni", "relat", "hop", "agre", "cat"]
    assert fulltext.fold("café मनोज") == ["cafe", "मन", "ज"]


def test_highlight_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, "The Cat", 0.0, 0.0, 1.0, 1.0, "text"), (1, 1, "cat", 2.0, 0.0, 3.0, 1.0, "word")], "document_id bigint, page_number int, text string, x0 double, y0 double, x1 double, y1 double, block_type string")
    none = records(spark, []).withColumn("bbox", F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"))
    assert [r.x0 for r in search.highlight_boxes(boxes, none, "cat").collect()] == [2.0]


def test_composed_and_decomposed_names(spark):
    """A name is found however it and the query are composed, in records, pages, forms and boxes."""
    name = "ज़ऱा é"
    for stored in (unicodedata.normalize("NFC", name), unicodedata.normalize("NFD", name)):
        for asked in (unicodedata.normalize("NFC", name), unicodedata.normalize("NFD", name)):
            assert [h.rank for h in hits(spark, [(1, {"name": stored, "x": None}, "")], asked)] == [1000.0]
            page = spark.createDataFrame([(1, 1, f"a text\nof {stored} here", None)], "document_id bigint, page_number int, raw_text string, processed_text string")
            assert search.page_hits(page, asked).count() == 1


def test_pages_only_below_the_limit(spark):
    rows = records(spark, [(p, {"name": f"Rahul {p}"}, "") for p in (5, 6, 7)])
    pages = spark.createDataFrame([(1, p, "rahul", None) for p in (1, 6)], "document_id bigint, page_number int, raw_text string, processed_text string")
    none = spark.createDataFrame([], CATEGORY)
    found = lambda n: [r.page_number for r in search.search(rows, pages, none, "rahul", limit=n).collect()]
    assert found(3) == [5, 6, 7] and found(4) == [1, 5, 6, 7] and found(2) == [5, 6]
    got = search.envelope(search.search(rows, pages, none, "rahul"), "rahul")
    assert got["total_matches"] == 4 and got["page_counts"] == {"1": 1, "5": 1, "6": 1, "7": 1} and [r["id"] for r in got["results"]] == [1, 2, 3, 4]
    walk = search.numbered(search.search(rows, pages, none, "rahul"))
    assert [(r.result_no, r.next_no, r.previous_no) for r in relational.neighbours(walk).orderBy("result_no").collect()] == [(1, 2, 4), (2, 3, 1), (3, 4, 2), (4, 1, 3)]


def test_category_search_and_its_fallback(spark):
    rows = records(spark, [(1, {"name": "Anna"}, "they were running"), (2, {"name": "Bert"}, "she runs")]).withColumn("category_id", F.col("id") + 9)
    cats = spark.createDataFrame([(10, 1, "Ten"), (11, 1, "Eleven")], CATEGORY)
    empty = spark.createDataFrame([], "document_id bigint, page_number int, raw_text string, processed_text string")
    index = fulltext.build(rows, empty, cats)
    one = lambda q, **k: [(r.record_id, r.match_field) for r in search.find(rows, empty, cats, q, index=index, **k).collect()]
    assert one("Anna", category_id=10)[0][0] == 1 and one("Anna", category_id=11) == [] and one("runner", category_id=99) == []
    assert one("ran runs", category_id=11) == [] and one("runned", category_id=11) == [(2, "Category FTS")]
    assert one("runned") == [(1, "FTS"), (2, "FTS")]


def test_a_fallback_without_limit_gives_all_hits(spark):
    records = spark.createDataFrame([(i, 1, 1, 5, {"name": "small box", "kind": "ECONOMY"}, "") for i in range(501)], "id bigint, document_id bigint, page_number int, category_id bigint, data map<string,string>, source_text string")
    pages = spark.createDataFrame([], "document_id bigint, page_number int, raw_text string, processed_text string")
    groups = spark.createDataFrame([(5, 1, "group")], "id bigint, document_id bigint, name string")
    index = fulltext.build(records, pages, groups)
    assert search.search_in_category(records, groups, "econ small", 5, limit=None, index=index).count() == 501
    assert search.search_in_category(records, groups, "econ small", 5, index=index).count() == 500


def test_a_record_is_scored_once(spark):
    records = spark.createDataFrame([(1, 1, 1, None, {"name": "राजेन्द्र सिंह"}, "")], "id bigint, document_id bigint, page_number int, category_id bigint, data map<string,string>, source_text string")
    groups = spark.createDataFrame([(5, 1, "group")], "id bigint, document_id bigint, name string")
    found = search.record_hits(records, groups, "राजेंद्र").select("record_id", "rank")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("array_max(" in line for line in plan.splitlines()) == 1 and found.first()["rank"] == 900.0
