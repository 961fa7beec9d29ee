"""The stored index, batches of queries, and searches of stored texts."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagemill import storage
from pagemill.functions import text as T
from pagemill.operators import batch, fulltext, postings, search

ENTRY = "text string, page_number int, document_id bigint, record_id bigint, category_name string"
RECORD = "id bigint, document_id bigint, page_number int, category_id bigint, data map<string,string>, source_text string"
PAGE = "document_id bigint, page_number int, raw_text string, processed_text string"
CATEGORY = "id bigint, document_id bigint, name string"


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(3)
    words = ["run", "running", "runner", "café", "Cafés", "tion", "the", "राम", "कुमार", "alpha", "beta9"] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", ":"]) for _ in range(n))
    rows = [(text(rng.randrange(200)), 1 + k % 4, k % 20, k if k % 3 else None, f"c{k % 3}") for k in range(120)]
    return spark.createDataFrame([*rows, (None, 1, 3, 900, ""), ("", 1, 4, 901, ""), (text(8_000), 1, 5, 902, "c1")], ENTRY).cache()


@pytest.fixture
def index(spark, entries, monkeypatch):
    monkeypatch.setattr(postings, "SHARD_ROWS", 200)
    out = postings.Index(spark, storage.scratch(spark, "index"))
    out.write(entries)
    return out


def rows_of(found):
    return sorted((r.document_id, r.page_number, r.record_id or 0, round(r.bm25, 9)) for r in found.collect())


def scans(df):
    """Files that a plan's scans read, and the rows that they hand on."""
    df.collect()
    plan, files, rows = df._jdf.queryExecution().executedPlan().toString(), 0, 0
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(p.plan())
        if name == "FileSourceScanExec":
            files += p.metrics().apply("numFiles").value()
            rows += p.metrics().apply("numOutputRows").value()
        children = p.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert plan
    return files, rows


@pytest.mark.parametrize("query", ["running tion", "cafe", "w1 the", "राम beta", "nothing at all", "w", ""])
def test_match_equals_the_scan(entries, index, query):
    assert rows_of(index.match(query)) == (rows_of(fulltext.match(entries, query)) if "bm25" in fulltext.match(entries, query).columns else [])
    assert rows_of(index.match(query, category="c1", document_id=4)) == [] or all(r[0] == 4 for r in rows_of(index.match(query, category="c1", document_id=4)))


def test_only_the_shards_of_the_prefixes_are_read(spark, index):
    all_files, all_rows = scans(index.postings([""]))
    files, rows = scans(index.postings(["alpha"]))
    assert all_files >= 20 and files <= all_files / 5 and rows <= all_rows / 5
    files, _ = scans(index.postings_of(spark.createDataFrame([("alpha",), ("zzz",)], "term string")).select("entry"))
    assert files <= all_files / 5 + 1
    assert index.postings(["zzzz"]).count() == 0


def test_replaced_and_deleted_documents(spark, entries, index):
    before = index._read("postings", "term string").inputFiles()
    index.write(spark.createDataFrame([("brand new words running", 1, 4, 77, "c9")], ENTRY))
    index.write(entries.limit(0), spark.createDataFrame([(5,), (999,)], "document_id bigint"))
    rest = entries.where("document_id NOT IN (4, 5)").unionByName(spark.createDataFrame([("brand new words running", 1, 4, 77, "c9")], ENTRY))
    for query in ("running", "tion the", "brand"):
        assert rows_of(index.match(query)) == rows_of(fulltext.match(rest, query))
    assert index.lengths()[0] == rest.count() and set(before) <= set(index._read("postings", "term string").inputFiles())
    small = index.compact(storage.scratch(spark, "compact"))
    assert small.generations() == [0] and rows_of(small.match("running")) == rows_of(index.match("running"))


def test_a_generation_counts_once_it_is_committed(spark, entries, index):
    want = rows_of(index.match("running"))
    index.write(spark.createDataFrame([("running", 1, 4, 77, "c9")], ENTRY))
    storage.remove(spark, f"{index.path}/commits/gen=1")
    assert rows_of(index.match("running")) == want
    assert index.write(spark.createDataFrame([("running twice", 1, 4, 78, "c9")], ENTRY)) == 1
    assert [r[2] for r in rows_of(index.match("running", document_id=4))] == [78]


def plain_window(hits, size, sentences):
    """All windows from a hit or from the sentence about it, by points."""
    best, at = 0, 0
    for place, _ in hits:
        for begin, bonus in ((place, None), (max(s for s in sentences if s <= place), 0)):
            if bonus is not None:
                if size <= 64 or begin >= place:
                    continue
                bonus = 120 if begin == 0 else 100
            own = [h for h in hits if begin <= h[0] < begin + 64]
            points = 1000 * len({t for _, t in own}) + len(own) - len({t for _, t in own}) + (bonus or 0)
            if points > best:
                first, last = own[0][0], own[-1][0] + 1
                best, at = points, begin if bonus is not None else max(0, min(first - (64 - (last - first)) // 2, size - 64))
    return at


def test_windows_against_a_plain_loop():
    rng = random.Random(9)
    for _ in range(300):
        size = rng.randrange(1, 400)
        hits = sorted({(p, rng.randrange(3)) for p in rng.sample(range(size), rng.randrange(1, min(size, 30) + 1))})
        sentences = sorted({0, *rng.sample(range(size), rng.randrange(size // 10 + 1))})
        assert postings.best_window(hits, size, sentences) == plain_window(hits, size, sentences)


def test_snippets(index):
    assert postings.snippet("One café. Two.", [(1, 0)]) == "One <b>café</b>. Two."
    long_ = " ".join(f"w{k}" for k in range(300))
    shown = postings.snippet(long_, [(150, 0), (152, 1)])
    assert shown.startswith("...w") and shown.endswith("...") and "<b>w150</b> w151 <b>w152</b>" in shown and len(shown.split()) == 64
    for r in index.first("cafe the", 5).collect():
        assert "<b>" in r.context_snippet and r.rank == 50.0 and r.match_field == "FTS"


@pytest.mark.parametrize("text", ["Café déjà-vu, naïve!", "मनोज कुमार abc", "İstanbul ŞEHİR x", "été a", "", "ﬁne ½ x²", "à", "́a b"])
def test_spans_are_those_of_the_tokens(text):
    own = fulltext.spans(text)
    folded = [fulltext.fold(text[a:b]) for a, b in own]
    assert [t for f in folded for t in f] == fulltext.fold(text) and all(len(f) == 1 for f in folded)


ROWS = [
    (1, {"name": "Ramesh Kumar", "relation_name": "Suresh Kumar", "voter_id": "ABC1234567", "house_no": "42"}, "Elector's Name: Ramesh Kumar Age: 42"),
    (1, {"name": "राजेन्द्र सिंह", "village": "Ramnagar", "age": "42"}, "निर्वाचक का नाम: राजेन्द्र"),
    (2, {"name": "Kumar", "note": None, "x": "ram ram"}, None),
    (2, {"name": "", "voter_id": "XYZ7654321"}, "Age and Gender of kumar"),
    (3, {}, "only a source with Ramesh in it"),
    (3, None, "Gender"),
    (4, {"name": unicodedata.normalize("NFD", "Café ज़")}, ""),
]
ASKED = [(1, "Kumar"), (2, "ram"), (3, "राजेंद्र"), (4, "42"), (5, "ABC"), (6, "café ज़"), (7, "  "), (8, None), (9, "Age"), (10, "Gender"), (11, "ramesh*"), (12, "a"), (13, "c++ (x"), (14, "kumar")]


@pytest.fixture(scope="module")
def stored(spark):
    records = spark.createDataFrame([(i + 1, 1 + i % 2, p, None if i % 2 else 5, d, s) for i, (p, d, s) in enumerate(ROWS)], RECORD)
    pages = spark.createDataFrame([(1, p, t, None) for p, t in enumerate(["Kumar of Age 42", "ram", "a\nKUMAR  x", unicodedata.normalize("NFD", "café ज़"), "Gender"], 1)] + [(2, 9, "old", "Ramesh Kumar")], PAGE)
    return records, pages, spark.createDataFrame([(5, 1, "group")], CATEGORY)


@pytest.mark.parametrize(("scope", "limit", "block"), [("all", 500, 20_000), ("all", 2, 3), ("name", 500, 3), ("voter id", 500, 20_000), ("exact", 500, 20_000)])
def test_a_batch_equals_single_searches(spark, stored, scope, limit, block, monkeypatch):
    monkeypatch.setattr(batch, "BLOCK", block)
    records, pages, categories = stored
    queries = spark.createDataFrame(ASKED, "query_id bigint, query string")
    key = lambda r: (r.page_number, r.document_id, r.record_id or 0, r["rank"], r.match_field, r.category_name)
    got = {}
    for r in batch.search_all(records, pages, categories, queries, scope, limit).orderBy("query_id", "result_no").collect():
        got.setdefault(r.query_id, []).append(key(r))
    want = {k: [key(r) for r in search.search(records, pages, categories, q or "", scope, limit).collect()] for k, q in ASKED}
    assert got == {k: v for k, v in want.items() if v}


def test_a_batch_of_full_text_queries(spark, entries, index):
    asked = [(1, "running tion"), (2, "cafe"), (3, "w1 the"), (4, "राम beta"), (5, "nothing at all"), (6, ""), (7, None), (8, "the the"), (9, "w w1")]
    found = batch.match_all(index, spark.createDataFrame(asked, "query_id bigint, query string")).collect()
    for k, q in asked:
        assert sorted((r.document_id, r.page_number, r.record_id or 0, round(r.bm25, 9)) for r in found if r.query_id == k) == rows_of(index.match(q or "")), q


def test_full_text_queries_of_the_same_prefixes_are_answered_once(spark, index):
    """Nothing that is moved or read grows with such queries, but the queries and what they give."""
    asked = [(k, ("w1 the", "The W1*", "the w1 the")[k % 3]) for k in range(300)] + [(300, "cafe")]
    found = batch.match_all(index, spark.createDataFrame(asked, "query_id bigint, query string"))
    _, rows = scans(found)
    one, other = rows_of(index.match("w1 the")), rows_of(index.match("cafe"))
    assert found.count() == 300 * len(one) + len(other) and len(one) > 3
    assert [rows_of(found.where(f"query_id = {k}")) for k in (0, 1, 2, 299, 300)] == [one] * 4 + [other]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString() and rows <= len(one) + len(other) + 301 + 2


def test_blocks_of_full_text_queries_and_replaced_documents(spark, entries, index, monkeypatch):
    index.write(spark.createDataFrame([("brand new words running", 1, 4, 77, "c9"), ("w1 w1 running w12 the", 2, 4, 78, "")], ENTRY))
    asked = [(k, f"w{k} {w}") for k, w in enumerate(["the", "run", "zzz", "w", "w1 w2 w3", "cafe the tion", "brand", "कु"] * 2)]
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    keyed = lambda found: sorted((r.query_id, r.gen, r.entry, round(r.bm25, 9)) for r in found.collect())
    whole = keyed(batch.match_all(index, queries))
    monkeypatch.setattr(batch, "BLOCK", 3)
    assert keyed(batch.match_all(index, queries)) == whole
    for k, q in asked:
        assert [r[1:] for r in whole if r[0] == k] == sorted((r.gen, r.entry, round(r.bm25, 9)) for r in index.match(q).collect()), q
    assert batch.match_all(index, queries.where("false")).count() == 0


def test_stored_texts_are_not_composed_again(spark, stored, tmp_path):
    """A table that was composed when it was written says so, and searches of it have no Python in their plans."""
    records, pages, categories = stored
    T.composed(records, ("source_text",), ("data",)).write.parquet(str(tmp_path / "records"))
    T.composed(pages, ("raw_text", "processed_text")).write.parquet(str(tmp_path / "pages"))
    boxes = T.composed(spark.createDataFrame([(1, 1, "Kumar", 0.0, 0.0, 1.0, 1.0, "word")], "document_id bigint, page_number int, text string, x0 double, y0 double, x1 double, y1 double, block_type string"), ("text",))
    boxes.write.parquet(str(tmp_path / "boxes"))
    kept = {n: spark.read.parquet(str(tmp_path / n)) for n in ("records", "pages", "boxes")}
    found = [search.record_hits(kept["records"], categories, "Kumar"), search.page_hits(kept["pages"], "Kumar"), search.highlight_boxes(kept["boxes"], kept["records"].withColumn("bbox", F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")), "Kumar")]
    for df in found:
        assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert search.page_hits(kept["pages"], "café ज़").count() == search.page_hits(pages, "café ज़").count() == 1
    # Of others each value goes to Python once.
    assert search.page_hits(pages, "Kumar")._jdf.queryExecution().executedPlan().toString().count("EvalPython") <= 1


def test_results_are_numbered_within_pages(spark, stored):
    records, _, categories = stored
    hits = search.record_hits(records, categories, "a")
    one = {(r.page_number, r.record_id): r.result_no for r in search.numbered(hits).collect()}
    assert one == {(r.page_number, r.record_id): r.result_no for r in search.number_all(hits).collect()} and len(one) > 3


def test_hits_of_a_batch_are_scored_once_and_not_sent_to_all(spark, stored, monkeypatch):
    monkeypatch.setattr(batch, "BLOCK", 3)
    records, pages, categories = stored
    found = batch.search_all(records, pages, categories, spark.createDataFrame(ASKED, "query_id bigint, query string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "regexp" not in plan.lower() and plan.count("Relation") < 12


def test_postings_are_handed_on_in_parts(spark, entries, index, monkeypatch):
    monkeypatch.setattr(postings, "PART_TOKENS", 10)
    small = postings.Index(spark, storage.scratch(spark, "index"))
    small.write(entries)
    rows = lambda i: sorted((r.term, r.tf, tuple(r.positions), r.document_id, r.page_number, r.record_id or 0, r.n_tokens) for r in i.postings([""]).collect())
    assert rows(small) == rows(index) and rows_of(small.match("running tion")) == rows_of(index.match("running tion"))


def test_full_text_reads_each_text_once(spark, entries):
    found = fulltext.match(entries, "runs the")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and found.count() > 0


@pytest.mark.parametrize(("tokens", "most"), [(1_000_000, 32_767), (300, 32_767), (1_000_000, 2)])
def test_postings_lie_in_blocks(spark, entries, monkeypatch, tokens, most):
    """Every place of every term, whatever the parts; a term has a row for each part, not for each entry, and what belongs to an entry is stored once."""
    monkeypatch.setattr(postings, "PART_TOKENS", tokens)
    monkeypatch.setattr(postings, "MOST_ENTRIES", most)
    index = postings.Index(spark, storage.scratch(spark, "index"))
    index.write(entries)
    want = {}
    for k, r in enumerate(entries.collect()):
        own = fulltext.fold(r.text)
        for p, t in enumerate(own):
            want.setdefault((k, r.document_id, r.page_number, r.record_id, r.category_name, len(own), t), []).append(p)
    rows = index.postings([""]).collect()
    assert sorted((repr((*key[1:], places)) for key, places in want.items())) == sorted(repr((r.document_id, r.page_number, r.record_id, r.category_name, r.n_tokens, r.term, list(r.positions))) for r in rows)
    assert all(r.tf == len(r.positions) for r in rows) and {r.term: (r.entries, r.occurrences) for r in index.terms().collect()} == {t: (sum(r.term == t for r in rows), sum(r.tf for r in rows if r.term == t)) for t in {r.term for r in rows}}
    stored = spark.read.parquet(f"{index.path}/postings")
    assert not {"document_id", "record_id", "category_name", "n_tokens"} & set(stored.columns)
    assert stored.count() < len(rows) / (10 if most > 2 and tokens > 300 else 1)


def test_writing_an_index_leaves_no_shuffle_files(spark, entries):
    files = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    postings.Index(spark, storage.scratch(spark, "index")).write(entries)
    assert not files() - before and spark.conf.get(key, None) == old


def _files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]
