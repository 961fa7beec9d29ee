"""More registered queries: records and their editing, layout, cards, categories and exports, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import snippets
from ..functions import text as T
from ..operators import cards, categories, fulltext, layout, relational, search, tables
from ..sinks import export
from .catalogue import _P, _groups, _map, _orders, _pages, _parts, _table, query

_ID_HITS = f"""WITH {_P}, h AS (SELECT *, CASE WHEN lower(voter_id) = 'brand#1' THEN 1000.0 ELSE 800.0 END::DOUBLE AS rank FROM p WHERE contains(lower(voter_id), 'brand#1')),
s AS (SELECT *, '\U0001f464 ' || name || '  •  मकान: ' || house_no || '  •  EPIC: <b>' || substr(voter_id, 1, 7) || '</b>' || substr(voter_id, 8) AS snippet FROM h)"""


@query(_ID_HITS + " SELECT id AS record_id, page_number, snippet AS context_snippet, CASE WHEN rank = 1000 THEN 'Voter ID (सटीक EPIC)' ELSE 'Voter ID (EPIC)' END AS match_field FROM s")
def record_snippets(spark, sf_dir):
    return search.record_hits(_parts(spark, sf_dir), _groups(spark, sf_dir), "Brand#1", "voter id").select("record_id", "page_number", "context_snippet", "match_field")


@query(_ID_HITS + ", f AS (SELECT snippet FROM s ORDER BY page_number, rank DESC, id LIMIT 5) SELECT DISTINCT snippet AS context_snippet FROM f")
def suggestions(spark, sf_dir):
    return search.suggestions(search.record_hits(_parts(spark, sf_dir), _groups(spark, sf_dir), "Brand#1", "voter id"))


@query(_ID_HITS + ", f AS (SELECT *, row_number() OVER (ORDER BY page_number, rank DESC, id) AS result_no, count(*) OVER () AS n FROM (SELECT * FROM s ORDER BY page_number, rank DESC, id LIMIT 500)) SELECT id AS record_id, result_no::INT AS result_no, (result_no % n + 1)::INT AS next_no, ((result_no + n - 2) % n + 1)::INT AS previous_no FROM f")
def numbered_results(spark, sf_dir):
    hits = search.find(_parts(spark, sf_dir), _pages(spark, sf_dir), _groups(spark, sf_dir), "Brand#1", scope="voter id")
    return relational.neighbours(search.numbered(hits)).select("record_id", "result_no", "next_no", "previous_no")


@query(_ID_HITS + ", f AS (SELECT *, row_number() OVER (ORDER BY page_number, rank DESC, id) AS n FROM s) SELECT document_id, page_number, arg_min(id, n) AS record_id FROM f GROUP BY 1, 2")
def first_hit_of_a_page(spark, sf_dir):
    hits = search.number_all(search.record_hits(_parts(spark, sf_dir), _groups(spark, sf_dir), "Brand#1", "voter id"))
    return relational.first_occurrence(hits, ("document_id", "page_number")).select("document_id", "page_number", "record_id")


@query(rf"""WITH {_P}, e AS (SELECT id AS record_id, document_id, page_number, trim(name || ' ' || kind || ' ' || name || ' ' || voter_id || ' ' || house_no || ' ' || kind) AS text FROM p
  UNION ALL SELECT NULL, doc_id, 1, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.document_id = doc_id AND p.page_number = 1)),
d AS (SELECT *, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS w FROM e),
c AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'rin'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'econ'))) AS b FROM d),
s AS (SELECT count(*) AS total, avg(n) AS mean, greatest(ln((count(*) - count(*) FILTER (a > 0) + 0.5) / (count(*) FILTER (a > 0) + 0.5)), 1e-6) AS ia, greatest(ln((count(*) - count(*) FILTER (b > 0) + 0.5) / (count(*) FILTER (b > 0) + 0.5)), 1e-6) AS ib FROM c)
SELECT record_id, document_id, page_number, round(-ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) - ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) + 0.0 AS bm25 FROM c, s WHERE a > 0 AND b > 0""")
def fts_rank(spark, sf_dir):
    index = fulltext.build(_parts(spark, sf_dir), _pages(spark, sf_dir), _groups(spark, sf_dir))
    return fulltext.match(index, "rin econ").select("record_id", "document_id", "page_number", (F.round("bm25", 6) + 0.0).alias("bm25"))


@query(f"""WITH {_P}, d AS (SELECT id, page_number, string_split_regex(lower(name || ' ' || kind || ' ' || voter_id || ' ' || house_no), '[^a-z0-9]+') AS w FROM p WHERE category_id = 2)
SELECT id AS record_id, page_number, 50.0::DOUBLE AS rank, 'Category FTS' AS match_field FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'econ'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'small'))) > 0""")
def category_fallback(spark, sf_dir):
    """No record of the category holds the words side by side; the index has them in some order."""
    parts, groups = _parts(spark, sf_dir), _groups(spark, sf_dir)
    index = fulltext.build(parts, _pages(spark, sf_dir), groups)
    return search.search_in_category(parts, groups, "econ small", 2, limit=None, index=index).select("record_id", "page_number", "rank", "match_field")


_SIZES = "d AS (SELECT DISTINCT p_size::BIGINT AS document_id FROM part)"


@query(f"""WITH {_P}, {_SIZES}, f AS (SELECT document_id, document_id * 10 + c AS cid, c AS ord, word, lo + document_id % 3 AS lo, hi + document_id % 3 AS hi FROM d, (VALUES (1, 'tin', 3, 4), (2, 'ring', 4, 12), (3, 'brass', 99, 99)) t(c, word, lo, hi))
SELECT id, document_id, coalesce((SELECT arg_min(cid, ord) FROM f WHERE f.document_id = p.document_id AND page_number BETWEEN lo AND hi), (SELECT arg_max(cid, ord) FROM f WHERE f.document_id = p.document_id AND (contains(lower(name), word) OR contains(lower(kind), word))))::BIGINT AS category_id FROM p""")
def category_assign_documents(spark, sf_dir):
    """Many documents, each with categories of its own."""
    parts = _parts(spark, sf_dir).drop("category_id")
    kinds = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for c, w, lo, hi in ((1, "tin", 3, 4), (2, "ring", 4, 12), (3, "brass", 99, 99))])
    found = parts.select("document_id").distinct().select("document_id", F.explode(kinds).alias("k"))
    shift = F.col("document_id") % 3
    found = found.select("document_id", (F.col("document_id") * 10 + F.col("k.c")).alias("id"), F.col("k.c").alias("ord"), F.col("k.name").alias("name"), F.transform(F.sequence(F.col("k.lo") + shift, F.col("k.hi") + shift), lambda x: x.cast("int")).alias("pages"))
    return relational.assign_categories(parts, found).select("id", "document_id", "category_id")


# ---------------------------------------------------------------- records


@query("SELECT o_custkey AS document_id, count(*) AS n FROM orders GROUP BY 1")
def records_of_documents(spark, sf_dir):
    return relational.counts_by_document(_orders(spark, sf_dir))


@query("SELECT DISTINCT o_custkey AS document_id FROM orders")
def documents_with_records(spark, sf_dir):
    return relational.documents_of(_orders(spark, sf_dir))


@query("SELECT o_orderkey AS id, o_custkey AS document_id FROM orders WHERE o_orderkey = 7")
def record_by_id(spark, sf_dir):
    return relational.by_id(_orders(spark, sf_dir), 7).select("id", "document_id")


@query("SELECT o_orderkey AS id, o_orderpriority AS source_text FROM orders WHERE o_custkey = 7 ORDER BY 1")
def rows_of_a_parent(spark, sf_dir):
    return relational.of_parent(_orders(spark, sf_dir), "document_id", 7).select("id", "source_text")


@query("SELECT p_partkey AS id, p_name AS text FROM part WHERE p_size = 7 AND contains(lower(p_name), 'ring') ORDER BY 1 LIMIT 1")
def box_for_text(spark, sf_dir):
    boxes = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("page_id"), F.col("p_name").alias("text"))
    return relational.box_for_text(boxes, 7, "RING").select("id", "text")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 + 1 >= 3")
def panel_filter(spark, sf_dir):
    conditions = relational.panel_filters(_groups(spark, sf_dir), {"category": "AMERICA", "page_from": 3})
    return relational.filtered(_orders(spark, sf_dir), conditions).select("id")


@query("SELECT doc_id AS document_id, 1::BIGINT AS total, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS failed, CASE WHEN doc_id % 5 = 0 THEN 'Complete - 0/1 pages processed (1 failed)' ELSE 'Complete - 1/1 pages processed' END AS message FROM documents")
def import_outcomes(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("error", F.when(F.col("document_id") % 5 == 0, "unreadable"))
    return relational.page_outcomes(pages).select("document_id", "total", "failed", "message")


@query("SELECT coalesce(sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\x0c\\r\\x{85}\\x{a0}\\x{2028}\\x{2029}\\x{3000}]+'))), 0)::BIGINT AS words, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM documents")
def text_size(spark, sf_dir):
    return relational.text_size(_pages(spark, sf_dir))


@query("SELECT o_orderkey AS id, t.place, t.field, t.value, t.field = 'total' AS low_confidence FROM orders, LATERAL (SELECT 0 AS place, 'name' AS field, o_orderpriority AS value UNION ALL SELECT 1, CASE WHEN o_orderkey % 3 = 0 THEN 'village' ELSE 'total' END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE floor(o_totalprice)::BIGINT::VARCHAR END) t")
def editor_view(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("data", F.map_concat("data", F.create_map(F.lit("_hidden"), F.lit("x"), F.lit("id"), F.lit("1"))))
    return relational.editor_view(o.withColumn("confidence", F.create_map(F.lit("total"), F.lit(0.5), F.lit("name"), F.lit(0.9))))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS is_edited, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 4 WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END::BIGINT AS category_id FROM orders")
def edits_applied(spark, sf_dir):
    o = _orders(spark, sf_dir)
    edits = o.where("id % 2 = 0").select("id", F.create_map(F.lit("name"), F.lit(" new ")).alias("data"), F.lit(4).cast("long").alias("category_id"))
    out, _ = relational.apply_edits(o, edits)
    return out.select("id", "is_edited", F.col("data")["name"].alias("name"), F.col("category_id").cast("long").alias("category_id"))


@query("SELECT o_orderkey AS record_id, t.field_name, t.original_value, t.corrected_value FROM orders, LATERAL (SELECT 'name' AS field_name, o_orderpriority AS original_value, 'new' AS corrected_value UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'village' ELSE 'total' END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE floor(o_totalprice)::BIGINT::VARCHAR END, '') t WHERE o_orderkey % 2 = 0")
def edits_logged(spark, sf_dir):
    o = _orders(spark, sf_dir)
    edits = o.where("id % 2 = 0").select("id", F.create_map(F.lit("name"), F.lit(" new ")).alias("data"), F.lit(4).cast("long").alias("category_id"))
    return relational.apply_edits(o, edits)[1]


@query("SELECT max(o_orderkey) + 1 AS id, 'name,total,village' AS keys, 'Manually added record' AS source_text FROM orders WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7)")
def blank_row(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("document_id", F.lit(7).cast("long"))
    return relational.blank_row(o, 7, 3, 1).select("id", F.array_join(F.map_keys("data"), ",").alias("keys"), "source_text")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (1, 3) THEN 'changed' ELSE o_orderpriority END AS source_text FROM orders")
def record_update(spark, sf_dir):
    return relational.update(_orders(spark, sf_dir), [1, 3], {"source_text": "changed"}).select("id", "source_text")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'over' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'more' END AS note FROM orders")
def record_overlay(spark, sf_dir):
    o = _orders(spark, sf_dir)
    payload = o.where("id % 4 = 0").select("id", _map(name=F.lit("over"), note=F.lit("more"), page_number=F.lit("9"), is_edited=F.lit("1")).alias("payload"))
    out = relational.overlay(o, payload)
    return out.select("id", F.col("data")["name"].alias("name"), F.col("data")["note"].alias("note"))


@query("SELECT o_orderkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def delete_set_null(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return relational.detach(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT p_partkey AS id, p_size::VARCHAR AS sort_key FROM part")
def grid_sort_plain(spark, sf_dir):
    return relational.grid_text_order(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("c")), "c").select("id", "sort_key")


# ---------------------------------------------------------------- text, layout, exports

_BARE = r"regexp_replace(regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '')"


@query(f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {_BARE}) AS ls FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, list_reduce(list_transform(ls, lambda x: [length(x)::DOUBLE]), lambda a, x: list_append(a, a[-1] + CASE WHEN x[1] = 0 THEN 15.0 WHEN x[1] < 60 AND a[-1] < 100 THEN 20.0 ELSE 15.0 END), [50.0::DOUBLE]) AS ys FROM l),
e AS (SELECT doc_id, unnest(ls) AS text, unnest(ys[1:len(ls)]) AS y0, generate_subscripts(ls, 1) AS i FROM y)
SELECT doc_id AS document_id, 1 AS page_number, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS block_no, text, 50.0::DOUBLE AS x0, y0, 550.0::DOUBLE AS x1,
  y0 + CASE WHEN length(text) < 60 AND y0 < 100 THEN 16 ELSE 11 END AS y1, (CASE WHEN length(text) < 60 AND y0 < 100 THEN 16 ELSE 11 END)::DOUBLE AS font_size, CASE WHEN length(text) < 60 AND y0 < 100 THEN 'heading' ELSE 'text' END AS block_type FROM e WHERE text <> ''""")
def layout_lines(spark, sf_dir):
    return layout.blocks(_pages(spark, sf_dir))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'a b' ELSE 'a' END AS first, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END::INT AS n, 0.0::DOUBLE AS x0, (CASE WHEN p_size % 2 = 0 THEN 30 ELSE 10 END)::DOUBLE AS x1 FROM part")
def words_to_lines(spark, sf_dir):
    word = lambda t, x, y: F.struct(F.lit(float(x)).alias("x0"), y.cast("double").alias("y0"), F.lit(float(x + 10)).alias("x1"), (y + 8).cast("double").alias("y1"), F.lit(t).alias("text"))
    second = F.when(F.col("p_size") % 2 == 0, 102).otherwise(110)
    lines = layout.word_lines(F.array(word("b", 20, second), word("a", 0, F.lit(100))))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), lines.alias("l")).select("id", F.col("l")[0]["text"].alias("first"), F.size("l").alias("n"), F.col("l")[0]["x0"].alias("x0"), F.col("l")[0]["x1"].alias("x1"))


@query("SELECT p_size AS page, avg(greatest(CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_partkey % 101 END, 0) / 100.0) AS confidence FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1")
def ocr_confidence(spark, sf_dir):
    k = F.col("p_partkey")
    words = _table(spark, sf_dir, "part").select("p_size", F.when(k % 9 == 0, -1).otherwise(k % 101).alias("conf"), F.when(k % 11 == 0, "  ").otherwise(F.col("p_name")).alias("text"))
    return words.groupBy(F.col("p_size").alias("page")).agg(layout.mean_confidence(F.col("conf"), F.col("text")).alias("confidence"))


@query("SELECT p_partkey AS id, greatest(least(p_size - 5.0, 20.0), 0)::DOUBLE AS x0, greatest(least(p_size + 5.0, 20.0), 0)::DOUBLE AS x1 FROM part")
def clamped_boxes(spark, sf_dir):
    size = F.col("p_size").cast("double")
    box = layout.centred(size, size, F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(20.0))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), box.alias("b")).select("id", "b.x0", "b.x1")


@query("SELECT doc_id AS document_id, length(trim(coalesce(text, ''))) < 30 AS needs_ocr, CASE WHEN length(coalesce(text, '')) < 40 THEN repeat('x', 40) ELSE text END AS kept FROM documents")
def ocr_decision(spark, sf_dir):
    own = _table(spark, sf_dir, "documents")
    return own.select(F.col("doc_id").alias("document_id"), layout.needs_ocr(F.col("text")).alias("needs_ocr"), layout.kept_text(F.col("text"), F.lit("x" * 40)).alias("kept"))


@query(r"""WITH d AS (SELECT p_partkey AS id, unnest([p_size::VARCHAR, p_size || '.5', '1.2.3', p_name, '.']) AS v FROM part) SELECT id, v, regexp_matches(v, '^\d*\.?\d*$') AND regexp_matches(v, '\d') AS number FROM d""")
def numeric_cells(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(size, F.concat(size, F.lit(".5")), F.lit("1.2.3"), F.col("p_name"), F.lit("."))).alias("v")).withColumn("number", T.number_like(F.col("v")))


@query("SELECT p_partkey AS id, replace(lower(p_type), ' ', '-') AS slug, replace(trim(regexp_replace(p_type || ': ' || p_name, '[^\\p{L}\\p{N}_\\s-]', '', 'g')), ' ', '_') AS file FROM part")
def slugs_and_files(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), export.slug(F.col("p_type")).alias("slug"), T.safe_filename(F.concat("p_type", F.lit(": "), "p_name")).alias("file"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, p_type = upper(p_type) AS upper, false AS titled FROM part")
def letter_cases(spark, sf_dir):
    t = F.col("p_type")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.label_of(F.replace(t, F.lit(" "), F.lit("_"))).alias("title"), T.is_upper(t).alias("upper"), T.is_title(t).alias("titled"))


@query("SELECT p_partkey AS id, p_size % 3 <> 0 AS cards FROM part")
def card_pages(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("ABC1234567 once only "), F.col("p_name"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("ABC1234567 and XYZ7654321 "), F.col("p_name"))).otherwise(F.concat(F.lit("An Electoral Roll of "), F.col("p_name")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cards.is_card_page(text).alias("cards"))


def _side_by_side(spark, sf_dir):
    """Two customers' cards side by side on each page."""
    k = F.col("c_custkey")
    card = lambda c: [F.concat(F.lit("निर्वाचक का नाम : Person "), c.cast("string")), F.concat(F.lit("पिता का नाम : Father "), c.cast("string")), F.concat(F.lit("मकान संख्या : "), c.cast("string")), F.concat(F.lit("ABC"), F.lpad(c.cast("string"), 7, "0"))]
    rows = [F.concat(a, F.lit("      "), b) for a, b in zip(card(k), card(k + 500_000), strict=True)]
    return _table(spark, sf_dir, "customer").select(k.cast("long").alias("document_id"), F.lit(1).alias("page_number"), F.concat_ws("\n", *rows).alias("raw_text"))


_TWICE = "SELECT c_custkey::BIGINT AS document_id, 'Person ' || (c_custkey + s) AS name, 'Father ' || (c_custkey + s) AS relation_name, (c_custkey + s)::VARCHAR AS house_no, 'ABC' || lpad((c_custkey + s)::VARCHAR, 7, '0') AS voter_id FROM customer, (VALUES (0), (500000)) t(s)"


def _card_columns(found):
    return found.select("document_id", *[F.col("data")[c].alias(c) for c in ("name", "relation_name", "house_no", "voter_id")])


@query(_TWICE)
def cards_side_by_side(spark, sf_dir):
    return _card_columns(cards.extract(_side_by_side(spark, sf_dir)))


@query(_TWICE)
def cards_by_position(spark, sf_dir):
    k = F.col("c_custkey")
    text = lambda c: F.concat(F.lit("निर्वाचक का नाम : Person "), c.cast("string"), F.lit("\nपिता का नाम : Father "), c.cast("string"), F.lit("\nमकान संख्या : "), c.cast("string"), F.lit("\nABC"), F.lpad(c.cast("string"), 7, "0"))
    place = lambda c, x: F.struct(text(c).alias("text"), F.lit(float(x)).alias("x0"), F.lit(100.0).alias("y0"), F.lit(float(x + 150)).alias("x1"), F.lit(200.0).alias("y1"))
    blocks = _table(spark, sf_dir, "customer").select(k.cast("long").alias("document_id"), F.lit(1).alias("page_number"), F.explode(F.array(place(k, 20), place(k + 500_000, 420))).alias("b")).select("document_id", "page_number", "b.*")
    return _card_columns(cards.spatial(blocks))


@query("SELECT c_custkey::BIGINT AS document_id, c_custkey % 4 <> 0 AS is_cards FROM customer")
def page_routing(spark, sf_dir):
    from . import ingest

    pages = _side_by_side(spark, sf_dir).withColumn("raw_text", F.when(F.col("document_id") % 4 == 0, "Just a plain page").otherwise(F.col("raw_text")))
    return ingest.routed(pages).select("document_id", "is_cards")


@query("SELECT DISTINCT p_size::BIGINT AS document_id, 'Part Type: ' || p_type AS name, 0.9::DOUBLE AS confidence FROM part")
def column_categories(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    found = p.groupBy(F.col("p_size").cast("long").alias("document_id")).agg(F.collect_list(F.array("p_name", F.concat(F.lit(" "), "p_type"))).alias("rows"))
    found = found.withColumns({"page_number": F.lit(1), "headers": F.array(F.lit("Name"), F.lit("Part Type"))})
    return categories.from_columns(found).select("document_id", "name", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT DISTINCT p_size::BIGINT AS document_id, t.name FROM part, LATERAL (SELECT 'Annual Report ' || p_size AS name UNION ALL SELECT 'ROSTER OF ' || p_size) t")
def text_headings(spark, sf_dir):
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit("  Annual Report "), n, F.lit("\nplain details of it\nROSTER OF "), n, F.lit("\nList\nA Very Long Heading About Details That Goes On And On Beyond Fifty\nNames Alone"))
    pages = _table(spark, sf_dir, "part").select("p_size").distinct().select(F.col("p_size").cast("long").alias("document_id"), F.lit(1).alias("page_number"), text.alias("raw_text"))
    return categories.headings(pages).select("document_id", "name")


@query("SELECT p_size::BIGINT AS document_id, 'Big ' || p_size AS name, 0.7::DOUBLE AS confidence FROM (SELECT DISTINCT p_size FROM part)")
def large_print_categories(spark, sf_dir):
    n = _table(spark, sf_dir, "part").select("p_size").distinct()
    block = lambda t, size, y: F.struct(t.alias("text"), F.lit(float(size)).alias("font_size"), F.lit(float(y)).alias("y0"))
    name = F.concat(F.lit(" Big "), F.col("p_size"))
    blocks = n.select(F.col("p_size").cast("long").alias("document_id"), F.lit(1).alias("page_number"), F.explode(F.array(block(name, 20, 10), block(F.lit("small"), 11, 40), block(F.repeat(F.lit("x"), 120), 20, 60))).alias("b")).select("document_id", "page_number", "b.*")
    return categories.large_print(blocks).select("document_id", "name", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT p_partkey AS document_id, 'Name|Type' AS headers, p_name || '|' AS row, 0.95::DOUBLE AS confidence FROM part")
def raw_tables(spark, sf_dir):
    none = F.lit(None).cast("string")
    raw = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("part"), F.array(F.array(F.lit("Name"), F.lit(" Type ")), F.array(F.concat(F.lit("  "), "p_name"), none)).alias("rows"))
    out = tables.from_raw(raw, 0.95)
    return out.select("document_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.col("rows")[0], "|").alias("row"), F.col("confidence").cast("double").alias("confidence"))


_KINDS = """WITH s AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS document_id, p_partkey::VARCHAR AS serial, p_name AS name, p_type AS type FROM part) SELECT document_id, serial, name, type FROM s"""


@query(_KINDS)
def tables_of_any_kind(spark, sf_dir):
    """Every third brand's table has bars, tabs or aligned columns: the whole cascade decides."""
    p = _table(spark, sf_dir, "part").withColumn("document_id", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long"))
    gap = F.when(F.col("document_id") % 3 == 0, " | ").when(F.col("document_id") % 3 == 1, "\t").otherwise("   ")
    edge = F.when(F.col("document_id") % 3 == 0, "|").otherwise("")
    line = lambda a, b, c: F.concat(edge, a, gap, b, gap, c, edge)
    own = p.select("document_id", "p_partkey", line(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type")).alias("line"), line(F.lit("Serial No"), F.lit("Name"), F.lit("Type")).alias("head"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n")
    pages = own.groupBy("document_id", "head").agg(body.alias("body")).select("document_id", F.lit(1).alias("page_number"), F.concat("head", F.lit("\n"), "body").alias("raw_text"))
    rows = tables.records(tables.detect(pages))
    return rows.select("document_id", F.col("data")["serial_no"].alias("serial"), F.col("data")["name"].alias("name"), F.col("data")["type"].alias("type"))


@query("SELECT o_custkey AS document_id, count(DISTINCT o_orderkey % 7 + 1) AS pages FROM orders GROUP BY 1")
def source_pages(spark, sf_dir):
    return export.source_pages(_orders(spark, sf_dir), "document_id")


@query("SELECT c_custkey AS id, CASE WHEN contains(c_name, '12') THEN substr(c_name, 1, position('12' IN c_name) - 1) || '<b>12</b>' || substr(c_name, position('12' IN c_name) + 2) ELSE c_name END AS shown FROM customer")
def highlighted_names(spark, sf_dir):
    """Every customer's name, with what a query in other digits finds in it."""
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), snippets.highlight(F.col("c_name"), F.lit("१२"), ["१२"]).alias("shown"))
