"""Registered queries over the driver's tables, with their DuckDB equivalents.

Adapters give the driver's rows the shape of stored records and pages; every query runs over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import snippets
from ..functions import text as T
from ..operators import cards, categories, fulltext, layout, longpages, relational, search, tables
from ..sinks import export
from ..sources import pages as sources
from ..streaming import inbox

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- adapters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_table(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _map(**columns):
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("document_id"), (F.col("p_partkey") % 50 + 1).cast("int").alias("page_number"), (F.col("p_partkey") % 5).alias("category_id"),
        _map(name=F.col("p_name"), voter_id=F.col("p_brand"), house_no=F.col("p_size").cast("string"), kind=F.col("p_type")).alias("data"), F.concat_ws(" ", "p_name", "p_type").alias("source_text"),
    )


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).cast("long").alias("category_id"),
        _map(role=F.col("role")).alias("data"), F.col("text").alias("source_text"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("page_number"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).cast("long").alias("category_id"),
        F.when(F.col("o_orderkey") % 3 == 0, _map(name=F.col("o_orderpriority"), village=F.col("o_orderstatus"))).otherwise(_map(name=F.col("o_orderpriority"), total=F.floor("o_totalprice").cast("string"))).alias("data"), F.col("o_orderpriority").alias("source_text"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), (F.hour("ts") + 1).alias("page_number"), F.lit(0).cast("long").alias("category_id"), F.from_json("props", "map<string,string>").alias("data"), F.col("event_type").alias("source_text"))


_P = "p AS (SELECT p_partkey AS id, p_size::BIGINT AS document_id, (p_partkey % 50 + 1)::INT AS page_number, p_partkey % 5 AS category_id, p_name AS name, p_brand AS voter_id, p_size::VARCHAR AS house_no, p_type AS kind FROM part)"
_T = "t AS (SELECT conv_id * 1000 + turn AS id, conv_id AS document_id, (turn + 1)::INT AS page_number, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END::BIGINT AS category_id, role, text AS source_text FROM conversations)"
_O = "o AS (SELECT o_orderkey AS id, o_custkey AS document_id, (o_orderkey % 7 + 1)::INT AS page_number, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS category_id, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS village, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice)::BIGINT::VARCHAR END AS total FROM orders)"


# ---------------------------------------------------------------- search

#: A word in every part table.
WORD = "ring"
_LADDER = f"""
WITH {_P}, s AS (
  SELECT *, greatest(
    CASE WHEN lower(name) = '{WORD}' THEN 1000 WHEN list_contains(string_split(lower(name), ' '), '{WORD}') THEN 900 WHEN starts_with(lower(name), '{WORD}') THEN 850 WHEN contains(lower(name), '{WORD}') THEN 700 ELSE 0 END,
    {{more}} 0)::DOUBLE AS rank FROM p
) SELECT id AS record_id, document_id, page_number, coalesce(r_name, '') AS category_name, rank FROM s LEFT JOIN region ON category_id = r_regionkey WHERE rank > 0
ORDER BY page_number, rank DESC, id LIMIT 500
"""
_MORE = f"CASE WHEN lower(voter_id) = '{WORD}' THEN 950 WHEN contains(lower(voter_id), '{WORD}') THEN 750 ELSE 0 END, CASE WHEN lower(house_no) = '{WORD}' THEN 600 WHEN contains(lower(house_no), '{WORD}') THEN 400 ELSE 0 END, CASE WHEN lower(kind) = '{WORD}' THEN 650 WHEN list_contains(string_split(lower(kind), ' '), '{WORD}') THEN 600 WHEN contains(lower(kind), '{WORD}') THEN 500 ELSE 0 END,"


def _found(spark: SparkSession, sf_dir: str, word: str, scope: str, limit: int = 500) -> DataFrame:
    hits = search.record_hits(_parts(spark, sf_dir), _groups(spark, sf_dir), word, scope, limit)
    return hits.select("record_id", "document_id", "page_number", "category_name", "rank")


@query(_LADDER.format(more=_MORE))
def search_name_all(spark, sf_dir):
    return _found(spark, sf_dir, WORD, "all")


@query(_LADDER.format(more=""))
def search_scope_name(spark, sf_dir):
    return _found(spark, sf_dir, WORD, "name")


@query(f"""WITH {_P} SELECT id AS record_id, document_id, page_number, coalesce(r_name, '') AS category_name, CASE WHEN lower(voter_id) = 'brand#1' THEN 1000.0 ELSE 800.0 END::DOUBLE AS rank
FROM p LEFT JOIN region ON category_id = r_regionkey WHERE contains(lower(voter_id), 'brand#1') ORDER BY page_number, rank DESC, id LIMIT 500""")
def search_scope_id(spark, sf_dir):
    return _found(spark, sf_dir, "Brand#1", "voter id")


@query(f"""WITH {_P}, s AS (SELECT *, CASE WHEN regexp_matches(name, '\\b{WORD}\\b', 'i') THEN 950 WHEN regexp_matches(voter_id, '\\b{WORD}\\b', 'i') THEN 850 WHEN regexp_matches(house_no, '\\b{WORD}\\b', 'i') OR regexp_matches(kind, '\\b{WORD}\\b', 'i') THEN 700 ELSE 0 END::DOUBLE AS rank FROM p)
SELECT id AS record_id, document_id, page_number, coalesce(r_name, '') AS category_name, rank FROM s LEFT JOIN region ON category_id = r_regionkey WHERE rank > 0 ORDER BY page_number, rank DESC, id LIMIT 500""")
def search_scope_exact(spark, sf_dir):
    return _found(spark, sf_dir, WORD, "exact")


_NORM = r"trim(regexp_replace(replace(replace(regexp_replace(coalesce({}, ''), '[\x{{200C}}\x{{200D}}\x{{FEFF}}\x{{200B}}\x{{200E}}\x{{200F}}]', '', 'g'), '।', ' '), '॥', ' '), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))"
_SNIP = """CASE WHEN pos = 0 THEN '' ELSE (CASE WHEN pos > 41 THEN '...' ELSE '' END) || substr(n, greatest(pos - 40, 1), pos - greatest(pos - 40, 1)) || '<b>' || substr(n, pos, 4) || '</b>' || substr(n, pos + 4, 40) || (CASE WHEN pos + 43 < length(n) THEN '...' ELSE '' END) END"""


@query(f"""WITH d AS (SELECT doc_id, {_NORM.format("text")} AS n FROM documents), h AS (SELECT *, position('worm' IN replace(lower(n), 'tion', 'worm')) AS pos0, position('tion' IN lower(n)) AS pos FROM d WHERE contains(lower(n), 'tion'))
SELECT doc_id AS document_id, 1 AS page_number, {_SNIP} AS context_snippet, 100.0::DOUBLE AS rank FROM h""")
def search_pages(spark, sf_dir):
    return search.page_hits(_pages(spark, sf_dir), "tion").select("document_id", "page_number", "context_snippet", "rank")


@query(f"""WITH {_T}, d AS (SELECT doc_id, lower({_NORM.format("text")}) AS n FROM documents), r AS (
  SELECT id AS record_id, document_id, page_number, 250.0::DOUBLE AS rank FROM t WHERE contains(lower({_NORM.format("source_text")}), 'tion')
), u AS (SELECT * FROM r UNION ALL SELECT NULL, doc_id, 1, 100.0 FROM d WHERE contains(n, 'tion') AND NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = doc_id AND r.page_number = 1))
SELECT * FROM u ORDER BY page_number, rank DESC, coalesce(record_id, 0), document_id LIMIT 500""")
def search_union(spark, sf_dir):
    hits = search.search(_talks(spark, sf_dir), _pages(spark, sf_dir), _groups(spark, sf_dir), "tion")
    return hits.select("record_id", "document_id", "page_number", "rank")


@query(f"""WITH {_T} SELECT id AS record_id, page_number, 'AFRICA' AS category_name FROM t WHERE category_id = 0 AND contains(lower(source_text), 'tion') ORDER BY page_number, id LIMIT 500""")
def search_in_category(spark, sf_dir):
    return search.search_in_category(_talks(spark, sf_dir), _groups(spark, sf_dir), "tion", 0).select("record_id", "page_number", "category_name")


@query(f"WITH {_T} SELECT id, page_number FROM t WHERE lower(source_text) LIKE '%the%ing%' OR lower(role) LIKE '%the%ing%'")
def search_records_like(spark, sf_dir):
    return relational.like(_talks(spark, sf_dir), "The%ing").select("id", "page_number")


@query(f"WITH {_T} SELECT page_number::VARCHAR AS page, count(*) AS hits FROM t WHERE contains(lower(source_text), 'tion') GROUP BY 1")
def page_hit_counts(spark, sf_dir):
    return search.page_counts(search.record_hits(_talks(spark, sf_dir), _groups(spark, sf_dir), "tion"))


@query(f"WITH {_T} SELECT count(DISTINCT page_number) AS pages FROM t WHERE contains(lower(source_text), 'tion')")
def distinct_hit_pages(spark, sf_dir):
    return search.record_hits(_talks(spark, sf_dir), _groups(spark, sf_dir), "tion").agg(F.count_distinct("page_number").alias("pages"))


@query("""SELECT p_partkey, replace(lower(p_name), 'ring', 'ring') = lower(p_name) AS same, CASE WHEN position('ring' IN lower(p_name)) = 0 THEN p_name ELSE substr(p_name, 1, position('ring' IN lower(p_name)) - 1) || '<b>' || substr(p_name, position('ring' IN lower(p_name)), 4) || '</b>' || substr(p_name, position('ring' IN lower(p_name)) + 4) END AS bold FROM part""")
def highlight_term(spark, sf_dir):
    bold = _table(spark, sf_dir, "part").select("p_partkey", "p_name", snippets.highlight(F.col("p_name"), F.lit(WORD), [WORD]).alias("bold"))
    return bold.select("p_partkey", (F.regexp_replace("bold", "</?b>", "") == F.col("p_name")).alias("same"), "bold")


@query(r"""SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: starts_with(x, 'tion'))) > 0 AND len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: starts_with(x, 'ing'))) > 0""")
def fts_prefix_and(spark, sf_dir):
    return fulltext.plain_prefix(_table(spark, sf_dir, "documents"), "tion ing*".replace("*", "")).select("doc_id")


@query(f"""WITH {_T}, x AS (SELECT document_id, page_number, id AS record_id, source_text || ' ' || role AS text FROM t UNION ALL SELECT doc_id, 1, NULL, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = doc_id AND t.page_number = 1)),
w AS (SELECT *, string_split_regex(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+') AS words FROM x)
SELECT document_id, page_number, record_id, 50.0::DOUBLE AS rank FROM w WHERE len(list_filter(words, lambda x: starts_with(x, 'tion'))) > 0 AND len(list_filter(words, lambda x: starts_with(x, 'the'))) > 0""")
def fts_stemmed(spark, sf_dir):
    index = fulltext.build(_talks(spark, sf_dir), _pages(spark, sf_dir), _groups(spark, sf_dir))
    return fulltext.match(index, "tioned the").select("document_id", "page_number", "record_id", "rank")


@query(f"""WITH {_T} SELECT document_id, page_number, id AS record_id, trim(source_text || ' ' || role) AS text, coalesce(r_name, '') AS category_name FROM t LEFT JOIN region ON category_id = r_regionkey
UNION ALL SELECT doc_id, 1, NULL, text, '' FROM documents WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = doc_id AND t.page_number = 1)""")
def index_build(spark, sf_dir):
    return fulltext.build(_talks(spark, sf_dir), _pages(spark, sf_dir), _groups(spark, sf_dir))


@query(f"""WITH {_T}, w AS (SELECT doc_id AS document_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
b AS (SELECT DISTINCT document_id, 1 AS page_number, (i * 10)::DOUBLE AS x0, 0::DOUBLE AS y0, (i * 10 + 8)::DOUBLE AS x1, 10::DOUBLE AS y1 FROM w WHERE contains(lower(word), 'tion'))
SELECT * FROM b UNION SELECT document_id, page_number, 5, 7, 25, 37 FROM t WHERE contains(lower(source_text), 'tion') AND NOT EXISTS (SELECT 1 FROM b WHERE b.document_id = t.document_id AND b.page_number = t.page_number)""")
def highlight_boxes(spark, sf_dir):
    w = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    x = ((F.col("i") + 1) * 10).cast("double")
    boxes = w.select("document_id", F.lit(1).alias("page_number"), "text", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 8).alias("x1"), F.lit(10.0).alias("y1"), F.lit("word").alias("block_type"))
    box = F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y"), F.lit(20.0).alias("w"), F.lit(30.0).alias("h"))
    return search.highlight_boxes(boxes, _talks(spark, sf_dir).withColumn("bbox", box), "tion")


# ---------------------------------------------------------------- text functions


@query(f"SELECT doc_id, {_NORM.format('nfc_normalize(text)')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text"), nfc=True).alias("text"))


_STRIP = "text"
for _p in ("Elector'?s?\\s*Name", "Father'?s?\\s*Name", "Husband'?s?\\s*Name", "House\\s*No\\.?", "Age", "Gender"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p.replace(chr(39), chr(39) * 2)}\\s*[:\\-.]?', ' ', 'gi')"


@query(f"SELECT p_partkey AS id, trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')) AS text FROM (SELECT p_partkey, 'Elector''s Name: ' || p_name || ' House No. ' || p_size || ' Age : 3 page ' || p_type AS text FROM part)")
def strip_labels(spark, sf_dir):
    text = F.concat(F.lit("Elector's Name: "), F.col("p_name"), F.lit(" House No. "), F.col("p_size"), F.lit(" Age : 3 page "), F.col("p_type"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.strip_labels(text).alias("text"))


@query(r"SELECT p_partkey AS id, regexp_replace(regexp_replace(trim(lower(p_type || '. (' || p_brand || ')')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', '_', 'g') AS field FROM part")
def field_name_norm(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.field_name(F.concat("p_type", F.lit(". ("), "p_brand", F.lit(")"))).alias("field"))


@query(r"""WITH c AS (SELECT c_custkey AS id, unnest([c_custkey::VARCHAR, c_name, 'a.b' || c_custkey || '@mail.example', '+49 ' || lpad(c_custkey::VARCHAR, 10, '7')]) AS value FROM customer)
SELECT id, value, CASE WHEN regexp_matches(value, '^\d+$') THEN 'number' WHEN regexp_matches(value, '^[\w.-]+@[\w.-]+\.\w+$') THEN 'email' WHEN regexp_matches(regexp_replace(value, '[\s-]', '', 'g'), '^\+?\d{10,15}$') THEN 'phone' ELSE 'text' END AS type FROM c""")
def field_type(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    values = F.array(k, F.col("c_name"), F.concat(F.lit("a.b"), k, F.lit("@mail.example")), F.concat(F.lit("+49 "), F.lpad(k, 10, "7")))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(values).alias("value")).withColumn("type", T.field_type(F.col("value")))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 14 THEN 'heading' WHEN p_retailprice > 0.9 * 1000 THEN 'footer' ELSE 'text' END AS block_type FROM part")
def block_classify(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.block_type(F.col("p_size"), F.col("p_retailprice"), F.lit(1000.0)).alias("block_type"))


# ---------------------------------------------------------------- extraction


@query("SELECT o_orderkey AS document_id, 1 AS page_number, 'order: ' || o_orderkey || ' | status: ' || o_orderstatus AS joined FROM orders")
def kv_pairs(spark, sf_dir):
    text = F.concat(F.lit("Order: "), F.col("o_orderkey"), F.lit("\nStatus - "), F.col("o_orderstatus"), F.lit("\nmore: a: "))
    pages = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("page_number"), text.alias("raw_text"))
    found = cards.form_records(pages)
    return found.select("document_id", "page_number", F.concat(F.lit("order: "), F.col("data")["order"], F.lit(" | status: "), F.col("data")["status"]).alias("joined"))


def _rendered(spark: SparkSession, sf_dir: str, gap: str, edge: str = "") -> DataFrame:
    """One page for each brand: its parts as a table with a header."""
    p = _table(spark, sf_dir, "part")
    line = F.concat(F.lit(edge), F.concat_ws(gap, F.col("p_partkey").cast("string"), "p_name", "p_type"), F.lit(edge))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n")
    head = edge + gap.join(["Serial No", "Name", "Type"]) + edge
    page = p.groupBy(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("document_id")).agg(F.concat(F.lit(head + "\n"), body).alias("raw_text"))
    return page.withColumn("page_number", F.lit(1))


_RENDERED = "SELECT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS document_id, 1 AS page_number, p_partkey::VARCHAR AS serial, p_name AS name, p_type AS type{} FROM part"


def _read_back(pages: DataFrame, finder) -> DataFrame:
    rows = tables.records(tables.detect(pages, finder))
    return rows.select("document_id", "page_number", F.col("data")["serial_no"].alias("serial"), F.col("data")["name"].alias("name"), F.col("data")["type"].alias("type"))


@query(_RENDERED.format(""))
def delimited_tables(spark, sf_dir):
    return _read_back(_rendered(spark, sf_dir, "\t"), ("delimited",))


@query(_RENDERED.format(""))
def aligned_tables(spark, sf_dir):
    return _read_back(_rendered(spark, sf_dir, "   "), ("aligned",))


@query(_RENDERED.format(""))
def table_records(spark, sf_dir):
    return _read_back(_rendered(spark, sf_dir, " | ", "|"), ("piped",))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE contains(text, '|')),
c AS (SELECT doc_id, i, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM l WHERE contains(line, '|')),
g AS (SELECT doc_id, i, cells FROM c WHERE len(cells) >= 2 AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^[-:]+$'))) > 0)
SELECT doc_id AS document_id, count(*) - 1 AS n_rows, max(len(cells)) AS n_columns, arg_min(cells[1], i) AS first FROM g GROUP BY 1 HAVING count(*) >= 2""")
def pipe_tables(spark, sf_dir):
    found = tables.detect(_pages(spark, sf_dir), ("piped",))
    return found.select("document_id", F.size("rows").cast("long").alias("n_rows"), F.size("headers").cast("long").alias("n_columns"), F.col("headers")[0].alias("first"))


_CARDS = "SELECT c_nationkey::BIGINT AS document_id, 1 AS page_number, c_name AS name, 'R' || c_custkey AS relation_name, c_custkey::VARCHAR AS house_no, (18 + c_custkey % 60)::VARCHAR AS age, CASE WHEN c_custkey % 2 = 0 THEN 'पुरुष' ELSE 'महिला' END AS gender FROM customer"


def _card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each nation: its customers' cards, one after another."""
    k = F.col("c_custkey").cast("string")
    id_ = F.concat(F.lit("ABC"), F.lpad((F.col("c_custkey") % 9999999).cast("string"), 7, "0"))
    card = F.concat((F.col("c_custkey") % 9999).cast("string"), F.lit(" "), id_, F.lit("\nElector's Name : "), F.col("c_name"), F.lit("\nFather's Name : R"), k, F.lit("\nHouse No : "), k, F.lit("\nAge : "), (18 + F.col("c_custkey") % 60).cast("string"), F.lit(" Gender : "), F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("Female"))
    return _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("t")))), lambda x: x["t"]), "\n").alias("raw_text")).withColumn("page_number", F.lit(1))


@query(_CARDS)
def cards_sequential(spark, sf_dir):
    found = cards.sequential(_card_pages(spark, sf_dir))
    return found.select("document_id", "page_number", *[F.col("data")[c].alias(c) for c in ("name", "relation_name", "house_no", "age", "gender")])


@query(_CARDS)
def cards_by_line(spark, sf_dir):
    """The same cards from lines in chunks."""
    found = longpages.sequential(_card_pages(spark, sf_dir))
    return found.select("document_id", "page_number", *[F.col("data")[c].alias(c) for c in ("name", "relation_name", "house_no", "age", "gender")])


@query("""WITH n AS (SELECT DISTINCT p_size FROM part), d AS (SELECT p_size::BIGINT AS document_id, unnest(['Class ' || p_size || ' - Section ' || chr((65 + p_size % 5)::INT), 'Class ' || p_size, 'Section ' || chr((65 + p_size % 5)::INT)]) AS name FROM n)
SELECT document_id, name, 0.8::DOUBLE AS confidence, 1 AS pages FROM d""")
def category_patterns(spark, sf_dir):
    n = _table(spark, sf_dir, "part").select("p_size").distinct()
    text = F.concat(F.lit("Some intro\nClass "), F.col("p_size"), F.lit(" - Section "), F.chr(65 + F.col("p_size") % 5), F.lit("\nrows"))
    pages = n.select(F.col("p_size").cast("long").alias("document_id"), F.lit(1).alias("page_number"), text.alias("raw_text"))
    return categories.merge(categories.named(pages)).select("document_id", "name", "confidence", F.size("pages").alias("pages"))


@query("""SELECT p_size::BIGINT AS document_id, arg_min(p_type, p_partkey) AS name, list_sort(list_distinct(list((p_partkey % 50 + 1)::INT)))::VARCHAR AS pages, max(p_partkey)::DOUBLE AS confidence FROM part GROUP BY p_size, lower(p_type)""")
def category_merge(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    found = p.select(F.col("p_size").cast("long").alias("document_id"), F.lit(0).alias("x"), F.col("p_type").alias("name"), F.col("p_partkey").cast("double").alias("confidence"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 50 + 1).cast("int").alias("page_number"))
    # Detection order is that of the keys here, so pages do not come first.
    first = found.groupBy("document_id", F.lower("name").alias("k")).agg(F.min_by("name", "ord").alias("name")).drop("k")
    merged = categories.merge(found).drop("name", "first").withColumn("text", F.concat(F.lit("["), F.array_join(F.transform("pages", lambda x: x.cast("string")), ", "), F.lit("]")))
    names = categories.merge(found).select("document_id", F.lower("name").alias("k"), F.col("pages").alias("own"), "confidence")
    out = names.join(first.withColumn("k", F.lower("name")), ["document_id", "k"])
    text = F.concat(F.lit("["), F.array_join(F.transform("own", lambda x: x.cast("string")), ", "), F.lit("]"))
    return out.select("document_id", "name", text.alias("pages"), "confidence")


_FOUND = [(1, 0, "tin", [3, 4]), (2, 1, "ring", [4, 5, 6]), (3, 2, "brass", [99])]


@query(f"""WITH {_P}, f(cid, ord, word, lo, hi) AS (VALUES (1, 0, 'tin', 3, 4), (2, 1, 'ring', 4, 6), (3, 2, 'brass', 99, 99))
SELECT id, coalesce((SELECT arg_min(cid, ord) FROM f WHERE page_number BETWEEN lo AND hi), (SELECT arg_max(cid, ord) FROM f WHERE contains(lower(name), word) OR contains(lower(kind), word)))::BIGINT AS category_id FROM p""")
def category_assign(spark, sf_dir):
    found = spark.createDataFrame(_FOUND, "id bigint, ord int, name string, pages array<int>").withColumn("document_id", F.lit(1).cast("long"))
    parts = _parts(spark, sf_dir).drop("category_id").withColumn("document_id", F.lit(1).cast("long"))
    return relational.assign_categories(parts, found).select("id", "category_id")


# ---------------------------------------------------------------- records


@query(f"WITH {_O} SELECT id, page_number FROM o WHERE category_id = 1 ORDER BY page_number, id LIMIT 100 OFFSET 20")
def records_by_document(spark, sf_dir):
    return relational.of_document(_orders(spark, sf_dir), category_id=1, sort_by="nonsense", descending=True, limit=100, offset=20).select("id", "page_number")


@query(f"WITH {_O} SELECT id, page_number, name FROM o WHERE id IN (3, 1, 32, 7, 64)")
def records_in_ids(spark, sf_dir):
    return relational.by_ids(_orders(spark, sf_dir), [3, 1, 32, 7, 64]).select("id", "page_number", F.col("data")["name"].alias("name"))


@query(f"WITH {_O} SELECT id FROM o WHERE category_id = 0 AND page_number BETWEEN 2 AND 4 AND lower(village) = 'f'")
def filtered_records(spark, sf_dir):
    return relational.filtered(_orders(spark, sf_dir), {"category_id": 0, "page_range": (2, 4), "fields": {"village": "F"}}).select("id")


@query("SELECT doc_id AS id, source FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def has_corrections(spark, sf_dir):
    records = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("page_number"), "source")
    return relational.filtered(records, {"has_corrections": True}, _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "record_id")).select("id", "source")


@query("SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k') = '87'")
def field_filter(spark, sf_dir):
    return relational.filtered(_events(spark, sf_dir), {"fields": {"k": "87"}}).select("id")


@query("SELECT DISTINCT unnest(json_keys(props)) AS field FROM events UNION SELECT unnest(['name', 'total', 'village'])")
def field_names(spark, sf_dir):
    both = _events(spark, sf_dir).select("data").unionByName(_orders(spark, sf_dir).select("data"))
    return relational.field_names(both)


@query(f"WITH {_O}, k AS (SELECT 'name' AS field, count(name) AS n FROM o UNION ALL SELECT 'village', count(village) FROM o UNION ALL SELECT 'total', count(total) FROM o) SELECT field, n, row_number() OVER (ORDER BY CASE field WHEN 'name' THEN 4 WHEN 'village' THEN 10 ELSE 99 END)::INT AS position FROM k WHERE n >= greatest(2, floor((SELECT count(*) FROM o) / 10))")
def export_fields(spark, sf_dir):
    return export.field_table(_orders(spark, sf_dir))


@query(f"WITH {_O} SELECT id, page_number, coalesce(r_name, '') AS category_name, '' AS serial_no, name, coalesce(total, '') AS total, coalesce(village, '') AS village FROM o LEFT JOIN region ON category_id = r_regionkey")
def records_grid(spark, sf_dir):
    return relational.grid(_orders(spark, sf_dir), _groups(spark, sf_dir), ["serial_no", "name"])


@query(f"WITH {_O} SELECT r_regionkey::BIGINT AS id, r_name AS name, (SELECT count(*) FROM o WHERE category_id = r_regionkey) AS record_count FROM region")
def category_counts(spark, sf_dir):
    return export.scope_counts(_orders(spark, sf_dir), _groups(spark, sf_dir))


@query("SELECT n_regionkey::BIGINT AS id, count(*) AS record_count FROM nation GROUP BY 1")
def scope_counts(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("category_id"))
    return relational.category_counts(_groups(spark, sf_dir), nations).select("id", "record_count")


@query(f"WITH {_O} SELECT category_id, count(*) AS records, min(id) AS first FROM o GROUP BY 1")
def group_first_seen(spark, sf_dir):
    return relational.first_seen_groups(_orders(spark, sf_dir))


_SHAPED = f"WITH {_O}, s AS (SELECT id, coalesce(name, '') AS name, coalesce(village, '') AS village, coalesce(total, '') AS total, coalesce(r_name, '') AS category, page_number::VARCHAR AS source_page FROM o LEFT JOIN region ON category_id = r_regionkey)"


@query(_SHAPED + " SELECT * FROM s")
def export_csv_rows(spark, sf_dir):
    return export.shaped(_orders(spark, sf_dir), _groups(spark, sf_dir), ["name", "village", "total"])


@query(_SHAPED + " SELECT id, category, '| ' || name || ' | ' || village || ' | ' || total || ' | ' || category || ' | ' || source_page || ' |' AS line FROM s")
def export_markdown_rows(spark, sf_dir):
    names = ["name", "village", "total"]
    return export.markdown_rows(export.shaped(_orders(spark, sf_dir), _groups(spark, sf_dir), names), names)


@query(_SHAPED + """ SELECT id, '{"name":"' || name || CASE WHEN id % 3 = 0 THEN '","village":"' || village ELSE '","total":"' || total END || '","category":"' || category || '","source_page":"' || source_page || '"}' AS json FROM s""")
def export_json_rows(spark, sf_dir):
    return export.json_rows(_orders(spark, sf_dir), _groups(spark, sf_dir))


@query(_SHAPED + " SELECT category, greatest(max(length(name)), 4)::INT AS name, greatest(max(length(village)), 7)::INT AS village, greatest(max(length(source_page)), 11)::INT AS source_page, greatest(max(length(category)), 8)::INT AS category_width FROM s GROUP BY 1")
def txt_widths(spark, sf_dir):
    names = ["name", "village"]
    return export.widths(export.shaped(_orders(spark, sf_dir), _groups(spark, sf_dir), names), names)


@query("SELECT p_partkey AS id, p_size::DOUBLE AS sort_key FROM part")
def grid_sort_numeric(spark, sf_dir):
    return relational.grid_order(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("c")), "c").select("id", "sort_key")


@query("SELECT p_partkey AS id, lower(p_name) AS sort_key FROM part")
def grid_sort_text(spark, sf_dir):
    return relational.grid_order(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("c")), "c").select("id", "sort_key")


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name, n_name AS child FROM region JOIN nation ON n_regionkey = r_regionkey")
def category_children(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent_id"))
    return relational.children(_groups(spark, sf_dir).unionByName(n))


@query(f"WITH {_O} SELECT CASE WHEN category_id IN (0, 2) THEN 1 ELSE category_id END AS category_id, count(*) AS n FROM o GROUP BY 1")
def merge_categories(spark, sf_dir):
    moved, _ = relational.merge_categories(_orders(spark, sf_dir), _groups(spark, sf_dir), [0, 2], 1)
    return moved.groupBy("category_id").agg(F.count("*").alias("n"))


@query(f"WITH {_O} SELECT id, CASE WHEN id IN (1, 2, 3) THEN 4 ELSE category_id END::BIGINT AS category_id FROM o")
def move_records(spark, sf_dir):
    return relational.move(_orders(spark, sf_dir), [1, 2, 3], 4).select("id", F.col("category_id").cast("long").alias("category_id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_cascade(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return relational.delete(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query(f"WITH {_O} SELECT id AS record_id, 'village' AS field_name, village AS original_value, '' AS corrected_value FROM o WHERE village IS NOT NULL UNION ALL SELECT id, 'age', '', '7' FROM o")
def corrections_diff(spark, sf_dir):
    o = _orders(spark, sf_dir)
    new = o.withColumn("data", F.map_concat(F.map_filter("data", lambda k, v: k != "village"), F.create_map(F.lit("age"), F.lit("7"))))
    return relational.corrections(o, new)


@query("SELECT r_name AS key, CASE WHEN r_name = 'ASIA' THEN 'new' ELSE r_regionkey::VARCHAR END AS value FROM region UNION ALL SELECT 'last_saved', 'now'")
def meta_upsert(spark, sf_dir):
    meta = _table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return relational.upsert(meta, spark.createDataFrame([("ASIA", "new"), ("last_saved", "now")], "key string, value string"))


@query("SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'records', count(*) FROM orders")
def workspace_stats(spark, sf_dir):
    return relational.statistics(*[_table(spark, sf_dir, t) for t in ("documents", "pages", "orders")])


@query("SELECT doc_id AS document_id, 1 AS page_number, length(trim(text)) > 10 AS has_text, CASE WHEN length(trim(text)) > 100 THEN 0.8 WHEN length(trim(text)) > 10 THEN 0.3 ELSE 0.0 END::DOUBLE AS text_share FROM documents")
def page_facts(spark, sf_dir):
    none = F.lit(None).cast("double")
    return layout.page_facts(_pages(spark, sf_dir).withColumns({"width": none, "height": none})).select("document_id", "page_number", "has_text", "text_share")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return inbox.event_counts(_table(spark, sf_dir, "events"))


_ROSTER = [
    (1, 1, "राजेन्द्र सिंह", "पिता", "रामेश्वर सिंह", "EPIC1001", "14", "48", "पुरुष", "बाज़िदपुर", "अध्यक्ष"),
    (2, 2, "शान्ति देवी", "पति", "राजेन्द्र सिंह", "EPIC1002", "14", "45", "महिला", "बाज़िदपुर", "सदस्य"),
    (3, 3, "गोविन्द प्रसाद", "पिता", "हरि प्रसाद", "EPIC1003", "22", "32", "पुरुष", "रामपुर", "सचिव"),
]
ROSTER_KEYS = ["name", "relation_type", "relation_name", "voter_id", "house_no", "age", "gender", "village", "designation"]


def roster(spark: SparkSession) -> DataFrame:
    rows = [(r[0], 1, r[1], None, dict(zip(ROSTER_KEYS, r[2:], strict=True)), "") for r in _ROSTER]
    return spark.createDataFrame(rows, "id bigint, document_id bigint, page_number int, category_id bigint, data map<string,string>, source_text string")


@query("SELECT c_custkey AS record_id, (c_custkey % 9 + 1)::INT AS page_number, CASE WHEN c_custkey % 3 = 0 THEN 900.0 ELSE 700.0 END::DOUBLE AS rank FROM customer WHERE c_custkey % 3 < 2")
def devanagari_variants_search(spark, sf_dir):
    """Every customer as a person of a roster: names that begin with one spelling, hold the other, or neither."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("राजेन्द्र सिंह "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("श्रीराजेंद्र "), k.cast("string"))).otherwise(F.concat(F.lit("शान्ति देवी "), k.cast("string")))
    rows = _table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(1).cast("long").alias("document_id"), (k % 9 + 1).cast("int").alias("page_number"), F.lit(None).cast("long").alias("category_id"), _map(name=name).alias("data"), F.lit("").alias("source_text"))
    return search.record_hits(rows, _groups(spark, sf_dir), "राजेंद्र").select("record_id", "page_number", "rank")
