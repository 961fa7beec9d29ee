"""Registered queries of streams, trees, variants, workspaces in buckets and the rest, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import variant
from ..operators import cards, hierarchy, relational, search
from ..streaming import events as streams
from ..streaming import replay
from .catalogue import _O, _P, _T, _groups, _orders, _pages, _parts, _table, _talks, query
from .workspace import Workspace

# ---------------------------------------------------------------- streams

_SESSIONS = """e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e),
s AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events, round(sum(value), 4) + 0.0 AS value FROM g GROUP BY user_id, s)"""


@query(f"WITH {_SESSIONS} SELECT * FROM s")
def event_sessions(spark, sf_dir):
    return streams.sessions(_table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4) + 0.0)


def _late(events):
    """Events in four chunks by time: some come up to six hours late, some a second time."""
    hours = lambda c: F.unix_timestamp(c) / 3600
    first, last = events.agg(F.min(hours("ts")), F.max(hours("ts"))).first()
    part = lambda late: F.least(F.floor((hours("ts") - first + late) / (((last or 0) - (first or 0)) / 4 + 1e-9)), F.lit(3)).cast("int")
    out = events.withColumn("chunk", part(F.when(F.col("event_id") % 50 == 7, 6).otherwise(0)))
    return out.unionByName(events.where("event_id % 40 = 3").withColumn("chunk", part(F.lit(3))))


@query(f"WITH {_SESSIONS} SELECT * FROM s WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 12 HOUR FROM events)")
def event_sessions_replayed(spark, sf_dir):
    """The events as a stream with late and repeated rows, stopped half way and begun again; sessions behind its watermark."""
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, out, checkpoint = replay.laid_down(_late(events), "chunk"), storage.scratch(spark, "sessions"), storage.scratch(spark, "checkpoint")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    replay.run(spark, path, schema, lambda e: streams.sessions(streams.distinct_events(e, late="12 hours"), late=None), out, checkpoint, restart_after=2)
    back = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")}
    return replay.result(spark, out).drop("batch").withColumns({"value": F.round("value", 4) + 0.0, **back})


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id AS document_id, (n - CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END)::INT AS seen, n::INT AS total, CASE WHEN user_id % 3 = 0 THEN 'running' ELSE 'complete' END AS state FROM n WHERE n > 1""")
def import_progress_replayed(spark, sf_dir):
    """Each user's events as the pages of a document, in two batches and with repeats; of every third one the last is missing."""
    n = F.count("*").over(relational.Window.partitionBy("user_id"))
    place = F.row_number().over(relational.Window.partitionBy("user_id").orderBy("event_id"))
    pages = _table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("ts"), place.alias("page_number"), n.cast("int").alias("total"), F.when(F.col("event_type") == "error", "x").alias("error"))
    pages = pages.where("total > 1 AND NOT (document_id % 3 = 0 AND page_number = total)").withColumn("chunk", (F.col("page_number") * 2 > F.col("total")).cast("int"))
    repeats = F.when(F.col("page_number") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    pages = pages.withColumn("repeat", F.explode(repeats)).drop("repeat")
    path, out, checkpoint = replay.laid_down(pages, "chunk"), storage.scratch(spark, "progress"), storage.scratch(spark, "checkpoint")
    replay.run(spark, path, "document_id bigint, ts timestamp, page_number int, total int, error string", lambda p: streams.import_progress(p, "1000 days", "100 days"), out, checkpoint, mode="update")
    last = F.max_by(F.struct("seen", "total", "state"), "batch").alias("r")
    return replay.result(spark, out).groupBy("document_id").agg(last).select("document_id", "r.seen", "r.total", "r.state")


# ---------------------------------------------------------------- trees

_TREE = """t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT DISTINCT 's' || c_nationkey || c_mktsegment, 'n' || c_nationkey, c_mktsegment FROM customer UNION ALL SELECT 'c' || c_custkey, 's' || c_nationkey || c_mktsegment, c_name FROM customer
UNION ALL SELECT 'p' || c_custkey || o_orderpriority, 'c' || c_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey AS c_custkey, o_orderpriority FROM orders) JOIN customer USING (c_custkey))"""


def _tree(spark, sf_dir):
    region, nation, customer, orders = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda kind, key, parent, name: [F.concat(F.lit(kind), *[F.col(k).cast("string") for k in key]).alias("id"), parent.alias("parent_id"), F.col(name).alias("name")]
    segment = F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), "c_mktsegment")
    levels = [
        region.select(*node("r", ["r_regionkey"], F.lit(None).cast("string"), "r_name")),
        nation.select(*node("n", ["n_nationkey"], F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name")),
        customer.select(*node("s", ["c_nationkey", "c_mktsegment"], F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_mktsegment")).distinct(),
        customer.select(*node("c", ["c_custkey"], segment, "c_name")),
        orders.join(customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(*node("p", ["o_custkey", "o_orderpriority"], F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "o_orderpriority")).distinct(),
    ]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT id, id AS root, 0 AS depth, name AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, w.root, w.depth + 1, w.path || ' / ' || t.name FROM t JOIN w ON t.parent_id = w.id) SELECT * FROM w""")
def category_paths(spark, sf_dir):
    """A tree of five levels: regions, nations, segments, customers, priorities of their orders."""
    tree = _tree(spark, sf_dir)
    return hierarchy.paths(tree, hierarchy.ancestors(tree))


@query(f"""WITH RECURSIVE {_TREE}, u AS (SELECT id, id AS ancestor FROM t UNION ALL SELECT u.id, t.parent_id FROM u JOIN t ON t.id = u.ancestor WHERE t.parent_id IS NOT NULL),
o AS (SELECT 'p' || o_custkey || o_orderpriority AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT ancestor AS id, coalesce(sum(n) FILTER (u.id = ancestor), 0)::BIGINT AS own, coalesce(sum(n), 0)::BIGINT AS whole FROM u LEFT JOIN o ON o.id = u.id GROUP BY 1""")
def category_subtrees(spark, sf_dir):
    own = _table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string"), "o_orderpriority").alias("category_id"))
    return hierarchy.subtree_counts(hierarchy.ancestors(_tree(spark, sf_dir)), own)


@query(f"WITH {_O} SELECT document_id, category_id, page_number, count(*) AS records, (CASE WHEN GROUPING(document_id) = 1 THEN 3 WHEN GROUPING(category_id) = 1 THEN 2 WHEN GROUPING(page_number) = 1 THEN 1 ELSE 0 END)::INT AS level FROM o GROUP BY ROLLUP (document_id, category_id, page_number)")
def record_totals(spark, sf_dir):
    return hierarchy.totals(_orders(spark, sf_dir))


# ---------------------------------------------------------------- variants

_PROPS = """v AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN '{"k": [1, ' WHEN event_id % 5 = 0 THEN '{"k": ' || json_extract_string(props, '$.k') || ', "more": {"list": [1, {"deep": "D' || event_id || '"}], "on": true}}' WHEN event_id % 11 = 0 THEN NULL ELSE props END AS props FROM events)"""


def _props(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    deep = F.concat(F.lit('{"k": '), k, F.lit(', "more": {"list": [1, {"deep": "D'), F.col("event_id").cast("string"), F.lit('"}], "on": true}}'))
    props = F.when(F.col("event_id") % 7 == 0, '{"k": [1, ').when(F.col("event_id") % 5 == 0, deep).when(F.col("event_id") % 11 == 0, None).otherwise(F.col("props"))
    return e.select("event_id", "event_type", variant.parse(props).alias("data"))


@query(f"""WITH {_PROPS}, j AS (SELECT event_id, CASE WHEN json_valid(props) THEN props END AS j FROM v)
SELECT event_id, j IS NOT NULL AS readable, json_extract_string(j, '$.k')::BIGINT AS k, json_extract_string(j, '$.more.list[1].deep') AS deep, json_extract_string(j, '$.more.on') AS is_on FROM j""")
def variant_paths(spark, sf_dir):
    """Nested, plain and broken JSON of every event, read by path."""
    d = F.col("data")
    return _props(spark, sf_dir).select("event_id", d.isNotNull().alias("readable"), variant.at(d, "$.k", "bigint").alias("k"), variant.at(d, "$.more.list[1].deep").alias("deep"), variant.at(d, "$.more.on").alias("is_on"))


@query(f"""WITH {_PROPS} SELECT event_type, count(*) FILTER (json_valid(props)) AS records, 'OBJECT<k: BIGINT, more: OBJECT<list: ARRAY<VARIANT>, on: BOOLEAN>>' AS schema FROM v GROUP BY 1""")
def variant_schemas(spark, sf_dir):
    return variant.fields(_props(spark, sf_dir), by=("event_type",))


@query(f"""WITH {_PROPS}, j AS (SELECT event_id, CASE WHEN json_valid(props) THEN props END AS j FROM v) SELECT event_id, 'k' AS key, json_extract_string(j, '$.k') AS value FROM j WHERE j IS NOT NULL UNION ALL SELECT event_id, 'more', json_extract_string(j, '$.more.list[1].deep') FROM j WHERE json_exists(j, '$.more')""")
def variant_entries(spark, sf_dir):
    """A row for each field of each event's data; of nested ones something deep inside."""
    each = variant.entries(_props(spark, sf_dir).drop("event_type")).where("key IS NOT NULL")
    deep = variant.at(F.col("value"), "$.list[1].deep")
    return each.select("event_id", "key", F.when(F.col("key") == "more", deep).otherwise(variant.at(F.col("value"), "$")).alias("value"))


@query(f"WITH {_PROPS} SELECT event_id FROM v WHERE json_valid(props) AND json_extract_string(props, '$.more.on') = 'true' AND json_extract_string(props, '$.k') = '87'")
def variant_filter(spark, sf_dir):
    return variant.equal(variant.equal(_props(spark, sf_dir), "$.more.on", "TRUE"), "$.k", 87).select("event_id")


# ---------------------------------------------------------------- workspaces


def _workspace(spark, sf_dir):
    w = Workspace(spark, storage.scratch(spark, "workspace"), buckets=16)
    w.replace("records", _orders(spark, sf_dir))
    w.replace("categories", _groups(spark, sf_dir).withColumn("document_id", F.lit(None).cast("long")))
    return w


@query(f"WITH {_O} SELECT id, document_id, CASE WHEN document_id IN (7, 23) THEN 4 ELSE category_id END::BIGINT AS category_id FROM o WHERE document_id NOT IN (8, 9)")
def scoped_changes(spark, sf_dir):
    """Records in buckets of documents: two documents' records are moved, two documents go; the other buckets stay as written."""
    w = _workspace(spark, sf_dir)
    w.edit([7, 23], records=lambda old: old.withColumn("category_id", F.when(F.col("document_id").isin(7, 23), F.lit(4).cast("long")).otherwise(F.col("category_id"))))
    w.delete_documents([8, 9])
    return w.table("records").select("id", "document_id", "category_id")


@query(f"WITH {_O}, c AS (SELECT id, page_number, coalesce(r_name, '') AS category_name, name, village, total FROM o LEFT JOIN region ON category_id = r_regionkey) SELECT id, page_number, category_name, t.place::INT AS place, t.key, t.value FROM c, LATERAL (SELECT 0 AS place, 'name' AS key, name AS value UNION ALL SELECT 1, 'house_no', '' UNION ALL SELECT 2, CASE WHEN village IS NULL THEN 'total' ELSE 'village' END, coalesce(village, total)) t")
def grid_cells(spark, sf_dir):
    return relational.grid_cells(_orders(spark, sf_dir), _groups(spark, sf_dir), ["name", "house_no"])


# ---------------------------------------------------------------- the rest


@query(f"WITH {_T} SELECT id, page_number FROM t WHERE contains(lower(source_text), 'thea') ORDER BY page_number, id LIMIT 500")
def records_matching(spark, sf_dir):
    """Records among a search's hits."""
    none = _pages(spark, sf_dir).where("false")
    return search.records_matching(_talks(spark, sf_dir), none, _groups(spark, sf_dir), "thea").select("id", "page_number")


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey))::BIGINT AS place FROM orders")
def stored_documents(spark, sf_dir):
    """Documents as stored: the last changed first."""
    own = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    n = F.row_number().over(relational.Window.orderBy(F.desc("updated_at"), "id")).cast("long")
    return relational.stored_order(own, "documents").withColumn("place", n).select("id", "place")


@query("SELECT c_custkey::BIGINT AS document_id, 'ABC' || lpad((c_custkey + s)::VARCHAR, 7, '0') AS voter_id, x AS x, 100.0::DOUBLE AS y, 150.0::DOUBLE AS w, 100.0::DOUBLE AS h FROM customer, (VALUES (0, 20.0::DOUBLE), (500000, 420.0::DOUBLE)) t(s, x)")
def card_boxes(spark, sf_dir):
    """The box of each card on pages with two cards side by side."""
    k = F.col("c_custkey")
    text = lambda c: F.concat(F.lit("निर्वाचक का नाम : Person "), c.cast("string"), F.lit("x\nमकान संख्या : "), c.cast("string"), F.lit("\nABC"), F.lpad(c.cast("string"), 7, "0"))
    place = lambda c, x: F.struct(text(c).alias("text"), F.lit(float(x)).alias("x0"), F.lit(100.0).alias("y0"), F.lit(float(x + 150)).alias("x1"), F.lit(200.0).alias("y1"))
    blocks = _table(spark, sf_dir, "customer").select(k.cast("long").alias("document_id"), F.lit(1).alias("page_number"), F.explode(F.array(place(k, 20), place(k + 500_000, 420))).alias("b")).select("document_id", "page_number", "b.*")
    found = cards.spatial(blocks)
    return found.select("document_id", F.col("data")["voter_id"].alias("voter_id"), "bbox.x", "bbox.y", "bbox.w", "bbox.h")


@query(f"WITH {_P}, f AS (SELECT DISTINCT document_id, kind FROM p) SELECT id, p.document_id, (SELECT max(('0x' || substr(md5(f.document_id || f.kind), 1, 8))::BIGINT) FILTER (true) FROM f WHERE f.document_id = p.document_id AND contains(lower(p.name || chr(10) || p.voter_id || chr(10) || p.house_no || chr(10) || p.kind), lower(f.kind))) AS category_id FROM p")
def category_assign_names(spark, sf_dir):
    """The types of a document's parts as its categories, found in the parts by one automaton for each document."""
    parts = _parts(spark, sf_dir).drop("category_id")
    key = F.conv(F.substring(F.md5(F.concat(F.col("document_id").cast("string"), F.col("data")["kind"])), 1, 8), 16, 10).cast("long")
    found = parts.select("document_id", F.col("data")["kind"].alias("name"), key.alias("id"), key.alias("ord"), F.array().cast("array<int>").alias("pages")).distinct()
    return relational.assign_categories(parts, found).select("id", "document_id", "category_id")
