"""Registered queries of the stored index and of batches of queries, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import batch, fulltext, postings
from .catalogue import _NORM, _P, _T, _groups, _pages, _parts, _table, _talks, query


def _index(spark: SparkSession, entries: DataFrame) -> postings.Index:
    out = postings.Index(spark, storage.scratch(spark, "index"))
    out.write(entries)
    return out


def _everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.build(_talks(spark, sf_dir), _pages(spark, sf_dir), _groups(spark, sf_dir))


_X = f"""{_T}, x AS (SELECT document_id, page_number, id AS record_id, trim(source_text || ' ' || role) AS text FROM t UNION ALL SELECT doc_id, 1, NULL, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.document_id = doc_id AND t.page_number = 1))"""
_TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"
#: Entries with tokens; the two prefixes that the queries ask for, with numbers and ranks.
_MATCH = f"""w AS (SELECT *, {_TOKENS} AS words FROM x),
c AS (SELECT *, len(words) AS n, len(list_filter(words, lambda x: starts_with(x, 'tion'))) AS a, len(list_filter(words, lambda x: starts_with(x, 'the'))) AS b FROM w),
s AS (SELECT avg(n) AS mean, greatest(ln((count(*) - count(*) FILTER (a > 0) + 0.5) / (count(*) FILTER (a > 0) + 0.5)), 1e-6) AS ia, greatest(ln((count(*) - count(*) FILTER (b > 0) + 0.5) / (count(*) FILTER (b > 0) + 0.5)), 1e-6) AS ib FROM c),
m AS (SELECT c.*, round(-ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) - ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) + 0.0 AS bm25 FROM c, s WHERE a > 0 AND b > 0)"""


@query(f"WITH {_X}, w AS (SELECT document_id, page_number, record_id, {_TOKENS} AS words FROM x) SELECT document_id, page_number, record_id, len(words)::BIGINT AS tokens, len(words)::BIGINT AS occurrences, CASE WHEN len(words) > 0 THEN len(words) - 1 END::INT AS last_place FROM w")
def postings_build(spark, sf_dir):
    """Every entry's length, as stored, beside what its postings sum up to."""
    index = _index(spark, _everything(spark, sf_dir))
    sums = index.postings([""]).groupBy("gen", "entry").agg(F.sum("tf").alias("occurrences"), F.max(F.array_max("positions")).alias("last_place"))
    rows = index.entries().join(sums, ["gen", "entry"], "left")
    return rows.select("document_id", "page_number", "record_id", F.col("n_tokens").cast("long").alias("tokens"), F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"), "last_place")


@query(f"WITH {_X}, {_MATCH} SELECT document_id, page_number, record_id, bm25 FROM m")
def postings_match(spark, sf_dir):
    found = _index(spark, _everything(spark, sf_dir)).match("tioned the")
    return found.select("document_id", "page_number", "record_id", (F.round("bm25", 6) + 0.0).alias("bm25"))


@query(f"""WITH {_T}, x AS (SELECT document_id, page_number, id AS record_id, trim(source_text || ' ' || role) AS text FROM t WHERE document_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 1, NULL, text FROM documents WHERE doc_id % 3 <> 0 OR doc_id NOT IN (SELECT document_id FROM t)), {_MATCH} SELECT document_id, page_number, record_id, bm25 FROM m""")
def postings_replace(spark, sf_dir):
    """The documents' texts take the place of conversations of the same number, then every third of these goes: each a generation."""
    talks, none, groups = _talks(spark, sf_dir), _pages(spark, sf_dir).where("false"), _groups(spark, sf_dir)
    index = _index(spark, fulltext.build(talks, none, groups))
    index.write(fulltext.build(talks.where("false"), _pages(spark, sf_dir), groups))
    gone = talks.join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").where("document_id % 3 = 0").select("document_id")
    index.write(index.entries().limit(0), gone)
    return index.match("tioned the").select("document_id", "page_number", "record_id", (F.round("bm25", 6) + 0.0).alias("bm25"))


@query(rf"""WITH {_X}, {_MATCH}, e AS (SELECT row_number() OVER () AS e, * FROM m),
h AS (SELECT e, n, i - 1 AS place, CASE WHEN starts_with(word, 'tion') THEN 0 ELSE 1 END AS number FROM (SELECT e, n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM e) WHERE starts_with(word, 'tion') OR starts_with(word, 'the')),
r AS (SELECT e, regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}]+[^\p{{L}}\p{{N}}\p{{M}}]*') AS raw FROM e),
b AS (SELECT e, i - 1 AS begun FROM (SELECT e, raw, unnest(range(1, len(raw) + 1)) AS i FROM r) WHERE i = 1 OR regexp_matches(raw[i - 1], '[.:][ \t\n\r]+$')),
g AS (SELECT h.e, h.n, h.place, max(begun) AS begun FROM h JOIN b ON b.e = h.e AND b.begun <= h.place GROUP BY ALL),
c0 AS (SELECT e, n, place, place AS start, 0 AS kind, 0 AS bonus FROM h UNION ALL SELECT e, n, place, begun, 1, CASE WHEN begun = 0 THEN 120 ELSE 100 END FROM g WHERE n > 64 AND begun < place),
v AS (SELECT c0.e, c0.n, c0.place, c0.start, c0.kind, c0.bonus, count(*) AS met, count(DISTINCT h.number) AS kinds, max(h.place) + 1 AS last FROM c0 JOIN h ON h.e = c0.e AND h.place >= c0.start AND h.place < c0.start + 64 GROUP BY ALL),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY e ORDER BY kinds * 1000 + met - kinds + bonus DESC, place, kind) = 1),
a AS (SELECT e, CASE WHEN kind = 1 THEN start ELSE greatest(0, least(start - (64 - (last - start)) // 2, n - 64)) END AS at_token, n FROM best)
SELECT document_id, page_number, record_id, (SELECT count(*) FROM h WHERE h.e = a.e AND place >= at_token AND place < at_token + 64) AS hits, at_token > 0 AS cut_before, at_token + 64 < a.n AS cut_after
FROM a JOIN e USING (e)""")
def postings_snippet(spark, sf_dir):
    """Hits in the window that is shown of each entry, and whether text is left out before or after it."""
    index = _index(spark, _everything(spark, sf_dir))
    shown = index.shown(index.match("tioned the"))
    hits = F.regexp_count("snippet", F.lit("<b>")).cast("long")
    return shown.select("document_id", "page_number", "record_id", hits.alias("hits"), F.startswith("snippet", F.lit("...")).alias("cut_before"), F.endswith("snippet", F.lit("...")).alias("cut_after"))


# ---------------------------------------------------------------- batches

#: Every name, each word of one, every brand, type and size: a table of queries, keyed by a hash of theirs.
_QUERIES = "q AS (SELECT ('0x' || substr(md5(query), 1, 8))::BIGINT AS query_id, query, lower(query) AS low FROM (SELECT p_name AS query FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT p_size::VARCHAR FROM part))"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    texts = p.select(F.explode(F.array_union(F.split("p_name", " "), F.array("p_name", "p_brand", "p_type", size))).alias("query")).distinct()
    return texts.select(F.conv(F.substring(F.md5("query"), 1, 8), 16, 10).cast("long").alias("query_id"), "query")


@query(f"""WITH {_P}, {_QUERIES}, r AS (
  SELECT query_id, id AS record_id, document_id, page_number, greatest(
    CASE WHEN lower(name) = low THEN 1000 WHEN list_contains(string_split(lower(name), ' '), low) THEN 900 WHEN starts_with(lower(name), low) THEN 850 WHEN contains(lower(name), low) THEN 700 ELSE 0 END,
    CASE WHEN lower(voter_id) = low THEN 950 WHEN contains(lower(voter_id), low) THEN 750 ELSE 0 END, CASE WHEN house_no = low THEN 600 WHEN contains(house_no, low) THEN 400 ELSE 0 END,
    CASE WHEN lower(kind) = low THEN 650 WHEN contains(lower(kind), low) THEN 500 ELSE 0 END)::DOUBLE AS rank
  FROM p JOIN q ON contains(lower(name), low) OR contains(lower(voter_id), low) OR contains(house_no, low) OR contains(lower(kind), low)
), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), d AS (SELECT doc_id, lower({_NORM.format("text")}) AS t FROM documents),
u AS (SELECT * FROM r UNION ALL SELECT q.query_id, NULL, doc_id, 1, 100.0 FROM q JOIN d ON contains(t, low) OR contains(t, translate(low, '0123456789', '०१२३४५६७८९')) LEFT JOIN n ON n.query_id = q.query_id
  WHERE coalesce(n, 0) < 500 AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = q.query_id AND r.document_id = doc_id AND r.page_number = 1))
SELECT query_id, record_id, document_id, page_number, rank, row_number() OVER (PARTITION BY query_id ORDER BY page_number, rank DESC, coalesce(record_id, 0), document_id)::INT AS result_no FROM u QUALIFY result_no <= 500""")
def batch_search(spark, sf_dir):
    found = batch.search_all(_parts(spark, sf_dir), _pages(spark, sf_dir), _groups(spark, sf_dir), _asked(spark, sf_dir))
    return found.select("query_id", "record_id", "document_id", "page_number", "rank", "result_no")


@query(f"""WITH {_P}, q AS (SELECT DISTINCT ('0x' || substr(md5(p_name || p_type), 1, 8))::BIGINT AS query_id, lower(string_split(p_name, ' ')[1]) AS x, lower(p_type) AS y FROM part),
d AS (SELECT id, page_number, regexp_extract_all(lower(trim(name || ' ' || kind || ' ' || name || ' ' || voter_id || ' ' || house_no || ' ' || kind)), '[a-z0-9]+') AS w FROM p),
c AS (SELECT query_id, id, page_number, len(w) AS n, len(list_filter(w, lambda v: starts_with(v, substr(x, 1, 3)))) AS a, len(list_filter(w, lambda v: starts_with(v, substr(y, 1, 3)))) AS b, substr(x, 1, 3) = substr(y, 1, 3) AS one FROM q, d),
s AS (SELECT query_id, avg(n) AS mean, greatest(ln((count(*) - count(*) FILTER (a > 0) + 0.5) / (count(*) FILTER (a > 0) + 0.5)), 1e-6) AS ia, greatest(ln((count(*) - count(*) FILTER (b > 0) + 0.5) / (count(*) FILTER (b > 0) + 0.5)), 1e-6) AS ib FROM c GROUP BY 1)
SELECT query_id, id AS record_id, page_number, round(-ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) - CASE WHEN one THEN 0 ELSE ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) END, 6) + 0.0 AS bm25 FROM c JOIN s USING (query_id) WHERE a > 0 AND b > 0""")
def batch_fulltext(spark, sf_dir):
    """The beginnings of each name's first word and of its type, as queries to the parts' index."""
    p = _table(spark, sf_dir, "part")
    asked = F.concat_ws(" ", F.substring("p_name", 1, 3), F.substring("p_type", 1, 3))
    queries = p.select(F.conv(F.substring(F.md5(F.concat("p_name", "p_type")), 1, 8), 16, 10).cast("long").alias("query_id"), asked.alias("query")).distinct()
    index = _index(spark, fulltext.build(_parts(spark, sf_dir), _pages(spark, sf_dir).limit(0), _groups(spark, sf_dir)))
    return batch.match_all(index, queries).select("query_id", "record_id", "page_number", (F.round("bm25", 6) + 0.0).alias("bm25"))


@query("""WITH c AS (SELECT c_custkey AS query_id, c_name AS query FROM customer), v AS (SELECT query_id, [query, translate(query, '0123456789', '०१२३४५६७८९')] AS terms FROM c)
SELECT query_id, unnest(terms) AS term, unnest(range(len(terms)))::INT AS place FROM v""")
def query_variants(spark, sf_dir):
    """Every customer's name as a query: itself, and with its digits respelt."""
    queries = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"))
    return batch.prepared(queries).select("query_id", F.posexplode("terms").alias("place", "term"))
