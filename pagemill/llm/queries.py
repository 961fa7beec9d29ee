"""The corpus operators over the driver's tables: one query for each, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, contamination, htmltext, jaccard, merkle, mixing, pii, quality, shared, sharding, topk, toxicity


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(shared.table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OP1 = """
WITH RECURSIVE step(n, c, k) AS (
  SELECT n::UBIGINT, n::UBIGINT, 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8),
d AS (
  SELECT doc_id, source, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295::UBIGINT, list_reduce(
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::UBIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8), 4294967295::UBIGINT)) END::BIGINT AS text_crc32
  FROM documents, crc
), r AS (
  SELECT *, md5('shard:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32) AS h FROM d
), p AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size) - 1 + ('0x' || substr(md5('shard:' || coalesce('source:' || source, 'null')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0) / count(*) OVER (PARTITION BY source) AS f FROM r
), q AS (
  SELECT *, row_number() OVER (ORDER BY f, source IS NULL, source, h, doc_id, size) - 1 AS pos, count(*) OVER () AS n FROM p
), s AS (SELECT *, (pos * 40 // n)::INT AS shard FROM q)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (pos - ((shard * n + 39) // 40))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(shared.table(spark, sf_dir, "documents"))
    # The first of the shards whose quotas the document's words fill.
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.get("shards", F.lit(0))["shard"].alias("first_shard"))


_OP4 = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((place - 1) % 3 + 1)::BIGINT] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS all_size FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source)
), o AS (
  SELECT *, (all_size - coalesce(sum(cap) OVER w, 0))::DOUBLE / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level, row_number() OVER (ORDER BY cap / weight, place) AS turn
  FROM s WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT arg_min(level, turn) AS level FROM o WHERE level * weight <= cap),
g AS (SELECT o.source, source_size, place, least(l.level * weight, cap)::DOUBLE AS target FROM o, l),
b AS (SELECT floor(sum(source_size) / 8 + 0.5)::BIGINT AS blocks FROM g),
a AS (
  SELECT place, k, row_number() OVER (ORDER BY (2 * k + 1) / (2 * target), place) AS turn
  FROM (SELECT place, target, unnest(range((target / 4)::BIGINT + 100)) AS k FROM g WHERE target > 0)
), got AS (SELECT place, count(*) * 8 AS got FROM a, b WHERE turn <= blocks GROUP BY place),
m AS (SELECT g.source, place, source_size, target, least(coalesce(got, 0), 3 * source_size) AS got FROM g LEFT JOIN got USING (place)),
x AS (
  SELECT d.doc_id, d.size, m.place, m.source_size, m.target, CASE WHEN m.source_size > 0 THEN got // m.source_size ELSE 0 END AS turns, got,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
, y AS (SELECT *, (turns * size + greatest(least(before + size, got - turns * source_size) - before, 0))::BIGINT AS taken FROM x)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN len(list_filter(range(1, 17), lambda c: (b.blocks * c) // 16 < a.turn))::INT END AS first_shard
FROM y CROSS JOIN b LEFT JOIN a ON a.place = y.place AND a.k = before // 8
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(shared.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


QUERIES = {"op1_sharding": op1_sharding, "op4_mixing": op4_mixing, "op7_bpe": op7_bpe}
ORACLES = {"op1_sharding": _OP1, "op4_mixing": _OP4}


def _remainder(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    out = quality.train_and_score(docs, labels, train=_remainder(5) != 0)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    out = toxicity.train_and_score(docs, labels, train=_remainder(3) != 1)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(shared.table(spark, sf_dir, "pages"))


QUERIES |= {"op6_quality": op6_quality, "op8_toxicity": op8_toxicity, "op10_html": op10_html}


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(shared.table(spark, sf_dir, "documents"))


QUERIES["op3_jaccard"] = op3_jaccard


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(shared.table(spark, sf_dir, "embeddings"), every=50, k=5)


_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(shared.table(spark, sf_dir, "embeddings"), every=20, k=20)


QUERIES |= {"op2_topk": op2_topk, "op9_ann": op9_ann}
ORACLES["op2_topk"] = _OP2


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, counts=True)


QUERIES["op5_pii"] = op5_pii


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = merkle.leaf(*fields, F.translate("text", _UPPER, _LOWER))
    # A null id is no number: its row is not tampered with.
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, altered)
    found = merkle.manifest(docs, also={"tampered": tampered})
    root = F.lit(found.root)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = found.rows.select("doc_id", "leaf", "subroot", root.alias("root"), merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.coalesce(F.col("folded_root") == root, F.lit(False)))


def _op11_sql(levels: int = 6) -> str:
    """Six levels hold 16 ** 6 rows of a source, and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        _CRC_TABLE,
        f"""d AS (
  SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS s, {leaf("text")} AS leaf,
    CASE WHEN xor(4294967295::UBIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::UBIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8), 4294967295::UBIGINT)) % 5 = 0 THEN {leaf(lower)} END AS tampered
  FROM documents, crc
), n0 AS (SELECT *, row_number() OVER (PARTITION BY named, s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY named, s) AS n, leaf AS h FROM d)""",
    ]

    def tree(nodes: str, runs: str, key: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"{runs}{k} AS (SELECT {key}, i // 16 AS j, max(n) AS n, list(h ORDER BY i) AS hs FROM {nodes}{k} WHERE n > 1 GROUP BY {key}, i // 16)")
            out.append(f"{nodes}{k + 1} AS (SELECT {key}, j AS i, (n + 15) // 16 AS n, sha256(array_to_string(hs, '')) AS h FROM {runs}{k})")
        return ",\n".join(out)

    tops = lambda nodes, key: " UNION ALL ".join(f"SELECT {key}, h FROM {nodes}{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(tree("n", "r", "named, s"))
    parts.append(f"tops AS ({tops('n', 'named, s')})")
    parts.append("g0 AS (SELECT 1 AS one, named, s, h, row_number() OVER (ORDER BY named, s) - 1 AS i, count(*) OVER () AS n FROM tops)")
    parts.append(tree("g", "q", "one"))
    parts.append(f"root AS ({tops('g', 'one')})")
    joins, runs = [], []
    for k in range(levels):
        joins.append(f"LEFT JOIN r{k} ON r{k}.named = n0.named AND r{k}.s = n0.s AND r{k}.j = n0.i // {16 ** (k + 1)}")
        runs.append((f"r{k}.hs", f"(n0.i // {16**k}) % 16"))
    for k in range(levels):
        joins.append(f"LEFT JOIN q{k} ON q{k}.j = g0.i // {16 ** (k + 1)}")
        runs.append((f"q{k}.hs", f"(g0.i // {16**k}) % 16"))
    sides = ", ".join(f"CASE WHEN {hs} IS NOT NULL THEN [array_to_string({hs}[1:{p}], ''), array_to_string({hs}[{p} + 2:], '')] END" for hs, p in runs)
    parts.append(f"p AS (SELECT n0.doc_id, n0.leaf, n0.tampered, g0.h AS subroot, root.h AS root, list_filter([{sides}], lambda x: x IS NOT NULL) AS proof FROM n0 JOIN g0 USING (named, s) CROSS JOIN root {' '.join(joins)})")
    folded = "list_reduce(list_prepend([coalesce(tampered, leaf), ''], proof), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1]"
    return "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda x: x[1] || x[2]), '')) AS proof_sha256, {folded} AS folded_root, folded_root = root AS verified FROM p"""


_CRC_TABLE = """step(n, c, k) AS (
  SELECT n::UBIGINT, n::UBIGINT, 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8)"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(shared.table(spark, sf_dir, "documents"), top=2000, least=30, keep=80)


_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
w AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, phrase, size, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2, 3, 4]) AS size FROM w) WHERE i + size - 1 <= len(w))
  GROUP BY ALL HAVING f >= 30
), c AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), h AS (
  SELECT lang, array_to_string(w[place : place + m - 1], ' ') AS phrase, max(f) AS most FROM (
    SELECT *, unnest(range(1, size - m + 2)) AS place FROM (SELECT lang, f, size, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS m FROM f WHERE size > 2))
  GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM s JOIN t USING (lang) LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
QUALIFY rank <= 2000
"""


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS x FROM (
    SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), 10) AS size FROM b WHERE len(w) > 0))
), g AS (
  SELECT doc, i, size, array_to_string(w[i : i + size - 1], ' ') AS x FROM (
    SELECT doc, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM v) WHERE len(w) >= size)
), o AS (SELECT DISTINCT doc, i, size, item FROM g JOIN v USING (size, x)),
h AS (SELECT doc, count(DISTINCT place) AS n_hit FROM (SELECT doc, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc, i, size FROM o)) GROUP BY doc),
m AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc, item FROM o) GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc) LEFT JOIN m USING (doc)
"""

QUERIES |= {"op11_merkle": op11_merkle, "op12_collocations": op12_collocations, "op13_contamination": op13_contamination}
ORACLES |= {"op11_merkle": _op11_sql(), "op12_collocations": _OP12, "op13_contamination": _OP13}
