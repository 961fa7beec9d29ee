"""Documents through five stages: toxicity, near duplicates, personal data, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm import bpe, jaccard, mixing, pii, shared, toxicity


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut, with the columns of docs.

    Null and empty texts are not toxic; very long ones are read whole; repeated rows stay or go together; an empty
    table stays empty; columns of docs can have any names, score among them.
    """
    labels = shared.table(spark, sf_dir, "labels")
    score = _fresh(docs, "score")
    scored = toxicity.train_and_score(docs, labels, train=F.crc32(F.col("doc_id").cast("string")) % 3 != 1, also=tuple(docs.columns), score=score)
    return scored.where(F.col(score) < toxicity.CUT).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts, that with the smallest (id, hash of the text); columns of docs.

    Of rows that repeat both, one stays; a row goes by its own text, whatever other rows share its id. Rows with null
    ids are told apart by their texts. Texts without words (null, empty, blank) have no duplicates and all stay.
    """
    row, text, n = (_fresh(docs, c) for c in ("row", "text_key", "copies"))
    own = [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias(row), F.md5("text").alias(text)]
    found = shared.cut(jaccard.join(docs.select(*own, "text"), row_id=row, links_too=False, also=(text,)).where("n_shingles > 0"), "classes")
    keys = F.struct(row, text)
    size = _fresh(docs, "members")
    distinct = shared.cut(found.groupBy("component", row, text).agg(F.count("*").alias(n)), "distinct")
    least = shared.cut(distinct.groupBy("component").agg(F.min(keys).alias("least"), F.count("*").alias(size)), "least")
    marks = shared.look_up(distinct, least, "component", size, distinct.count()).where((F.col("least") != keys) | (F.col(n) > 1))
    marks = shared.cut(marks.select(row, text, F.when(F.col("least") == keys, F.col(n)).otherwise(0).alias(n)), "marks")
    shared.forget(found, least, distinct)
    # Only texts that may be marked are moved to meet their marks.
    h = _fresh(docs, "row_hash")
    known = F.xxhash64(row, text)
    all_rows, may = shared.filtered(docs.select(*_columns(docs), *own).withColumn(h, known), h, marks.select(known.alias("h")), marks.count())
    marked = all_rows.where(may).select(*_columns(docs), row, text).join(marks, [row, text], "left")
    out = all_rows.where(~may).select(*_columns(docs)).unionByName(marked.where(F.col(n).isNull()).select(*_columns(docs)))
    if marks.where(F.col(n) > 1).limit(1).count():
        out = out.unionByName(marked.where(F.col(n) > 1).dropDuplicates([row, text]).select(*_columns(docs)))
    return out


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in text replaced and n_chars (where there is one) that of the new text.

    Null and empty texts stay as they are; very long ones are worked through whole; repeated rows repeat; an empty
    table stays empty; other columns, whatever their names, are kept.
    """
    out = pii.replace(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes its words, rounded: at most one document of a source is taken in part.

    Texts without words are no part of a mixture of words. Null sources are one source; rows that repeat id, text
    and source share their copies; an empty table stays empty; columns of docs can have any names.
    """
    key, copies, place, turn = (_fresh(docs, c) for c in ("mix_key", "mix_copies", "mix_place", "mix_turn"))
    rows, _ = mixing.mix(docs.select("doc_id", "source", "text"))
    rows = rows.where("size > 0").select(F.md5(F.concat_ws(":", "key", F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"))).alias(key), F.round(F.col("taken") / F.col("size")).cast("int").alias(copies))
    # Rows of one key are alike: each gets its part of what they have together.
    rows = rows.groupBy(key).agg(F.sum(copies).alias(copies), F.count("*").alias(place))
    rows = shared.cut(rows.where(F.col(copies) > 0), "copies")
    own = F.md5(F.concat_ws(":", shared.seeded_key("mix", F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string")))
    taken = docs.select(*_columns(docs), own.alias(key)).join(rows, key)
    once = taken.where(F.col(place) == 1).select(*_columns(docs), copies)
    if rows.where(F.col(place) > 1).limit(1).count():
        many = taken.where(F.col(place) > 1).withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(*_columns(docs))))
        part = F.floor(F.col(copies) / F.col(place)) + (F.col(turn) <= F.pmod(copies, place)).cast("int")
        once = once.unionByName(many.select(*_columns(docs), part.cast("long").alias(copies)).where(F.col(copies) > 0))
    return once.select(*_columns(docs), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long"))).alias(turn)).select(*_columns(docs))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document.

    Null and empty texts have no ids; very long ones are encoded whole; repeated rows repeat; an empty table gives
    none; other columns are left out.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("mixture", mix_sources),
    ("tokens", to_tokens),
]
#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir; each one's rows are written to the shared folder and read by the next."""
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.cut(docs, name.replace(" ", "-"))
            shared.forget(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
