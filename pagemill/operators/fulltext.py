"""A derived full-text index: tokens folded, lower-cased and stemmed; prefix terms joined by AND."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import storage
from ..functions import snippets
from ..functions.variants import index_terms
from . import relational

_VOWEL = "aeiou"


def _measure(w: str) -> int:
    """Vowel-consonant sequences of a stem."""
    shape = "".join("v" if ch in _VOWEL or ch == "y" and i and w[i - 1] not in _VOWEL else "c" for i, ch in enumerate(w))
    return len(re.findall("v+c", shape))


def _has_vowel(w: str) -> bool:
    return any(ch in _VOWEL or ch == "y" and i and w[i - 1] not in _VOWEL for i, ch in enumerate(w))


def _short(w: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", w))


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(w: str) -> str:
    """Porter's stemmer, for ASCII words of more than two letters."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        for end, new in sorted(steps, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]):
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: Stems of the tokens that a worker has met, so that each different one is seldom stemmed twice; emptied when full.
_stems: dict[str, str] = {}
MOST_STEMS = 100_000
_PLAIN_TOKEN, _TOKEN = re.compile("[a-z0-9]+"), re.compile(r"[^\W_]+")


def _stem(token: str) -> str:
    found = _stems.get(token)
    if found is None:
        if len(_stems) >= MOST_STEMS:
            _stems.clear()
        found = _stems[token] = stem(token)
    return found


def _words(text: str | None) -> list[str]:
    """Tokens before stemming: runs of letters and digits, without diacritics."""
    low = (text or "").lower()
    if low.isascii():
        return _PLAIN_TOKEN.findall(low)
    bare = "".join(" " if unicodedata.category(c)[0] == "M" and "ऀ" <= c <= "෿" else c for c in unicodedata.normalize("NFD", low))
    bare = "".join(c for c in bare if unicodedata.category(c) != "Mn")
    return _TOKEN.findall(bare)


def fold(text: str) -> list[str]:
    """Stemmed tokens: runs of letters and digits, without diacritics."""
    return [_stem(t) for t in _words(text)]


def spans(text: str) -> list[tuple[int, int]]:
    """Where the tokens of fold(text) stand in the text."""
    if text.isascii():
        return [m.span() for m in re.finditer("[A-Za-z0-9]+", text)]
    out, begin, end = [], None, 0
    for i, ch in enumerate(text):
        if unicodedata.category(ch) == "Mn" and not "ऀ" <= ch <= "෿":
            end = i + 1 if begin is not None else end
            continue
        # What a character folds to, piece by piece: each can end a token.
        for c in unicodedata.normalize("NFD", ch.lower()):
            if unicodedata.category(c)[0] == "M" and "ऀ" <= c <= "෿" or not _TOKEN.match(c) and unicodedata.category(c) != "Mn":
                if begin is not None:
                    out.append((begin, end))
                    begin = None
            elif unicodedata.category(c) != "Mn":
                begin = i if begin is None else begin
                end = i + 1
    if begin is not None:
        out.append((begin, end))
    return out


@F.pandas_udf(ArrayType(StringType()))
def _tokens(s: pd.Series) -> pd.Series:
    return s.map(fold)


def build(records: DataFrame, pages: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each record (source and values) and each page without records."""
    named = relational.with_category(records, categories)
    values = F.array_join(F.filter(F.map_values("data"), lambda v: v != ""), " ")
    own = named.select(F.trim(F.concat_ws(" ", "source_text", values)).alias("text"), "page_number", "document_id", F.col("id").cast("long").alias("record_id"), "category_name")
    rest = pages.join(records.select("document_id", "page_number").distinct(), ["document_id", "page_number"], "left_anti")
    text = F.coalesce(F.nullif(F.col("processed_text"), F.lit("")), F.col("raw_text"))
    return own.unionByName(rest.select(text.alias("text"), "page_number", "document_id", F.lit(None).cast("long").alias("record_id"), F.lit("").alias("category_name")))


def tokens(index: DataFrame) -> DataFrame:
    """The index with its stemmed tokens; write it once, search it often."""
    storage.small_batches(index.sparkSession)
    return index.withColumn("tokens", _tokens("text"))


#: Parameters of the rank (fixed values: those of the usual implementation).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _counted(index: DataFrame, terms: list[str]) -> DataFrame:
    """index with n (tokens of a text) and times (how many of them begin with each term); texts without one of the terms are left out."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            sizes, times, at = [], [], batch.schema.get_field_index("text")
            for text in batch.column(at):
                words = Counter(_words(text.as_py()))
                own = [0] * len(terms)
                for w, k in words.items():
                    met = begun.get(w)
                    if met is None:
                        if len(begun) >= MOST_STEMS:
                            begun.clear()
                        t = stem(w)
                        met = begun[w] = tuple(i for i, term in enumerate(terms) if t.startswith(term))
                    for i in met:
                        own[i] += k
                sizes.append(words.total())
                times.append(own)
            kept = pa.compute.if_else(pa.array([all(own) for own in times], pa.bool_()), batch.column(at), pa.scalar(None, batch.schema.field(at).type))
            columns = [kept if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(times, pa.list_(pa.int32()))], names=[*batch.schema.names, "n", "times"])

    spark, path = index.sparkSession, storage.scratch(index.sparkSession, "counted")
    storage.small_batches(spark)
    schema = index.select("*", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<int>").alias("times")).schema
    index.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def match(index: DataFrame, query: str, category: str | None = None, document_id: int | None = None, label: str = "FTS") -> DataFrame:
    """All hits, with bm25 (lower is better): the order in which first() cuts the hits of a page.

    A term counts as often as tokens begin with it; the statistics are those of the whole index.
    """
    terms = list(dict.fromkeys(t for word in index_terms(query.rstrip("*")) for t in fold(word)))
    if not terms:
        return (index if "tokens" in index.columns else tokens(index)).limit(0)
    if "tokens" in index.columns:
        size, times = F.size("tokens"), [F.size(F.filter("tokens", lambda x: x.startswith(t))) for t in terms]  # noqa: B023
    else:
        # Each text is read once: what it has of the terms is written, and the texts of hits.
        index = _counted(index, terms)
        size, times = F.col("n"), [F.col("times")[i] for i in range(len(terms))]
    stats = index.select(size.alias("n"), *[c.alias(f"t{i}") for i, c in enumerate(times)])
    stats = stats.agg(F.count("*"), F.avg("n"), *[F.count_if(F.col(f"t{i}") > 0) for i in range(len(terms))]).first()
    total, mean, held = stats[0], stats[1] or 1.0, stats[2:]
    rank = F.lit(0.0)
    for c, n in zip(times, held, strict=True):
        idf = max(math.log((total - n + 0.5) / (n + 0.5)), LEAST_IDF)
        rank = rank - idf * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean))
    hits = index if category is None else index.where(F.col("category_name") == category)
    hits = hits if document_id is None else hits.where(F.col("document_id") == document_id)
    for c in times:
        hits = hits.where(c > 0)
    snippet = snippets.window(F.col("text"), F.lit(terms[0]))
    return hits.select(snippet.alias("text"), "page_number", "category_name", snippet.alias("context_snippet"), "record_id", F.lit(50.0).alias("rank"), F.lit(label).alias("match_field"), "document_id", rank.alias("bm25"))


def first(index: DataFrame, query: str, limit: int | None, category: str | None = None, document_id: int | None = None) -> DataFrame:
    """The first hits by page and rank (limit None: all), in the columns of a search's result; index: entries, or a stored postings.Index."""
    if not isinstance(index, DataFrame):
        return index.first(query, limit, category, document_id)
    found = match(index, query, category, document_id, "FTS" if category is None else "Category FTS")
    if "bm25" not in found.columns:
        return found.sparkSession.createDataFrame([], "text string, page_number int, category_name string, context_snippet string, record_id bigint, rank double, match_field string, document_id bigint")
    rows = found.orderBy("page_number", "bm25", F.coalesce("record_id", F.lit(0)), "document_id")
    return (rows if limit is None else rows.limit(limit)).drop("bm25")


def clear(index: DataFrame, document_id: int) -> DataFrame:
    return index.where(F.col("document_id") != document_id)


def plain_prefix(texts: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Rows whose ASCII tokens have every term as a prefix, without stemming: native throughout."""
    words = F.split(F.lower(column), r"[^\p{L}\p{N}]+")
    for t in index_terms(query):
        texts = texts.where(F.exists(words, lambda x: x.startswith(t.lower())))  # noqa: B023
    return texts
