"""A stored inverted index: postings by term, entries with their lengths, documents replaced one generation at a time.

A generation holds the entries (records and pages) of some documents. Their texts are stored once. A part is a run of entries;
its postings lie in blocks, one for each term, that hold the term's entries and places in them; what a result needs of
an entry is stored once, by parts. Blocks are sorted and range-partitioned by (term, entry) into shards, and a small table says
which terms each shard holds: a search reads the shards of its prefixes, and in them, by Parquet's statistics, the row
groups. A document's entries are those of the newest generation that names it, so replacing a document writes a small
generation and rewrites none. A generation counts once its commit is written, which comes last. compact() makes one of all.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.variants import index_terms
from . import fulltext

#: Postings in a shard, about, so few that a task sorts them in memory; never more shards than MOST_SHARDS. Bytes of a row group, so that prefixes can leave most out.
SHARD_ROWS, MOST_SHARDS, GROUP_BYTES = 1_000_000, 65_536, 8 << 20
#: Tokens of a part, about: a Python worker holds a number for each, and their terms, besides those of one text. Most entries of a part.
PART_TOKENS, MOST_ENTRIES = 1_000_000, 32_767
#: Tokens of a snippet; points of a term's first and further occurrences, of a window that begins the text or a sentence.
WINDOW, FIRST, MORE, TEXT_START, SENTENCE_START = 64, 1000, 1, 120, 100
_ENTRY = "entry bigint, document_id bigint, page_number int, record_id bigint, category_name string, n_tokens int"
_TEXT = "entry bigint, document_id bigint, page_number int, record_id bigint, category_name string, text string"
_POSTING = f"term string, tf int, positions array<int>, {_ENTRY}"
#: A term in a part: entries as distances from first (null: that one alone), where each one's places end (null: one place in each), all places.
_BLOCK = "term string, first bigint, own array<smallint>, ends array<int>, places array<int>"
_ABOUT = f"about array<struct<{_ENTRY}>>"


def _blocks(entries: DataFrame) -> DataFrame:
    """A row for each term of a part of the entries (_TEXT), and one without a term, that has what is stored about them."""
    columns = ["entry", "document_id", "page_number", "record_id", "category_name"]

    def listed(offsets: np.ndarray, values: np.ndarray, left_out: np.ndarray | None = None) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=None if left_out is None else pa.array(left_out))

    def part(slices: list[pa.RecordBatch], terms: dict[str, int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes, rest = np.array([len(c) for c in codes], np.int32), pa.Table.from_batches(slices).combine_chunks().to_batches()[0]
        own = pa.StructArray.from_arrays([*rest.columns, pa.array(sizes)], [*columns, "n_tokens"])
        about = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        first, kinds = rest.column(0)[:1], (pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ["term", "first", "own", "ends", "places", "about"]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), first, *[pa.nulls(1, k) for k in kinds], about], names)
        if not terms:
            return
        # By term, then by entry and place, in which order the tokens come.
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable").astype(np.int32)
        code, row = code[order], np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)[order]
        place = order - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)[order]
        begun = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
        of = np.arange(len(terms) + 1)
        lists, tokens = np.searchsorted(code[begun], of), np.searchsorted(code, of)
        ends = np.append(begun[1:], len(code)) - tokens[code[begun]]
        alone, once = np.diff(lists) == 1, np.diff(lists) == np.diff(tokens)
        firsts = first[0].as_py() + np.where(alone, row[begun][lists[:-1]], 0).astype(np.int64)
        arrays = [pa.array(terms, pa.string()), pa.array(firsts), listed(lists, row[begun], alone), listed(lists, ends.astype(np.int32), once), listed(tokens, place), pa.nulls(len(terms), about.type)]
        yield pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, slices, terms, codes = 0, None, [], {}, []
        for batch in batches:
            texts, rest, begin = batch.column(0), batch.select(columns), 0
            for i, entry in enumerate(rest.column(0).to_pylist()):
                if codes and (held >= PART_TOKENS or len(codes) >= MOST_ENTRIES or entry != last + 1):
                    yield from part([*slices, rest.slice(begin, i - begin)], terms, codes)
                    held, begin, slices, terms, codes = 0, i, [], {}, []
                tokens = fulltext.fold(texts[i].as_py())
                codes.append(np.fromiter((terms.setdefault(t, len(terms)) for t in tokens), np.int32, len(tokens)))
                held, last = held + len(tokens), entry
            slices.append(rest.slice(begin))
        if codes:
            yield from part(slices, terms, codes)

    storage.small_batches(entries.sparkSession)
    return entries.select("text", *columns).mapInArrow(run, f"{_BLOCK}, {_ABOUT}")


def _each(blocks: DataFrame, places: bool = True) -> DataFrame:
    """gen, term, entry, tf and, with places, positions of the postings in blocks."""
    end = lambda i: F.coalesce(F.get("ends", i), i + 1)
    begin = lambda i: F.when(i > 0, end(i - 1)).otherwise(0)

    def posting(x: Column, i: Column) -> Column:
        fields = [(F.col("first") + x).alias("entry"), (end(i) - begin(i)).alias("tf")]
        return F.struct(*fields, *[F.slice("places", begin(i) + 1, end(i) - begin(i)).alias("positions")] * places)

    own = F.coalesce("own", F.array(F.lit(0).cast("smallint")))
    return blocks.select("gen", "term", F.inline(F.transform(own, posting)))


class Index:
    """The index at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # ---- generations

    def generations(self) -> list[int]:
        """The committed ones, in order."""
        fs, at = storage.filesystem(self.spark, self.path)
        top = at(f"{self.path}/commits")
        if not fs.exists(top):
            return []
        return sorted(int(f.getPath().getName().removeprefix("gen=")) for f in fs.listStatus(top) if f.getPath().getName().startswith("gen="))

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table's rows of all committed generations, with gen."""
        found = self.generations()
        if not found:
            return self.spark.createDataFrame([], f"{schema}, gen int")
        paths = [f"{self.path}/{name}/gen={g}" for g in found]
        return self.spark.read.schema(f"{schema}, gen int").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows without what newer generations have replaced."""
        found = self.generations()
        if len(found) < 2:
            return rows
        # Only documents that a later generation names can be stale.
        newest = self.documents_of_generations().where(F.col("gen") > found[0]).groupBy("document_id").agg(F.max("gen").alias("newest"))
        stale = newest.withColumnRenamed("document_id", "of")
        return rows.join(stale, (F.col("of") == F.col("document_id")) & (F.col("gen") < F.col("newest")), "left_anti")

    def documents_of_generations(self) -> DataFrame:
        """document_id, entries, tokens and gen: what a generation holds of a document, none of a deleted one."""
        return self._read("documents", "document_id bigint, entries bigint, tokens bigint")

    def entries(self) -> DataFrame:
        lengths = self._about().select("gen", "entry", "n_tokens")
        return self.texts().join(lengths, ["gen", "entry"]).select(*_names(_ENTRY), "text", "gen")

    def texts(self) -> DataFrame:
        """The entries without their lengths."""
        return self._live(self._read("entries", _TEXT))

    def _about(self) -> DataFrame:
        """gen and what _ENTRY names of all entries, from a table without their texts."""
        return self._read("parts", _ABOUT).select("gen", F.inline("about"))

    def named(self, rows: DataFrame) -> DataFrame:
        """rows (gen, entry) of live entries, with what _ENTRY names."""
        return self._live(rows.join(self._about(), ["gen", "entry"]))

    def terms(self) -> DataFrame:
        """The dictionary: each generation's terms with the numbers of entries and occurrences."""
        return self._read("terms", "term string, entries bigint, occurrences bigint")

    def lengths(self) -> tuple[int, float]:
        """Number of entries and their mean length in tokens."""
        row = self._live(self.documents_of_generations()).agg(F.sum("entries"), F.sum("tokens")).first()
        return row[0] or 0, (row[1] or 0) / row[0] if row[0] else 1.0

    def write(self, entries: DataFrame, documents: DataFrame | None = None) -> int:
        """A new generation of entries (text, page_number, document_id, record_id, category_name), which replace all that was
        there of their documents, and of those in documents (document_id): without entries these are gone. Null and empty
        texts are entries without terms; repeated rows are entries of their own. Returns its number."""
        found = self.generations()
        g = found[-1] + 1 if found else 0
        here = lambda name: f"{self.path}/{name}/gen={g}"
        own = entries.select("text", F.col("document_id").cast("long"), F.col("page_number").cast("int"), F.col("record_id").cast("long"), "category_name")
        found_blocks = storage.scratch(self.spark, "blocks")
        with storage.shuffles_removed(self.spark):
            _write(own.withColumn("entry", F.monotonically_increasing_id()).select(*_names(_TEXT)), here("entries"))
            _write(_blocks(self.spark.read.schema(_TEXT).parquet(here("entries"))), found_blocks)
            every = self.spark.read.schema(f"{_BLOCK}, {_ABOUT}").parquet(found_blocks)
            rows, about = every.where("term IS NOT NULL").drop("about"), every.where("term IS NULL").select("about")
            shards = min(MOST_SHARDS, max(8, (rows.agg(F.sum(F.coalesce(F.size("own"), F.lit(1)))).first()[0] or 0) // SHARD_ROWS))
            _write(about.coalesce(max(1, shards // 16)), here("parts"))
            held = about.select(F.inline("about")).groupBy("document_id").agg(F.count("*").alias("entries"), F.sum("n_tokens").cast("long").alias("tokens"))
            if documents is not None:
                none = documents.select(F.col("document_id").cast("long")).distinct().join(held, "document_id", "left_anti")
                held = held.unionByName(none.select("document_id", F.lit(0).cast("long").alias("entries"), F.lit(0).cast("long").alias("tokens")))
            _write(held, here("documents"))
            # Long lists of frequent terms are parted by entry.
            sorted_ = rows.repartitionByRange(shards, "term", "first").sortWithinPartitions("term", "first").withColumn("shard", F.spark_partition_id())
            _write(sorted_, here("postings"), "shard")
            storage.remove(self.spark, found_blocks)
            written = self.spark.read.schema(f"{_BLOCK}, shard int").parquet(here("postings"))
            _write(written.groupBy("shard").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1), here("ranges"))
            dictionary = written.groupBy("term").agg(F.sum(F.coalesce(F.size("own"), F.lit(1))).cast("long").alias("entries"), F.sum(F.size("places")).cast("long").alias("occurrences"))
            _write(dictionary.repartitionByRange(max(1, shards // 8), "term").sortWithinPartitions("term"), here("terms"))
            _write(self.spark.range(1), here("commits"))
        return g

    def compact(self, path: str) -> Index:
        """An index at path that has in one generation what this one has in all."""
        out = Index(self.spark, path)
        out.write(self.texts())
        return out

    # ---- searching

    def postings(self, prefixes: list[str]) -> DataFrame:
        """Live postings of terms that begin with one of the prefixes: only the shards that can hold them are read."""
        return self.named(_each(self._blocks(prefixes))).select(*_names(_POSTING), "gen")

    def _blocks(self, prefixes: list[str]) -> DataFrame:
        found = self.generations()
        if not found or not prefixes:
            return self._shards([])
        meets = _any([(F.col("low") <= p + "\U0010ffff") & (F.col("high") >= p) for p in prefixes])
        rows = self._shards(self._ranges().where(meets).select("gen", "shard").collect())
        return rows.where(_any([F.col("term").startswith(p) for p in prefixes]))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """Live postings of the terms in a table: only the shards that can hold them are read."""
        return self.named(_each(self._blocks_of(terms))).select(*_names(_POSTING), "gen")

    def counts_of(self, terms: DataFrame) -> DataFrame:
        """gen, term, entry and tf of the postings of the terms in a table, stale ones among them (named() drops these)."""
        return _each(self._blocks_of(terms), places=False)

    def _blocks_of(self, terms: DataFrame) -> DataFrame:
        own = self._ranges().join(terms, (F.col("low") <= F.col("term")) & (F.col("high") >= F.col("term")), "left_semi").select("gen", "shard").collect()
        return self._shards(own).join(terms, "term", "left_semi")

    def _ranges(self) -> DataFrame:
        return self._read("ranges", "shard int, low string, high string")

    def _shards(self, own: list) -> DataFrame:
        """The blocks in shards (rows of gen and shard: MOST_SHARDS of a generation at most)."""
        schema = f"{_BLOCK}, gen int, shard int"
        if not own:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/postings/gen={r.gen}/shard={r.shard}" for r in sorted(own)]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(*paths)

    def match(self, query: str, category: str | None = None, document_id: int | None = None) -> DataFrame:
        """Entries (gen and what _ENTRY names) that have every term of the query as a prefix, with bm25 (lower is better), hits
        (struct of place and number of the term) and terms. Statistics are those of the whole index."""
        terms = list(dict.fromkeys(t for word in index_terms(query.rstrip("*")) for t in fulltext.fold(word)))
        blocks = self._blocks(terms)
        count = lambda i: F.sum(F.when(F.col("term").startswith(terms[i]), F.col("tf")).otherwise(0))
        placed = lambda i: F.flatten(F.collect_list(F.when(F.col("term").startswith(terms[i]), F.transform("positions", lambda p: F.struct(p.alias("place"), F.lit(i).alias("number"))))))
        keys, about = ["gen", "entry"], ["document_id", "page_number", "record_id", "category_name", "n_tokens"]
        if not terms:
            return self.postings([]).select(*keys, *about, F.lit(0.0).alias("bm25"), F.array().cast("array<struct<place:int,number:int>>").alias("hits"))
        counts = self.named(_each(blocks, places=False).groupBy(*keys).agg(*[count(i).alias(f"t{i}") for i in range(len(terms))]))
        held = counts.agg(*[F.count_if(F.col(f"t{i}") > 0) for i in range(len(terms))]).first()
        total, mean = self.lengths()
        grouped = _each(blocks).groupBy(*keys).agg(*[count(i).alias(f"t{i}") for i in range(len(terms))], F.sort_array(F.concat(*[placed(i) for i in range(len(terms))])).alias("hits"))
        for i in range(len(terms)):
            grouped = grouped.where(F.col(f"t{i}") > 0)
        grouped = self.named(grouped)
        if category is not None:
            grouped = grouped.where(F.col("category_name") == category)
        if document_id is not None:
            grouped = grouped.where(F.col("document_id") == document_id)
        rank = F.lit(0.0)
        for i, n in enumerate(held):
            idf, c = max(math.log((total - n + 0.5) / (n + 0.5)), fulltext.LEAST_IDF), F.col(f"t{i}")
            rank = rank - idf * c * (fulltext.K1 + 1) / (c + fulltext.K1 * (1 - fulltext.B + fulltext.B * F.col("n_tokens") / mean))
        return grouped.select(*keys, *about, rank.alias("bm25"), "hits")

    def shown(self, hits: DataFrame) -> DataFrame:
        """hits with snippet: what is in the best window of the entry's text, each hit in bold."""
        storage.small_batches(self.spark)
        texts = self._read("entries", _TEXT).select("gen", "entry", "text")
        return hits.join(texts, ["gen", "entry"]).withColumn("snippet", _snippet("text", "hits"))

    def first(self, query: str, limit: int | None, category: str | None = None, document_id: int | None = None) -> DataFrame:
        """The first hits by page and rank (limit None: all), in the columns of a search's result; only their texts are read."""
        top = self.match(query, category, document_id).orderBy("page_number", "bm25", F.coalesce("record_id", F.lit(0)), "document_id")
        top = top if limit is None else top.limit(limit)
        label = "FTS" if category is None else "Category FTS"
        return self.shown(top).select(F.col("snippet").alias("text"), "page_number", "category_name", F.col("snippet").alias("context_snippet"), "record_id", F.lit(50.0).alias("rank"), F.lit(label).alias("match_field"), "document_id")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def best_window(hits: list[tuple[int, int]], size: int, sentences: list[int]) -> int:
    """First token of the window of WINDOW tokens to show of a text of so many; hits: (place, term), by place.

    Windows begin at a hit, then lie about its hits; or at the sentence that a hit stands in. The first of the best counts.
    """
    places = [p for p, _ in hits]

    def score(start: int) -> tuple[int, int, int]:
        seen: set[int] = set()
        points, first, last = 0, -1, 0
        for place, term in hits[bisect_left(places, start) : bisect_left(places, start + WINDOW)]:
            points += MORE if term in seen else FIRST
            seen.add(term)
            first, last = (place if first < 0 else first), place + 1
        return points, first, last

    best, at = 0, 0
    for place in places:
        points, first, last = score(place)
        if points > best:
            best, at = points, max(0, min(first - (WINDOW - (last - first)) // 2, size - WINDOW))
        begun = sentences[bisect_right(sentences, place) - 1] if size > WINDOW else place
        if begun < place:
            points = score(begun)[0] + (TEXT_START if begun == 0 else SENTENCE_START)
            if points > best:
                best, at = points, begun
    return at


def sentence_starts(text: str, tokens: list[tuple[int, int]]) -> list[int]:
    """The first token, and those after a full stop or colon and white space."""
    out = []
    for i, (a, _) in enumerate(tokens):
        b = a
        while b and text[b - 1] in " \t\n\r":
            b -= 1
        if i == 0 or 0 < b < a and text[b - 1] in ".:":
            out.append(i)
    return out


def snippet(text: str, hits: list[tuple[int, int]]) -> str:
    """The best window of the text with its hits in bold, dots where text is left out."""
    own = fulltext.spans(text)
    at = best_window(hits, len(own), sentence_starts(text, own))
    marked = {p for p, _ in hits}
    shown = own[at : at + WINDOW]
    out, here = [], 0 if at == 0 else shown[0][0]
    for i, (a, b) in enumerate(shown, at):
        if i in marked:
            out += [text[here:a], "<b>", text[a:b], "</b>"]
            here = b
    out.append(text[here:] if at + WINDOW >= len(own) else text[here : shown[-1][1]])
    return ("..." if at > 0 else "") + "".join(out) + ("..." if at + WINDOW < len(own) else "")


def _snippet(text: str, hits: str) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, places: pa.Array) -> pa.Array:
        # One text and its hits at a time.
        return pa.array([snippet(t.as_py() or "", [(h["place"], h["number"]) for h in own.as_py()]) for t, own in zip(texts, places, strict=True)], pa.string())

    return run(F.col(text), F.col(hits))
