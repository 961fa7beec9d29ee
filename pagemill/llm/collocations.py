"""Phrase collocation mining: phrases of a few words, scored by how often they occur whole against their parts.

Two readings of the texts. The first adds all runs of one to LONGEST words, hashed with their language, into a sketch
(one row of counters, as wide as the input asks for, dealt in slices): a counter is an upper bound of the runs that fall
on it. In the second every shard of the texts, a few million words, spells out those of its runs whose bound reaches the
threshold, compiles them into Aho-Corasick automata, one for each language, and counts all their matches in the shard,
overlapping ones too. In the automata a word is a code of a few characters whose first kind stands nowhere else, and whatever
is no word of a candidate is a delimiter that no candidate holds; so matches are of whole words within a piece. The
shards' counts are summed before the threshold applies: they are exact, and no list of candidates is collected or sent.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

LONGEST = 4
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_BREAKS = _ENDS.copy()
_BREAKS[list(BLANKS)] = True
_LOWER = bytes(shared.LOWER)
_TOKENS = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+|[.,;:!?\n\x0b\x0c\r]+")
#: Counters in a slice of the sketch (a power of two) and bytes of text for each slice.
SLICE_BITS, SLICE_BYTES, LEAST_SLICES = 25, 16 << 20, 64
#: Runs hashed before a task hands on its counts.
FLUSH = 6_000_000
#: Bits of the filter of candidates' counters, and how many of them a counter sets.
LEAST_BITS, MOST_BITS, BITS_EACH, PROBES, CHUNK = 19, 28, 16, 3, 16
#: Words in a shard, about; tokens read and matches kept at once.
SHARD, TOKENS, MATCHES = 2_000_000, 1 << 18, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- runs of words, hashed


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Batch:
    """The words of a batch of texts."""

    def __init__(self, langs, texts) -> None:
        self.langs = langs.to_pylist()
        self.raw, self.at = shared.utf8(texts)
        self.first, self.last = shared.word_bounds(self.raw, self.at, _BREAKS)
        self.row = np.searchsorted(self.at[1:], self.first, "right")
        # Both rise, so that words of one row and piece are those of one sum.
        self.piece = self.row + np.searchsorted(np.flatnonzero(_ENDS[self.raw]), self.first)

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes, first words) of all runs of n words within a piece."""
        seed = {x: _seed(x) for x in set(self.langs)}
        own = np.array([seed[x] for x in self.langs], np.uint64)
        words = shared.bound_hashes(self.raw, self.first, self.last)
        h = shared.mix(words + own[self.row]) if len(words) else words
        yield 1, h, np.arange(len(h))
        for n in range(2, LONGEST + 1):
            h = shared.mix(h[:-1] * _ODD + words[n - 1 :])
            whole = np.flatnonzero(self.piece[: len(h)] == self.piece[n - 1 :])
            yield n, h[whole], whole

    def phrase(self, first: int, n: int) -> bytes:
        words = self.raw[self.first[first] : self.last[first + n - 1]].tobytes().translate(_LOWER)
        return b" ".join(words.split()) if n > 1 else words


# ---------------------------------------------------------------- the sketch


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.diff(keys, prepend=0).astype(np.uint32).tobytes() + counts.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def _unpack(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(data, decompressed_size=5 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64), np.frombuffer(raw, np.uint8, n, 4 * n)


def _bounds(docs: DataFrame, slices: int, least: int) -> DataFrame:
    """Counters (key) that may hold a run that occurs least times. Tasks hand on each slice's counters that they met, packed."""
    import pyarrow as pa

    shift = np.uint64(64 - SLICE_BITS - (slices.bit_length() - 1))
    cap = min(least, 100)

    def packed(hashes: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(hashes) >> shift, return_counts=True)
        of = (keys >> np.uint64(SLICE_BITS)).astype(np.int64)
        own, begin = np.unique(of, return_index=True)
        ends = [*begin[1:], len(of)]
        slots = (keys & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)
        data = [_pack(slots[a:b], np.minimum(counts[a:b], cap)) for a, b in zip(begin, ends, strict=True)]
        return pa.RecordBatch.from_pydict({"slice": pa.array(own, pa.int32()), "n": pa.array(np.diff([*begin, len(of)]), pa.int32()), "packed": pa.array(data, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, hashes, _ in Batch(batch.column(0), batch.column(1)).runs():
                if len(hashes):
                    held.append(hashes)
                    n += len(hashes)
            if n >= FLUSH:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    # A task's counters stop at the cap, so a sum that reaches the threshold does so with them too; a higher threshold
    # than the cap lets more candidates through, which are counted exactly later on.
    def total(own: pa.Table) -> pa.Table:
        counters = np.zeros(1 << SLICE_BITS, np.uint8)
        for n, data in zip(own["n"].to_pylist(), own["packed"], strict=True):
            slots, counts = _unpack(n, data.as_py())
            counters[slots] = np.minimum(counters[slots] + counts, 155)
        high = own["slice"][0].as_py()
        return pa.table({"key": pa.array((np.int64(high) << SLICE_BITS) + np.flatnonzero(counters >= cap), pa.int64())})

    parts = docs.mapInArrow(count, "slice int, n int, packed binary")
    return parts.groupBy("slice").applyInArrow(total, "key bigint")


_STEPS = np.arange(1, PROBES + 1, dtype=np.uint64) * _ODD


def _probe(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The bit of each key that the k-th probe looks at."""
    return shared.mix(keys + _STEPS[k]) >> np.uint64(64 - bits)


def _filter(bounds: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of the n keys in bounds: the exponent of its bits, and they; 32 MB at most."""
    import pyarrow as pa

    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for k in range(PROBES):
                at = _probe(keys, k, bits).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(at >> CHUNK, pa.int32()), "bit": pa.array(at & ((1 << CHUNK) - 1), pa.int32())})

    def chunk(own: pa.Table) -> pa.Table:
        on = np.zeros(1 << CHUNK, bool)
        on[own["bit"].to_numpy()] = True
        return pa.table({"chunk": pa.array([own["chunk"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    got = bounds.mapInArrow(places, "chunk int, bit int").groupBy("chunk").applyInArrow(chunk, "chunk int, bits binary").toArrow()
    for c, data in zip(got["chunk"].to_pylist(), got["bits"], strict=True):
        out[c << (CHUNK - 3) : (c + 1) << (CHUNK - 3)] = np.frombuffer(data.as_py(), np.uint8)
    return bits, out


# ---------------------------------------------------------------- the automata

#: A word's code: one character of the first kind, then as many of the second as the number of words asks for.
BASE, _LEAD, _REST = 64, 0x40, 0x80
DELIMITER = "\x01"


def _code(k: int, width: int) -> str:
    digits = []
    for _ in range(width - 1):
        k, d = divmod(k, BASE)
        digits.append(chr(_REST + d))
    return chr(_LEAD + k) + "".join(reversed(digits))


class Automaton:
    """Phrases of one language (words parted by a space)."""

    def __init__(self, phrases: list[bytes]) -> None:
        import ahocorasick

        parts = [p.split(b" ") for p in phrases]
        words = list(dict.fromkeys(w for ws in parts for w in ws))
        width = 1
        while BASE**width < len(words):
            width += 1
        self.codes = {w: _code(k, width) for k, w in enumerate(words)}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, ws in enumerate(parts):
            self.find.add_word("".join([self.codes[w] for w in ws]), i)
        self.find.make_automaton()

    def matches(self, text: bytes) -> Iterator[list[int]]:
        """Numbers of the phrases at all their places in the text, a part of it at a time."""
        get, search, tokens = self.codes.get, None, _TOKENS.finditer(text.translate(_LOWER))
        while part := "".join([get(m[0], DELIMITER) for m in islice(tokens, TOKENS)]):
            if search is None:
                search = self.find.iter(part)
            else:
                search.set(part)
            yield [k for _, k in search]


def _counted(docs: DataFrame, slices: int, least: int) -> DataFrame:
    """lang, phrase, words, f of all runs that occur least times."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    bounds = shared.cut(_bounds(docs, slices, least), "bounds")
    sent = spark.sparkContext.broadcast(_filter(bounds, bounds.count()))
    shared.forget(bounds)
    shift = np.uint64(64 - SLICE_BITS - (slices.bit_length() - 1))

    def spelt(shard: list[Batch]) -> dict[str, tuple[list[bytes], list[int]]]:
        """For each language its candidates in the shard, and how many words they have."""
        bits, on = sent.value
        seen, out = np.zeros(0, np.uint64), {}
        for own in shard:
            met = [seen]
            for n, hashes, firsts in own.runs():
                left = np.arange(len(hashes))
                for k in range(PROBES):
                    at = _probe(hashes[left] >> shift, k, bits)
                    left = left[(on[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                new, i = np.unique(hashes[left], return_index=True)
                if len(seen):
                    fresh = seen[np.minimum(np.searchsorted(seen, new), len(seen) - 1)] != new
                    new, i = new[fresh], i[fresh]
                met.append(new)
                for first in firsts[left[i]].tolist():
                    phrases, words = out.setdefault(own.langs[own.row[first]], ([], []))
                    phrases.append(own.phrase(first, n))
                    words.append(n)
            seen = np.unique(np.concatenate(met))
        return out

    def counted(shard: list[Batch]) -> Iterator[pa.RecordBatch]:
        for lang, (phrases, words) in spelt(shard).items():
            automaton, held, total = Automaton(phrases), [], np.zeros(len(phrases), np.int64)
            for own in shard:
                for row in (r for r, x in enumerate(own.langs) if x == lang):
                    for found in automaton.matches(own.raw[own.at[row] : own.at[row + 1]].tobytes()):
                        held += found
                        if len(held) >= MATCHES:
                            total += np.bincount(held, minlength=len(total))
                            held = []
            if held:
                total += np.bincount(held, minlength=len(total))
            # A row for each bucket: many phrases' counts move as arrays.
            of = np.fromiter(map(zlib.crc32, phrases), np.int64, len(phrases)) % slices
            order = np.argsort(of, kind="stable")
            own, begin = np.unique(of[order], return_index=True)
            ends = pa.array([*begin, len(order)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, a.take(pa.array(order))) for a in (pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(words, pa.int32()), pa.array(total, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([lang] * len(own), pa.string()), *lists], names=["bucket", "lang", "phrase", "words", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n = [], 0
        for batch in batches:
            shard.append(Batch(batch.column(0), batch.column(1)))
            n += len(shard[-1].first)
            if n >= SHARD:
                yield from counted(shard)
                shard, n = [], 0
        if n:
            yield from counted(shard)

    def summed(own: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        sizes = pc.list_value_length(own["f"])
        langs = own["lang"].take(pa.array(np.repeat(np.arange(own.num_rows), sizes.to_numpy())))
        flat = pa.table({"lang": langs, **{c: pc.list_flatten(own[c]) for c in ("phrase", "words", "f")}})
        total = flat.group_by(["lang", "phrase"]).aggregate([("words", "min"), ("f", "sum")]).rename_columns({"words_min": "words", "f_sum": "f"})
        return total.filter(pc.greater_equal(total["f"], least)).select(["lang", "phrase", "words", "f"])

    parts = docs.mapInArrow(count, "bucket int, lang string, phrase array<string>, words array<int>, f array<bigint>")
    return parts.groupBy("bucket").applyInArrow(summed, "lang string, phrase string, words int, f bigint")


# ---------------------------------------------------------------- scores


def phrases(docs: DataFrame, least: int = 30, keep: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, words, a, l, r, n, score, k of all phrases that stay.

    a: occurrences within pieces, overlapping ones too; l, r: those of the parts before and after the k-th word; n: all
    words of the language; score: floor(2000000 * a / (l + r)) of the cut where that is least, the earliest of equal ones.
    A phrase goes where a longer one that holds it has at least keep percent of its occurrences. Null languages are `und`;
    null and empty texts have no words; very long ones are read whole, a part at a time in the automata; repeated rows
    count each time; an empty table has no phrases; other columns are ignored, whatever they are called.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    word = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
    totals = own.groupBy("lang").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(word)).cast("long")).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    totals = shared.cut(totals, "totals")
    size = totals.agg(F.sum("bytes")).first()[0] or 0
    slices = 1 << max(LEAST_SLICES - 1, size // SLICE_BYTES).bit_length()
    counted = shared.cut(_counted(own, slices, least), "counted")
    words = F.split("phrase", " ")
    part = lambda at, n: F.concat_ws(" ", F.slice(words, at, n))
    several = counted.where("words > 1")
    cuts = several.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("before"), part(F.col("k") + 1, F.col("words")).alias("after"))
    for side, name in (("before", "l"), ("after", "r")):
        cuts = cuts.join(counted.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("(2000000BD * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(least_cut)
    # What each phrase is part of: the highest count of a longer one.
    inner = several.where("words > 2").select("lang", "f", words.alias("w"), F.col("words").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("longer") - F.col("size") + 1)).alias("at"))
    held = inner.select("lang", "f", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("size"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (big("most") * 100 < big("a") * keep))
    return kept.join(totals.select("lang", "n"), "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"), "cut.k")


def mine(docs: DataFrame, top: int = 2000, **how) -> DataFrame:
    """The first top phrases of each language, ranked by score, count (both descending) and phrase; how: as of phrases()."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases(docs, **how).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
