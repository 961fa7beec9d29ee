"""Benchmark decontamination: occurrences of benchmark passages in documents, by Wu-Manber search over words.

A benchmark item gives its windows of WINDOW consecutive words; an item of fewer words is one window. Texts are read
as sequences of 64-bit word hashes. For each length of windows there is a table of shifts by the hash of a block of two
words: where a block occurs in no window, or only early in one, the search moves on by as many words as no window can
end within. Where the shift is 0 the block's hash selects a bucket of test strings, the hash of all of a window's words
one of them, and the text itself is compared with it. Numpy moves many places at once: the words of a batch are cut
into lanes, each searched from its first word to its last; a window may begin in the lane before.

The tables are sent to all tasks, so the benchmark is worked through in blocks of at most BLOCK_BYTES or so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 10
#: Bytes that separate words: all of ASCII but digits and letters.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower case for A-Z, a space for separators.
_PLAIN = np.where(BREAKS, 0x20, shared.LOWER).astype(np.uint8)
#: Words of an item in one row of the benchmark's table, bytes in a block, blocks searched in one pass.
PIECE_WORDS, BLOCK_BYTES, BLOCKS_A_PASS = 1_000, 4 << 20, 3
#: Words in a lane, words hashed together, most bits of a table of shifts.
LANE, GRAM, MOST_BITS = 256, 2, 26
_MIXERS = shared.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _plain_words(text: bytes) -> list[bytes]:
    return _PLAIN[np.frombuffer(text, np.uint8)].tobytes().split()


def _multipliers(n: int) -> np.ndarray:
    return _MIXERS[np.arange(n) % len(_MIXERS)] + np.arange(n, dtype=np.uint64) // np.uint64(len(_MIXERS)) * np.uint64(2)


class Tables:
    """Windows of one length: shifts by block, buckets by suffix block, and the windows themselves."""

    def __init__(self, length: int, windows: list[bytes], items: list[list[int]]) -> None:
        self.length, self.gram = length, min(GRAM, length)
        raw = b" ".join(windows)
        at = np.array([0, len(raw)])
        hashes = shared.word_hashes(np.frombuffer(raw, np.uint8), at, BREAKS)[0].reshape(len(windows), length)
        blocks = length - self.gram + 1
        self.bits = min(MOST_BITS, max(12, (len(windows) * blocks * 8).bit_length()))
        self.shift = np.full(1 << self.bits, blocks, np.min_scalar_type(blocks))
        for end in range(self.gram, length + 1):  # the last, with the least shift, stays
            self.shift[self.slots(hashes.reshape(-1), np.arange(len(windows)) * length + end - 1)] = length - end
        keys = self.keys(hashes.reshape(-1), np.arange(len(windows)) * length + length - 1)
        order = np.argsort(keys, kind="stable")
        self.buckets = keys[order]
        self.windows = [windows[i] for i in order]
        self.items = [np.array(sorted(set(items[i])), np.int64) for i in order]

    def slots(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of the blocks that end at these words."""
        h = hashes[ends]
        for k in range(1, self.gram):
            h = h + hashes[ends - k] * _MIXERS[k]
        return shared.mix(h) >> np.uint64(64 - self.bits)

    def keys(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bucket (upper bits) and whole window's hash (lower bits) of the windows that end at these words."""
        total = np.zeros(len(ends), np.uint64)
        for k, m in enumerate(_multipliers(self.length)):
            total += hashes[ends - k] * m
        return (self.slots(hashes, ends) << np.uint64(64 - self.bits)) | (shared.mix(total) >> np.uint64(self.bits))

    def occurrences(self, hashes: np.ndarray, starts: np.ndarray, same) -> Iterator[tuple[int, int]]:
        """(last word, window) of all occurrences; starts: first words of rows. same(first, last, window) compares texts."""
        n, found = len(hashes), []
        at = np.arange(self.length - 1, n, LANE)
        end = np.minimum(at + LANE, n)
        while len(at):
            step = self.shift[self.slots(hashes, at)].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        ends = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        row_start = starts[np.searchsorted(starts, ends, "right") - 1]
        ends = ends[row_start <= ends - self.length + 1]
        keys = self.keys(hashes, ends)
        lo, hi = np.searchsorted(self.buckets, keys, "left"), np.searchsorted(self.buckets, keys, "right")
        hit = hi > lo
        for e, a, b in zip(ends[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True):
            for w in range(a, b):
                if same(e - self.length + 1, e, self.windows[w]):
                    yield e, w
                    break


class Search:
    """Tables for the pieces of a block of the benchmark: (item, words joined by a space)."""

    def __init__(self, pieces: list[tuple[str, bytes]]) -> None:
        self.names = sorted({i for i, _ in pieces})
        number = {i: k for k, i in enumerate(self.names)}
        windows: dict[int, dict[bytes, list[int]]] = {}
        for item, text in pieces:
            words = text.split(b" ")
            n = min(WINDOW, len(words))
            for k in range(len(words) - n + 1):
                windows.setdefault(n, {}).setdefault(b" ".join(words[k : k + n]), []).append(number[item])
        self.tables = [Tables(n, list(own), list(own.values())) for n, own in sorted(windows.items())]

    def rows(self, raw: np.ndarray, at: np.ndarray, earlier: list) -> tuple[np.ndarray, list[list[dict]], list[set[str]]]:
        """For each row: its words, the runs of words hit (those in earlier too), the items found."""
        first, last = shared.word_bounds(raw, at, BREAKS)
        hashes, starts = shared.bound_hashes(raw, first, last), np.searchsorted(first, at)
        plain = _PLAIN[raw].tobytes()

        def same(a: int, b: int, window: bytes) -> bool:
            own = plain[first[a] : last[b]]
            return own == window or len(own) > len(window) and b" ".join(own.split()) == window

        edges = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(at) - 1)]
        for t in self.tables:
            met = list(t.occurrences(hashes, starts[:-1], same))
            if not met:
                continue
            ends, which = np.array(met).T
            np.add.at(edges, ends - t.length + 1, 1)
            np.add.at(edges, ends + 1, -1)
            of = np.searchsorted(starts, ends, "right") - 1
            for r, w in set(zip(of.tolist(), which.tolist(), strict=True)):
                items[r].update(self.names[k] for k in t.items[w].tolist())
        for r, runs in enumerate(earlier):
            for run in runs or ():
                edges[starts[r] + run["start"]] += 1
                edges[starts[r] + run["stop"]] -= 1
        hit = np.cumsum(edges[:-1]) > 0
        turns = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        begins, stops = turns[::2], turns[1::2]
        # A run that goes from one row into the next is two.
        cuts = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(hit))]
        cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]])
        begins, stops = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([stops, cuts]))
        of = np.searchsorted(starts, begins, "right") - 1
        spans: list[list[dict]] = [[] for _ in range(len(at) - 1)]
        for r, a, b in zip(of.tolist(), begins.tolist(), stops.tolist(), strict=True):
            spans[r].append({"start": a - int(starts[r]), "stop": b - int(starts[r])})
        return np.diff(starts), spans, items


def _pieces(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Item, block-sized texts of its words joined by a space; pieces overlap, so that each window lies in one."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _plain_words((t or "").encode())
                texts = [b" ".join(words[k : k + PIECE_WORDS + WINDOW - 1]) for k in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS)]
                if words:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(texts), pa.string()), "piece": pa.array(texts, pa.binary())})

    return benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("piece")).mapInArrow(run, "item string, piece binary")


def _searched(rows: DataFrame, search, kind: str) -> DataFrame:
    """rows (row_id, text, n_words, spans, items) with what this block's windows add."""
    import pyarrow as pa

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Search = search.value
        for batch in batches:
            raw, at = shared.utf8(batch.column(1))
            counts, spans, items = own.rows(raw, at, batch.column(3).to_pylist())
            items = [sorted(new.union(old or ())) for new, old in zip(items, batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))], names=["row_id", "text", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"row_id {kind}, text string, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """row_id, n_words, spans (runs of words inside occurrences: start, stop), items (ids as strings, sorted) of each row of docs.

    Null and empty texts, and those of separators alone, have no words, spans or items; very long ones are searched whole;
    repeated rows repeat. Items without words have no windows; equal windows of several items name all of them; items
    that share an id count once; items whose id is null share the empty id. Either table may be empty. Other columns are
    ignored, whatever they are called.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    pieces = shared.cut(_pieces(benchmark, item_id, item_text).distinct(), "benchmark")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    kind = docs.schema[row_id].dataType.simpleString()
    none = [F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items")]
    rows = docs.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{text}`").alias("text"), *none)
    for b in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == b).toArrow()
        search = Search(list(zip(own["item"].to_pylist(), own["piece"].to_pylist(), strict=True)))
        rows = _searched(rows, spark.sparkContext.broadcast(search), kind)
        if (b + 1) % BLOCKS_A_PASS == 0 and b + 1 < blocks:
            rows = shared.cut(rows, "searched")
    shared.forget(pieces)
    return rows.select(F.col("row_id").alias(row_id), "n_words", "spans", "items")


def remove(docs: DataFrame, found_text: str, spans: str = "spans") -> DataFrame:
    """docs with the words in spans taken out of the text; what separates the other words stays as it is.

    docs has the text and its spans in one row; null texts and null or empty spans change nothing.
    """
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    @F.pandas_udf("string")
    def without(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, runs, strict=True):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            bounds, kept, at = [m.span() for m in word.finditer(t)], [], 0
            for run in own:
                kept.append(t[at : bounds[run["start"]][0]])
                at = bounds[run["stop"] - 1][1]
            out.append("".join(kept) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(found_text, without(F.col(f"`{found_text}`"), F.col(f"`{spans}`")))
