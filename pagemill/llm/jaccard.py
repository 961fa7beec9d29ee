"""Exact Jaccard join of documents on word shingles by a grouped prefix join.

1. Counts how many documents hold each shingle and keeps, in a table of fixed size, the rounded-up rarity level of
   the shingles that share a slot. Any order is right for a prefix filter; this one puts frequent shingles last.
2. A document's set, in that order, has a prefix that it must share with every document it links with. Documents
   with equal sets are one node; nodes with equal prefix and size are one group, and only groups are joined.
3. Groups that share a prefix shingle are filtered by size and position. A short list of groups gives all its
   pairs; a long one first gives pairs with its most central group only, and the lists of very frequent shingles are
   never gathered in one place. Pairs are verified on whole sets.
4. After connected components are known, what long lists and groups of several nodes leave over (pairs in
   different components) is compared in blocks and verified. Pairs inside a component cannot change the components.
5. Every link lies inside a component. So that all are counted, all pairs of a component of more than two nodes are
   compared, in blocks; only each node's number of links leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORDS, PERCENT = 5, 80
#: Lists of at most so many groups give all their pairs at once.
SHORT = 16
#: Of longer lists, what lies in different components is compared in blocks of at least and at most so many entries.
BLOCK, MOST_BLOCK = 256, 4096
#: Ratio of sizes of a band: more than two linked sets can have (100 / PERCENT).
BAND = 1.26
#: Shingles held by a task before it passes them on; most slots of the level table (bytes of memory); partners in a verifying task.
FLUSH, MOST_BITS, PARTNERS = 3_000_000, 26, 48
#: Text in a bucket of shingles, and most buckets (at 100 TB a bucket stands for 0.4 GB of text); level from which on a shingle's list is dealt to slices.
BUCKET_BYTES, MOST_BUCKETS, HOT_LEVEL = 24 << 20, 18, 12
#: The highest level that a slot has: shingles of a higher one are kept by their hash, so many of the most frequent at most.
SLOT_LEVEL, MOST_FREQUENT = 11, 1 << 22
#: Bits of the filter of needed rows: at least, at most (32 MB), and for each of them.
LEAST_FILTER, MOST_FILTER, FILTER_EACH = 16, 28, 16
#: Shingles in a block of a component, about.
BLOCK_SHINGLES = 1 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_K = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(column) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than a shingle has, one for all of them."""
    words, at = shared.word_hashes(*shared.utf8(column))
    n = len(words) - WORDS + 1
    every = shared.mix(sum((words[j : j + n] * _C[j] for j in range(WORDS)), np.zeros(n, np.uint64))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for i in range(len(at) - 1):
        lo, m = int(at[i]), int(at[i + 1] - at[i])
        if m >= WORDS:
            out.append(np.unique(every[lo : lo + m - WORDS + 1]))
        elif m:
            whole = sum((words[lo + j : lo + j + 1] * _C[j] for j in range(m)), np.full(1, m, np.uint64) * _K[0])
            out.append(shared.mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(h: np.ndarray) -> tuple[int, int]:
    a, b = shared.mix(h ^ _K[1]).sum(dtype=np.uint64), shared.mix(h ^ _K[2]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def prefix_size(n):
    return n - (PERCENT * n + 99) // 100 + 1


def index_size(n):
    """Shingles at the front by which the smaller set of a pair is found."""
    return n - (2 * PERCENT * n + 99 + PERCENT) // (100 + PERCENT) + 1


def overlap_needed(a, b):
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


class Levels:
    """Rarity levels of shingles: those of frequent ones by their hash, those of the others by slot."""

    def __init__(self, table: np.ndarray, bits: int, keep: int, hashes: np.ndarray, levels: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.table, self.shift, self.keep, self.top, self.hashes, self.levels = table, np.uint64(64 - bits), np.uint64(64 - keep), SLOT_LEVEL, hashes[order], levels[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        level = self.table[(h >> self.shift).astype(np.int64)]
        if len(self.hashes):
            # Only slots of the highest level can have a frequent shingle.
            at = np.flatnonzero(level >= self.top)
            own = h[at] >> self.keep
            place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            there = self.hashes[place] == own
            level[at[there]] = self.levels[place[there]]
        return level


def prefix(h: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix hashes, their levels, and the group key of (prefix, size)."""
    level = levels.of(h)
    order = np.argsort(level, kind="stable")[: prefix_size(len(h))]
    own = h[order]
    key = shared.mix(shared.mix(own ^ _K[3]).sum(dtype=np.uint64, keepdims=True) + np.array([len(h)], np.uint64) * _K[0])
    return own, level[order], int(key.view(np.int64)[0])


# ---------------------------------------------------------------- packed lists of sorted numbers


def _pack(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as fixed-width differences; the first byte is the width."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, count: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, : data[0]] = np.frombuffer(data, np.uint8, count * data[0], 1).reshape(count, data[0])
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _narrow(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view("<u8").ravel()


def _levels(docs: DataFrame, text: str, buckets: int, bits: int, size: int) -> Levels:
    """The level of each shingle: the whole part of log2 of the count of documents that hold it.

    The table of slots (the first bits of a hash) has, of the shingles in a slot, the highest level, or SLOT_LEVEL if that is less. The
    shingles above are listed; of very many only those above a level that leaves MOST_FREQUENT of them. Where a slot
    stands for many shingles the rarer ones lose their order, and lists stay as short as those of SLOT_LEVEL all the same.
    """
    import pyarrow as pa

    # Counts go by the first bits of a hash, more of them for more text, so that few shingles meet in one.
    keep = min(56, max(40, int(size / 6).bit_length() + 8))
    low = 64 - keep
    step = buckets.bit_length() - 1

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        # A shingle is sent once with its count, however many documents here hold it.
        h, times = np.unique(np.concatenate(found) >> np.uint64(low), return_counts=True)
        cuts = [0, *np.searchsorted(h, np.arange(1, buckets, dtype=np.uint64) << np.uint64(keep - step)).tolist(), len(h)]
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        wide = (max(1, int(times.max())).bit_length() + 7) // 8
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array([k for k, _, _ in parts], pa.int32()), "n": pa.array([b - a for _, a, b in parts], pa.int32()), "packed": pa.array([_pack(h[a:b]) for _, a, b in parts], pa.binary())}
            | {"times": pa.array([_narrow(times[a:b].astype(np.uint64), wide) for _, a, b in parts], pa.binary())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for h in shingle_sets(batch.column(0)):
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    own_bits = bits - step

    def count(key, frame):
        import pandas as pd

        h = np.concatenate([_unpack(p, n) for n, p in zip(frame["n"], frame["packed"], strict=True)])
        times = np.concatenate([_widen(t, len(t) // n) for n, t in zip(frame["n"], frame["times"], strict=True)])
        order = np.argsort(h, kind="stable")
        h, times = h[order], times[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.add.reduceat(times, at)
        out = np.zeros(1 << own_bits, np.uint8)
        slot = ((h[at] >> np.uint64(keep - bits)) & np.uint64((1 << own_bits) - 1)).astype(np.int64)
        level = np.minimum(255, np.floor(np.log2(times))).astype(np.uint8)
        np.maximum.at(out, slot, np.minimum(level, SLOT_LEVEL))
        above = np.flatnonzero(level > SLOT_LEVEL)
        return pd.DataFrame({"bucket": [key[0]], "part": [out.tobytes()], "hashes": [h[at][above].astype(np.int64)], "levels": [level[above].astype(np.int32)]})

    packed = docs.select(text).mapInArrow(run, "bucket int, n int, packed binary, times binary")
    table = np.zeros((buckets, 1 << own_bits), np.uint8)
    counted = shared.cut(packed.groupBy("bucket").applyInPandas(count, "bucket int, part binary, hashes array<bigint>, levels array<int>"), "counted")
    # The table has a fixed size; only its parts come to the driver.
    for k, part in counted.select("bucket", "part").toLocalIterator():
        table[k] = np.frombuffer(part, np.uint8)
    frequent = counted.select(F.explode(F.arrays_zip("hashes", "levels")).alias("x")).select("x.hashes", "x.levels")
    least, n = 256, 0
    for level, m in sorted(frequent.groupBy("levels").count().collect(), reverse=True):  # a row for each level
        if n + m > MOST_FREQUENT:
            break
        least, n = level, n + m
    own = frequent.where(F.col("levels") >= least).toArrow()
    shared.forget(counted)
    return Levels(table.ravel(), bits, keep, own["hashes"].to_numpy().astype(np.uint64), own["levels"].to_numpy().astype(np.uint8))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of links (a, b), by minimum labels with pointer jumping."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = shared.cut(both, "edges")
    labels = shared.cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    held = labels
    while True:
        heard = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        new = labels.join(heard, labels.node == heard.a, "left").select("node", F.least("component", F.coalesce("heard", "component")).alias("next"), "component")
        jump = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = new.join(jump, F.col("next") == F.col("n2"), "left").select("node", F.least("next", F.coalesce("c2", "next")).alias("next"), F.col("component").alias("old"))
        new = shared.cut(new, "labels")
        moved = new.where("next <> old").limit(1).count()
        shared.forget(held)
        held, labels = new, new.select("node", F.col("next").alias("component"))
        if not moved:
            shared.forget(edges)
            return labels


def _apart(rows: DataFrame, same: DataFrame) -> DataFrame:
    """rows (node, check) with numbers of their own for nodes whose checks differ; same (node, least) are a few by chance."""
    met = rows.join(F.broadcast(same.select("node", "least")), "node", "left")
    return met.withColumn("node", F.when(F.col("check") != F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))).select(*rows.columns)


def _sets(docs: DataFrame, needed: DataFrame, row_id: str, text: str, same: DataFrame | None) -> DataFrame:
    """node and hashes (its set, packed) of the needed nodes (node, least_id)."""
    import pyarrow as pa

    spark = docs.sparkSession
    # A bitmap says which rows can be needed, so that only their sets are moved; its size is bounded.
    needed = shared.cut(needed, "needed")
    bits = min(MOST_FILTER, max(LEAST_FILTER, (needed.count() * FILTER_EACH).bit_length()))
    width = 1 << 16
    slot = F.pmod(F.xxhash64(F.col("least_id")), F.lit(1 << bits)).cast("int")
    slots = needed.select(slot.alias("slot")).distinct().withColumn("part", F.floor(F.col("slot") / width).cast("int"))

    def bitmap(key, frame):
        import pandas as pd

        bits = np.zeros(width, np.uint8)
        bits[frame["slot"].to_numpy() % width] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    there = np.zeros(((1 << bits) // width, width // 8), np.uint8)
    for k, b in slots.groupBy("part").applyInPandas(bitmap, "part int, bits binary").toLocalIterator():
        there[k] = np.frombuffer(b, np.uint8)
    sent = spark.sparkContext.broadcast(there.ravel())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(1).to_numpy(zero_copy_only=False)
            pick = batch.column(0).filter(pa.array((sent.value[s >> 3] >> (7 - (s & 7)) & 1).astype(bool)))
            found = [h for h in shingle_sets(pick) if len(h)]
            keys = [set_key(h) for h in found]
            yield pa.RecordBatch.from_pydict({"node": pa.array([k[0] for k in keys], pa.int64()), "check": pa.array([k[1] for k in keys], pa.int64()), "hashes": pa.array([_narrow(h, 8) for h in found], pa.binary())})

    slot = F.pmod(F.xxhash64(F.col(row_id).cast("long")), F.lit(1 << bits)).cast("int")
    own = docs.where(F.col(row_id).isNotNull()).select(text, slot.alias("slot")).mapInArrow(sets, "node bigint, check bigint, hashes binary")
    own = (own if same is None else _apart(own, same)).drop("check")
    return shared.cut(own.join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, row_id: str, text: str, same: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    # The end with more pairs is a: its set goes to as many tasks as its pairs fill, while that of b goes along with each of them.
    ends = shared.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    degree = ends.select(F.col("a").alias("end")).union(ends.select("b")).groupBy("end").agg(F.count("*").alias("pairs"))
    known = ends.join(degree.toDF("a", "pairs_a"), "a").join(degree.toDF("b", "pairs_b"), "b")
    turned = F.col("pairs_b") > F.col("pairs_a")
    pairs = shared.cut(known.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")), "pairs")
    shared.forget(ends)
    sized = pairs.join(nodes.select(F.col("node").alias("b"), "n"), "b")
    slices = shared.cut(sized.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / PARTNERS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("slices")), "slices")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "least_id"), "node")
    own = _sets(docs, needed, row_id, text, same)
    left = slices.join(own.toDF("a", "hashes"), "a").select(F.col("a").alias("one"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice1"), "hashes")
    right = pairs.join(slices, "a").select(F.col("a").alias("many"), "b", F.pmod(F.hash("b"), F.col("slices")).alias("slice2"))
    right = right.join(own.toDF("b", "hashes"), "b").select("many", "slice2", "b", "hashes")

    def check(key, one, many):
        import pandas as pd

        good = []
        if len(one):
            x = _widen(one["hashes"].iloc[0], 8)
            for b, data in zip(many["b"], many["hashes"], strict=True):
                y = _widen(data, 8)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if 100 * len(small) >= PERCENT * len(large):
                    at = np.searchsorted(large, small)
                    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                    if 100 * both >= PERCENT * (len(x) + len(y) - both):
                        good.append(b)
        return pd.DataFrame({"a": [key[0]] * len(good), "b": good})

    return shared.cut(left.groupBy("one", "slice1").cogroup(right.groupBy("many", "slice2")).applyInPandas(check, "a bigint, b bigint"), "links")


def _all_links(docs: DataFrame, comps: DataFrame, nodes: DataFrame, row_id: str, text: str, same: DataFrame | None) -> DataFrame:
    """node and n_links (how many other nodes it links with) of every node of comps.

    The two nodes of a pair have one link. A larger component is cut into blocks and each pair of blocks is a group of
    its own, which compares all its pairs that pass the size filter; no group holds a whole component.
    """
    inside = shared.cut(comps.join(nodes.select("node", "n", "least_id"), "node"), "inside")
    sizes = inside.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.col("members") / 16)))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    inside = shared.cut(inside.join(shared.cut(sizes.select("component", "members", blocks.alias("blocks")), "sizes"), "component"), "inside")
    more = inside.where("members > 2")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = more.join(_sets(docs, more.select("node", "least_id"), row_id, text, same), "node").select("component", "node", "hashes", own.alias("own"), other.alias("other"))
    dealt = dealt.select("component", "node", "hashes", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))

    def count(key, frame):
        import pandas as pd

        sets = [_widen(d, 8) for d in frame["hashes"]]
        n = np.array([len(x) for x in sets])
        order = np.argsort(n, kind="stable")
        n, sets, home = n[order], [sets[i] for i in order], frame["own"].to_numpy()[order]
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(n)])
        there, times = np.zeros(int(ids.max()) + 1, np.int32), np.zeros(len(n), np.int64)
        for i in range(len(n) - 1):
            # Rising sizes: beyond this row no set is small enough to link with this one.
            end = int(np.searchsorted(PERCENT * n, 100 * n[i], "right"))
            if end > i + 1:
                there[ids[at[i] : at[i + 1]]] = 1
                both = np.add.reduceat(there[ids[at[i + 1] : at[end]]], at[i + 1 : end] - at[i + 1])
                there[ids[at[i] : at[i + 1]]] = 0
                good = (100 * both >= PERCENT * (n[i] + n[i + 1 : end] - both)) & ((home[i + 1 : end] != home[i]) | (key[1] == key[2]))
                times[i] += np.count_nonzero(good)
                times[i + 1 : end] += good
        return pd.DataFrame({"node": frame["node"].to_numpy()[order], "n_links": times})

    counted = dealt.groupBy("component", "one", "two").applyInPandas(count, "node bigint, n_links bigint")
    counted = counted.union(inside.where("members = 2").select("node", F.lit(1).cast("long").alias("n_links")))
    return counted.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _close(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Size and position filters on a shared shingle; n: sizes, p: its places in the two prefixes."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    place = np.where((n1 < n2) | ((n1 == n2) & (p1 <= p2)), p1, p2)
    return (100 * small >= PERCENT * large) & (place < index_size(small)) & (np.minimum(n1 - p1, n2 - p2) >= overlap_needed(n1, n2))


def join(docs: DataFrame, row_id: str = "doc_id", text: str = "text", links_too: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """row_id, n_shingles, component_id (smallest row_id reachable by links, its own included) and n_links of every row.

    n_links is the number of other sets that the row's set links with; it is left out where links_too is not set.
    The columns in also come after them, with component: a number of the component that no other has, though their
    rows may share ids (null for rows without shingles and for those with null ids that have no component).
    Null, empty and blank texts have no shingles and link with nothing. Rows with equal sets are one node, so
    copies cost nothing. Repeated ids are rows of their own. A row with a null id has no component unless a row
    with an id has the same set. row_id has to be an integer. Very long texts are read whole; ties do not matter, as a
    component is the same whatever pairs connect it. Other columns are ignored; empty tables give empty results.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    shared.prepare(spark)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    more = [f"__also_{c}" for c in also]
    docs = docs.select(F.col(f"`{row_id}`"), F.col(f"`{text}`"), *[F.col(f"`{c}`").alias(m) for c, m in zip(also, more, strict=True)])
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(MOST_BITS, max(16, int(size / 48).bit_length()))
    buckets = 1 << max(8, min(MOST_BUCKETS, int(size / BUCKET_BYTES).bit_length()))
    hot_slices = max(16, buckets >> 4)
    levels = spark.sparkContext.broadcast(_levels(docs, text, buckets, bits, size))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(1))
            keys = [(*set_key(h), prefix(h, levels.value)[2]) if len(h) else (None, None, None) for h in found]
            own = {name: pa.array([k[i] for k in keys], pa.int64()) for i, name in enumerate(("node", "check", "group"))}
            yield pa.RecordBatch.from_pydict({row_id: batch.column(0), "n": pa.array([len(h) for h in found], pa.int64())} | own | {m: batch.column(2 + i) for i, m in enumerate(more)})

    kind = docs.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, n bigint, node bigint, check bigint, group bigint" + "".join(f", `{m}` {kinds[c]}" for c, m in zip(also, more, strict=True))
    all_rows = shared.cut(docs.mapInArrow(rows, schema), "rows")
    # Two sets that share the first half of their key are told apart by the second: that with the least keeps the number.
    same = all_rows.where("n > 0").groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least <> most")
    same = shared.cut(same, "same") if same.limit(1).count() else None
    if same is not None:
        all_rows = shared.cut(_apart(all_rows, same), "rows")
    nodes = all_rows.where("n > 0").groupBy("node").agg(F.min(row_id).cast("long").alias("least_id"), F.first("n").alias("n"), F.first("group").alias("group"), F.count("*").alias("copies"))
    nodes = shared.cut(nodes.where("least_id IS NOT NULL"), "nodes")
    groups = shared.cut(nodes.groupBy("group").agg(F.min("node").alias("lead"), F.count("*").alias("members")), "groups")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        table = levels.value

        def sent() -> pa.RecordBatch:
            h, g, n, p, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            # Lists of very frequent shingles are dealt to slices by their groups.
            bucket = (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
            slice_ = np.where(hot, 1 + (shared.mix(g.view(np.uint64)) % np.uint64(hot_slices)).astype(np.int64), 0)
            order = np.lexsort((h, slice_, bucket))
            h, g, n, p, bucket, slice_ = h[order], g[order], n[order], p[order], bucket[order], slice_[order]
            cuts = [*np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(slice_, prepend=-1) != 0)).tolist(), len(h)]
            parts = [(0, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_pydict(
                {"bucket": pa.array([bucket[a] for _, a, _ in parts], pa.int32()), "slice": pa.array([slice_[a] for _, a, _ in parts], pa.int32()), "count": pa.array([b - a for _, a, b in parts], pa.int32())}
                | {"h": pa.array([_pack(h[a:b]) for _, a, b in parts], pa.binary()), "g": pa.array([g[a:b].tobytes() for _, a, b in parts], pa.binary())}
                | {"n": pa.array([_narrow(n[a:b], 4) for _, a, b in parts], pa.binary()), "p": pa.array([_narrow(p[a:b], 4) for _, a, b in parts], pa.binary())}
            )

        for batch in batches:
            for h in shingle_sets(batch.column(0)):
                if len(h):
                    own, level, key = prefix(h, table)
                    p = np.flatnonzero(level > 0)  # level 0: no other document has it
                    if len(p):
                        held.append((own[p], np.full(len(p), key, np.int64), np.full(len(p), len(h), np.uint64), p.astype(np.uint64), level[p] >= HOT_LEVEL))
                        count += len(p)
                        if count >= FLUSH // 3:
                            yield sent()
                            held, count = [], 0
        if count:
            yield sent()

    def lists(key, frame):
        import pandas as pd

        h = np.concatenate([_unpack(d, c) for d, c in zip(frame["h"], frame["count"], strict=True)])
        g = np.concatenate([np.frombuffer(d, np.int64) for d in frame["g"]])
        n, p = (np.concatenate([_widen(d, 4) for d in frame[c]]).astype(np.int64) for c in "np")
        order = np.lexsort((g, p, h))
        h, g, n, p = h[order], g[order], n[order], p[order]
        # One entry for each (shingle, group): equal prefixes have equal places, so repeats are neighbours.
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        h, g, n, p = h[new], g[new], n[new], p[new]
        if key[1]:  # a slice of the lists of very frequent shingles: their first pairs follow below
            return pd.DataFrame({"long": True, "hot": True, "a": h.view(np.int64), "b": g, "n": n, "p": p})
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(first, len(h)))
        start, run = np.repeat(first, length), np.repeat(length, length)
        a, b = [], []
        for d in range(1, SHORT):
            i = np.flatnonzero((run[:-d] > d) & (run[:-d] <= SHORT) & (start[:-d] == start[d:])) if len(h) > d else np.zeros(0, np.int64)
            i = i[_close(n[i], p[i], n[i + d], p[i + d])]
            a.append(np.minimum(g[i], g[i + d]))
            b.append(np.maximum(g[i], g[i + d]))
        # Long lists: pairs with the first entry, which has the fewest rarer shingles before this one.
        i = np.flatnonzero((run > SHORT) & (start != np.arange(len(h))))
        i = i[_close(n[start[i]], p[start[i]], n[i], p[i])]
        a.append(g[start[i]])
        b.append(g[i])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        long_ = np.flatnonzero(run > SHORT)
        out = pd.DataFrame({"long": False, "hot": False, "a": pairs[0], "b": pairs[1], "n": 0, "p": 0})
        more = pd.DataFrame({"long": True, "hot": False, "a": h[long_].view(np.int64), "b": g[long_], "n": n[long_], "p": p[long_]})
        return pd.concat([out, more], ignore_index=True) if len(more) else out

    packed = docs.select(text).mapInArrow(tokens, "bucket int, slice int, count int, h binary, g binary, n binary, p binary")
    found = shared.cut(packed.groupBy("bucket", "slice").applyInPandas(lists, "long boolean, hot boolean, a bigint, b bigint, n bigint, p bigint"), "lists")
    pairs = found.where("NOT long").select(F.col("a").alias("g1"), F.col("b").alias("g2"))
    pairs = shared.cut(pairs.union(_first_of_hot(found.where("hot"))).distinct(), "group-pairs")
    lead = groups.select(F.col("group"), F.col("lead"))
    first = pairs.join(lead.toDF("g1", "a"), "g1").join(lead.toDF("g2", "b"), "g2").select("a", "b")
    several = groups.where("members > 1")
    inside = nodes.join(several, "group").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = _verify(docs, first.union(inside), nodes, row_id, text, same)
    comps = components(links)

    where = shared.cut(nodes.select("node", "n", "group").join(comps, "node", "left").select("node", "n", "group", F.coalesce("component", "node").alias("component")), "where")
    rest = _left_over(found, pairs, where, several)
    if rest is not None:
        links = links.union(_verify(docs, rest, nodes, row_id, text, same))
        comps = components(links)
    ids = nodes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least_id")
    ids = shared.cut(ids, "ids")
    least = shared.cut(ids.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")), "least")
    degree = _all_links(docs, comps, nodes, row_id, text, same) if links_too else nodes.select("node", F.lit(0).alias("n_links"))
    final = shared.cut(shared.look_up(ids, least, "component", "members", ids.count()).join(degree, "node", "left").select("node", "component", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "final")
    # The rows of a text with very many copies are dealt to several tasks; the number of such texts is bounded.
    most = shared.frequent(all_rows.count())
    hot = shared.cut(nodes.where(F.col("copies") > most).select("node", F.ceil(F.col("copies") / most).cast("int").alias("slices")), "frequent")
    part = F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(f"`{row_id}`")), F.col("slices")).cast("int"))
    some = all_rows.where("n > 0").join(F.broadcast(hot), "node", "left").withColumn("part", part)
    each = final.join(F.broadcast(hot), "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    named = some.join(each.drop("slices"), ["node", "part"], "left")
    extra = [F.col(f"`{m}`").alias(c) for c, m in zip(also, more, strict=True)]
    out = [F.col(f"`{row_id}`"), F.col("n").alias("n_shingles"), F.col("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *extra, "component"]
    lone = [F.col(f"`{row_id}`"), F.col("n").alias("n_shingles"), F.col(f"`{row_id}`").cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"), *extra, F.lit(None).cast("long").alias("component")]
    shared.forget(found, groups, pairs, where)
    result = named.select(*out).unionByName(all_rows.where("n = 0").select(*lone))
    return result.drop(*["n_links"] * (not links_too), *["component"] * (not also))


def _first_of_hot(entries: DataFrame) -> DataFrame:
    """Group pairs (g1, g2) of each entry (a: shingle, b: group, n, p) with its list's most central entry, if they pass the filters."""
    lead = entries.groupBy("a").agg(F.min(F.struct("p", "b", "n")).alias("lead"))
    both = entries.join(lead, "a").where("b <> lead.b").withColumns({"n2": F.col("lead.n"), "p2": F.col("lead.p")})
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    place = F.when((F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("p") <= F.col("p2"))), F.col("p")).otherwise(F.col("p2"))
    index = small - F.floor((2 * PERCENT * small + 99 + PERCENT) / (100 + PERCENT)) + 1
    needed = F.floor((PERCENT * (F.col("n") + F.col("n2")) + 99 + PERCENT) / (100 + PERCENT))
    close = (100 * small >= PERCENT * large) & (place < index) & (F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= needed)
    return both.where(close).select(F.least("b", "lead.b").alias("g1"), F.greatest("b", "lead.b").alias("g2"))


def _across(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of entries of a list h that lie in different components and pass the filters, found in blocks.

    A list is cut into bands of sizes, each wider than the size filter, so that an entry meets only its own band and the
    next one; a band is cut into blocks, and each pair of blocks is a group of its own. No group holds a whole list.
    """
    # Written out, so that the join below has fresh sides and the rows of a long list can be split.
    entries = shared.cut(entries.withColumn("band", F.floor(F.log(F.col("n")) / math.log(BAND)).cast("int")), "entries")
    bands = entries.groupBy("h", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("own"))
    whole, near = Window.partitionBy("h"), Window.partitionBy("h").orderBy("band").rangeBetween(-1, 0)
    span = lambda w: (F.min("lo").over(w), F.max("hi").over(w), F.sum("own").over(w))
    (lo, hi, length), (near_lo, near_hi, near_length) = span(whole), span(near)
    # Longer bands have larger blocks, up to a fixed size: an entry goes to as many tasks as its band has blocks.
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(near_length / 16)))
    blocks = F.when(near_lo != near_hi, F.ceil(near_length / block).cast("int"))
    bands = bands.select("h", "band", (lo != hi).alias("mixed"), (length > BLOCK).alias("long"), blocks.alias("blocks")).where("mixed")
    following = F.max("blocks").over(Window.partitionBy("h").orderBy("band").rangeBetween(1, 1))
    bands = shared.cut(bands.select("h", "band", "long", "blocks", following.alias("following")), "bands")
    at = lambda band, home, blocks: F.struct(band.alias("band"), F.lit(home).alias("home"), blocks.alias("blocks"))
    places = F.when(F.col("long"), F.array(at(F.col("band"), True, F.col("blocks")), at(F.col("band") + 1, False, F.col("following"))))
    places = places.otherwise(F.array(at(F.lit(0), True, F.lit(1))))
    dealt = entries.join(bands, ["h", "band"]).select("h", "n", "p", "node", "component", F.explode(F.filter(places, lambda x: x.blocks.isNotNull())).alias("at"))
    own, other = F.pmod(F.xxhash64("node"), F.col("at.blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1))
    dealt = dealt.select("h", "at.band", "at.home", "n", "p", "node", "component", own.alias("own"), other.alias("other"))
    dealt = dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("other")

    def cross(key, frame):
        import pandas as pd

        f = frame.sort_values(["p", "node"], kind="stable")
        n, p, node, c, home, own = (f[x].to_numpy() for x in ("n", "p", "node", "component", "home", "own"))
        a, b = [], []
        for i in range(len(f) - 1):
            # Rising places: beyond this point no later entry can pass the position filter.
            end = int(np.searchsorted(p, p[i] + n[i], "right"))
            j = np.arange(i + 1, max(i + 1, end))
            j = j[(c[j] != c[i]) & (home[j] | home[i]) & ((own[j] != own[i]) | (key[2] == key[3]))]
            j = j[_close(np.full(len(j), n[i]), np.full(len(j), p[i]), n[j], p[j])]
            a.append(np.full(len(j), node[i]))
            b.append(node[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("h", "band", "one", "two").applyInPandas(cross, "a bigint, b bigint")


def _left_over(found: DataFrame, pairs: DataFrame, where: DataFrame, several: DataFrame) -> DataFrame | None:
    """Pairs of nodes in different components that long lists and groups of several nodes have not yet given."""
    rest = []
    long_ = found.where("long").select(F.col("a").alias("h"), F.col("b").alias("group"), "p")
    if long_.limit(1).count():
        rest.append(_across(long_.join(where, "group").select("h", "n", "p", "node", "component")))
    if several.limit(1).count():
        of_several = several.select("group")
        both = pairs.join(of_several.toDF("g1"), "g1", "left_semi").union(pairs.join(of_several.toDF("g2"), "g2", "left_semi")).union(of_several.select(F.col("group").alias("g1"), F.col("group").alias("g2"))).distinct()
        # Only groups whose nodes are not yet all in one component can give pairs.
        split = where.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        at = split.toDF("g1", "lo1", "hi1"), split.toDF("g2", "lo2", "hi2")
        both = both.join(at[0], "g1").join(at[1], "g2").where("lo1 <> hi1 OR lo2 <> hi2 OR lo1 <> lo2").select("g1", "g2")
        # The members of two groups are a list of their own, compared in blocks like any other.
        both = shared.cut(both.select(F.xxhash64("g1", "g2").alias("h"), "g1", "g2"), "both")
        members = both.select("h", F.explode(F.array_distinct(F.array("g1", "g2"))).alias("group")).join(where, "group")
        rest.append(_across(members.select("h", "n", F.lit(0).cast("long").alias("p"), "node", "component")))
    if not rest:
        return None
    out = shared.cut(rest[0] if len(rest) == 1 else rest[0].union(rest[1]), "rest")
    return out if out.limit(1).count() else None
