"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fit on a bounded sample and every row is put in a leaf. A query goes through the tree with a priority
queue, most promising node first, until it has enough leaves; how many are enough is found by widening the visits
until the recall on some queries, whose neighbours are known by brute force over all rows, is high enough. A node
promises the inner product with its centre and, as its rows spread around that, two standard deviations of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, vectors

#: Branches of a node; rows in a leaf, about, while there are no more leaves than MOST_LEAVES; most rows that the tree is fit on.
BRANCHES, LEAF_ROWS, MOST_LEAVES, SAMPLE = 8, 32, 8_192, 65_536
#: Vectors and queries in a local task, about; queries that go through the tree together.
TASK_VECTORS, TASK_QUERIES, TOGETHER = 4_096, 4_096, 64
#: Queries to calibrate with, and the mean recall that they have to reach.
CALIBRATION, RECALL = 256, 0.94
#: Candidates scored exactly at once, about.
SCORED = 1 << 15


class Tree:
    """Nodes are numbered from the root on; inner ones have children, leaves a number from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 11) -> None:
        self.rng, self.leaves = np.random.default_rng(seed), 0
        self.centres: list[np.ndarray] = []
        self.spread: list[float] = []
        self.below: list[list[int]] = []
        self.leaf: list[int] = []
        self._grow(sample, max(1, len(sample) // max(1, leaves)))
        self.centres, self.spread = np.stack(self.centres), np.array(self.spread)

    def _grow(self, x: np.ndarray, most: int) -> int:
        node = len(self.below)
        centre = x.mean(0)
        self.centres.append(centre)
        # Twice the standard deviation of a row's product with a direction, the rows spread alike in all directions.
        self.spread.append(2 * float(np.sqrt(((x - centre) ** 2).mean())))
        self.below.append([])
        self.leaf.append(-1)
        of = self._split(x) if len(x) > max(most, BRANCHES) else None
        if of is None:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.below[node] = [self._grow(x[of == j], most) for j in range(int(of.max()) + 1)]
        return node

    def _split(self, x: np.ndarray) -> np.ndarray | None:
        centres = x[self.rng.choice(len(x), BRANCHES, replace=False)]
        for _ in range(8):
            of = vectors.nearest(x, centres)[0]
            used = np.unique(of)
            if len(used) < 2:
                return None
            centres = np.stack([x[of == j].mean(0) for j in used])
        return np.unique(vectors.nearest(x, centres)[0], return_inverse=True)[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.below[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                of = vectors.nearest(x[rows], self.centres[self.below[node]])[0]
                todo.extend((child, rows[of == j]) for j, child in enumerate(self.below[node]))
        return out

    def visit(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first leaves of each query, best bin first."""
        out = []
        for first in range(0, len(queries), TOGETHER):
            y = queries[first : first + TOGETHER]
            promise = -(y @ self.centres.T + np.sqrt((y * y).sum(1))[:, None] * self.spread)
            for own in promise.tolist():
                found: list[int] = []
                queue = [(own[0], 0)]
                while queue and len(found) < most:
                    _, node = heapq.heappop(queue)
                    if self.below[node]:
                        for child in self.below[node]:
                            heapq.heappush(queue, (own[child], child))
                    else:
                        found.append(self.leaf[node])
                out.append(found)
        return out


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row sums of products: the same for equal vectors, wherever they stand."""
    return (x * y).sum(axis=1)


def _local(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, y: np.ndarray, k: int, s: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the vector, score) of each query's k best, ties to smaller ids.

    s: the inner products, minus infinity for pairs that do not count; all pairs count without it.
    """
    if s is None:
        s = y @ x.T
    s[asks[:, None] == ids[None, :]] = -np.inf
    # All candidates that can be among the k best: any number of vectors can share the score at the cut.
    live = np.isfinite(s)
    if k < len(ids):
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        size = np.sqrt((x * x).sum(axis=1).max(initial=0.0) * (y * y).sum(axis=1))
        live &= s >= (least - 4 * x.shape[1] * np.finfo(float).eps * size)[:, None]
    out, first = [], 0
    upto = np.cumsum(live.sum(axis=1))
    while first < len(asks):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + SCORED, "right")))
        who, at = np.nonzero(live[first:last])
        who += first
        score = _exact(x[at], y[who])
        order = np.lexsort((ids[at], -score, who))
        who, at, score = who[order], at[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append((who[keep], at[keep], score[keep]))
        first = last
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(none, *out))


def search(rows: DataFrame, every: int, k: int, row_id: str = "vec_id", column: str = "embedding", recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), row_id and score (double): the k nearest found for each query, nearest first.

    Nearness is the inner product of the original vectors; ties go to the smaller id. Queries are the rows whose id
    is divisible by every. Rows with a null id, or a vector that is null, empty, zero or has a null or non-finite
    component, take no part. Ids are keys, as in the exact search. All rows are indexed; tables of more than
    LEAF_ROWS * MOST_LEAVES rows have larger leaves. An empty table gives no rows; a vector shorter than others counts
    as followed by zeros; equal vectors lie in one leaf, which is dealt to several tasks if it is large.
    report receives the numbers of leaves and visits, and the share of the rows that a query is compared with.
    """
    import pyarrow as pa

    spark = rows.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors.dense(batch.column(1))
            live = (x != 0).any(axis=1) if len(x) else np.zeros(0, bool)
            at, x = at[live], x[live]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(at)).cast(pa.int64()), "v": pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())})

    source = rows.where(F.col(row_id).isNotNull() & F.col(column).isNotNull()).select(row_id, column)
    read_rows = source.mapInArrow(read, "id bigint, v binary")
    facts = read_rows.agg(F.count("*"), F.max(F.length("v")), F.count(F.when(F.col("id") % every == 0, 1))).first()
    n, width, asked = facts[0], (facts[1] or 0) // 8, facts[2]
    if not n or not asked:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{row_id}` bigint, score double")
    wide = lambda data: vectors.wide(data, width, "<f8")
    leaves = min(MOST_LEAVES, max(1, n // LEAF_ROWS))
    sample = read_rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(SAMPLE).collect()  # bounded by SAMPLE
    sample = wide([r[1] for r in sample])
    tree = Tree(sample, leaves)
    del sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(tree.assign(wide(batch.column(1).to_pylist())), pa.int32()), "id": batch.column(0), "v": batch.column(1)})

    indexed = shared.cut(read_rows.mapInArrow(index, "leaf int, id bigint, v binary"), "ann")
    ask = indexed.where(F.col("id") % every == 0)
    counts = np.zeros(tree.leaves, np.int64)
    for leaf, m in indexed.groupBy("leaf").count().collect():  # a row for each leaf; MOST_LEAVES bounds their number
        counts[leaf] = m
    known = ask.select("id", "v").orderBy(F.xxhash64(F.lit("calibrate"), "id"), "id").limit(CALIBRATION).collect()  # bounded
    asks, y = np.array([r[0] for r in known]), wide([r[1] for r in known])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, x, leaf = batch.column(1).to_numpy(), wide(batch.column(2).to_pylist()), batch.column(0).to_numpy()
            who, at, score = _local(ids, x, asks, y, k)
            new = np.stack([who, leaf[at], ids[at]]), score
            if held is not None:
                new = np.concatenate([held[0], new[0]], axis=1), np.concatenate([held[1], new[1]])
                o = np.lexsort((new[0][2], -new[1], new[0][0]))
                new = new[0][:, o], new[1][o]
                keep = np.arange(len(o)) - np.searchsorted(new[0][0], new[0][0]) < k
                new = new[0][:, keep], new[1][keep]
            held = new
        if held is not None:
            yield pa.RecordBatch.from_pydict({"who": pa.array(held[0][0], pa.int32()), "leaf": pa.array(held[0][1], pa.int32()), "id": pa.array(held[0][2], pa.int64()), "score": held[1]})

    best = Window.partitionBy("who").orderBy(F.col("score").desc(), "id")
    true = indexed.mapInArrow(brute, "who int, leaf int, id bigint, score double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    true = true.groupBy("who").agg(F.collect_list("leaf")).collect()  # CALIBRATION * k values at most
    # The place in the visiting order at which each true neighbour is met.
    orders = tree.visit(y, tree.leaves)
    met = []
    for w, at in true:
        place = np.zeros(tree.leaves, np.int64)
        place[orders[w]] = np.arange(tree.leaves)
        met.append(place[at])
    visits = 1
    while visits < tree.leaves and np.mean([(m < visits).mean() for m in met]) < recall:
        visits += 1
    if report is not None:
        report |= {"leaves": tree.leaves, "visits": visits, "share": float(np.mean([counts[o[:visits]].sum() for o in orders]) / n)}

    # Neighbouring leaves share a task up to its size; a larger leaf is dealt to several. A query's partial
    # results then follow the number of tasks that it visits, not that of leaves.
    bundle, parts, held = np.zeros(tree.leaves, np.int64), [1], 0
    for leaf, m in enumerate(counts):
        if held and held + m > TASK_VECTORS:
            parts.append(1)
            held = 0
        bundle[leaf] = len(parts) - 1
        held += m
        parts[-1] = max(1, -(-held // TASK_VECTORS))
    parts = np.array(parts)

    def routed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, bundle, leaves to visit there) of a batch of queries (id, v)."""
        for i, nodes in enumerate(tree.visit(wide(batch.column(1).to_pylist()), visits)):
            nodes = np.array(nodes, np.int32)
            own = bundle[nodes]
            for b in np.unique(own).tolist():
                yield i, b, nodes[own == b]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(parts), np.int64)
        for batch in batches:
            total += np.bincount([b for _, b, _ in routed(batch)], minlength=len(parts))
        yield pa.RecordBatch.from_pydict({"bundle": pa.array(np.arange(len(parts)), pa.int32()), "n": pa.array(total, pa.int64())})

    # Bundles that many queries visit are solved in several tasks, each with its share of the queries.
    blocks = np.ones(len(parts), np.int64)
    for b, m in ask.select("id", "v").mapInArrow(load, "bundle int, n bigint").groupBy("bundle").agg(F.sum("n")).collect():  # a row for each bundle
        blocks[b] = max(1, -(-m // TASK_QUERIES))

    def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
        return (shared.mix(ids.astype(np.uint64) + np.uint64(salt)) >> np.uint64(1)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = bundle[leaf]
            at = np.repeat(np.arange(len(ids)), blocks[own])
            block = np.arange(len(at)) - np.repeat(np.cumsum(blocks[own]) - blocks[own], blocks[own])
            key = {"bundle": own[at], "part": (mixed(ids, 1) % parts[own])[at], "block": block}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32()) for c, v in key.items()} | {c: batch.column(c).take(pa.array(at)) for c in ("leaf", "id", "v")})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = mixed(batch.column(0).to_numpy(), 2)
            key, at, lists = [], [], []
            for i, b, nodes in routed(batch):
                own = nodes.tobytes()
                for p in range(parts[b]):
                    key.append((b, p, block[i] % blocks[b]))
                    at.append(i)
                    lists.append(own)
            key, at = np.array(key, np.int32).reshape(-1, 3), pa.array(at, pa.int32())
            yield pa.RecordBatch.from_pydict({c: pa.array(key[:, j]) for j, c in enumerate(("bundle2", "part2", "block2"))} | {"query_id": batch.column(0).take(at), "y": batch.column(1).take(at), "leaves": pa.array(lists, pa.binary())})

    def solve(one, two):
        import pandas as pd

        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "ids": [], "scores": []})
        one, two = one.sort_values(["leaf", "id"], kind="stable").drop_duplicates(["id"]), two.drop_duplicates(["query_id"])
        ids, leaf, x = one["id"].to_numpy(), one["leaf"].to_numpy(), wide(list(one["v"]))
        edges = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
        out = []
        step = max(1, (1 << 21) // len(ids))
        for first in range(0, len(two), step):
            own = two.iloc[first : first + step]
            asks, y, nodes = own["query_id"].to_numpy(), wide(list(own["y"])), [np.frombuffer(d, np.int32) for d in own["leaves"]]
            who, to = np.repeat(np.arange(len(own)), [len(d) for d in nodes]), np.concatenate(nodes)
            order = np.argsort(to, kind="stable")
            who, to = who[order], to[order]
            s = np.full((len(own), len(ids)), -np.inf)
            # Only the leaves that a query visits are compared with it.
            for a, b in zip(edges, edges[1:]):
                rows_ = who[np.searchsorted(to, leaf[a]) : np.searchsorted(to, leaf[a], "right")]
                s[rows_, a:b] = y[rows_] @ x[a:b].T
            who, at, score = _local(ids, x, asks, y, k, s)
            cuts = np.searchsorted(who, np.arange(len(asks) + 1))
            out.append(pd.DataFrame({"query_id": asks, "ids": [ids[at[a:b]] for a, b in zip(cuts, cuts[1:])], "scores": [score[a:b] for a, b in zip(cuts, cuts[1:])]}))
        return pd.concat(out, ignore_index=True)

    data = indexed.mapInArrow(deal, "bundle int, part int, block int, leaf int, id bigint, v binary")
    asked_of = ask.select("id", "v").mapInArrow(route, "bundle2 int, part2 int, block2 int, query_id bigint, y binary, leaves binary")
    local = data.groupBy("bundle", "part", "block").cogroup(asked_of.groupBy("bundle2", "part2", "block2")).applyInPandas(solve, "query_id bigint, ids array<bigint>, scores array<double>")
    flat = local.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(row_id), "score")
