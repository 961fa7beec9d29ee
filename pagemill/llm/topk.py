"""Exact top-k by inner product as a Voronoi join.

Data and queries are put in the cells of their nearest pivots, and cells of queries in groups. From summaries of the
cells (radius of the queries, the least k-th score that they are sure to reach, radius of the data) and a vector's
distance to its pivot follows an upper bound of its score with any query of a group; a vector goes only to the groups
that its bound can still matter to, and a query only to the cells that can still hold one of its k best. Each pair
of (part of a group, bundle of cells) is solved on its own, and the partial lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, vectors

#: Pivots, at least and at most; rows that give the first bounds; most groups of query cells.
LEAST_PIVOTS, MOST_PIVOTS, SEEDS, MOST_GROUPS = 16, 1_024, 4_096, 64
#: Queries and vectors in one local task, about, and scores worked out at once.
TASK_QUERIES, TASK_VECTORS, SCORES = 2_048, 8_192, 1 << 21
#: Beyond LEAST_GROUPS a group has so many queries at least, as every group can need a copy of the data.
LEAST_GROUPS, GROUP_QUERIES = 4, 2_048


def _centres(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many different centres of x: some rounds of k-means, from rows that lie far from each other."""
    first, far = [0], np.full(len(x), np.inf)
    for _ in range(most - 1):
        far = np.minimum(far, ((x - x[first[-1]]) ** 2).sum(1))
        if not far.max() > 0:
            break
        first.append(int(far.argmax()))
    at = x[first]
    for _ in range(6):
        of = vectors.nearest(x, at)[0]
        order = np.argsort(of, kind="stable")
        used, start = np.unique(of[order], return_index=True)
        at = np.add.reduceat(x[order], start, axis=0) / np.diff(np.append(start, len(x)))[:, None]
    return at


def search(rows: DataFrame, every: int, k: int, scale: float = 256.0, row_id: str = "vec_id", column: str = "embedding", report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), row_id and score: the k best of every other vector for each query, exactly.

    Components become floor(scale * x); scores are integer inner products, ties go to the smaller id. Queries are the
    rows whose id is divisible by every. Rows with a null id, or a vector that is null, empty or has a null or
    non-finite component, take no part. Ids are keys: a repeated id is one query, never answers itself, and is
    returned once, with its highest score. A shorter vector counts as followed by zeros. Scores have to fit a long.
    Fewer than k other vectors give fewer rows; an empty table gives none. report receives the numbers of pivots and
    groups, and the share of all pairs that is scored (which takes a job of its own).
    """
    import pyarrow as pa

    spark = rows.sparkSession

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors.dense(batch.column(1))
            q = np.floor(x * scale)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(at)).cast(pa.int64()), "q": pa.array([v.astype("<i8").tobytes() for v in q], pa.binary())})

    source = rows.where(F.col(row_id).isNotNull() & F.col(column).isNotNull()).select(row_id, column)
    q = shared.cut(source.mapInArrow(quantise, "id bigint, q binary"), "topk")
    facts = q.agg(F.count("*"), F.max(F.length("q")), F.count(F.when(F.col("id") % every == 0, 1))).first()
    n, width, asked = facts[0], (facts[1] or 0) // 8, facts[2]
    result = f"query_id bigint, rank int, `{row_id}` bigint, score bigint"
    if not n or not asked:
        return spark.createDataFrame([], result)
    wide = lambda data: vectors.wide(data, width, "<i8")
    seeds = q.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(SEEDS).collect()  # bounded by SEEDS
    seed_ids, seed = np.array([s[0] for s in seeds]), wide([s[1] for s in seeds])
    # An id counts once among the seeds: two rows of it are one answer.
    once = np.sort(np.unique(seed_ids, return_index=True)[1])
    seed_ids, seed = seed_ids[once], seed[once]
    pivots = _centres(seed, int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n**0.5))))
    group_of = vectors.nearest(pivots, _centres(pivots, int(min(MOST_GROUPS, max(LEAST_GROUPS, asked // GROUP_QUERIES)))))[0]
    groups, cells, long_ = int(group_of.max()) + 1, len(pivots), np.linalg.norm(pivots, axis=1)

    def floor_of(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The k-th score that each query is sure to reach, as the seeds alone give it."""
        s = np.where(seed_ids[None, :] == ids[:, None], -np.inf, x @ seed.T)
        return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(x), -np.inf)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), wide(batch.column(1).to_pylist())
            cell, d = vectors.nearest(x, pivots)
            ask = ids % every == 0
            floor = np.full(len(x), np.nan)
            floor[ask] = floor_of(ids[ask], x[ask])
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "d": d, "ask": ask, "floor": floor})

    asks = F.when(F.col("ask"), 1)
    facts = q.mapInArrow(summarise, "cell int, d double, ask boolean, floor double").groupBy("cell").agg(F.count("*"), F.max("d"), F.count(asks), F.max(F.when(F.col("ask"), F.col("d"))), F.min(F.when(F.col("ask"), F.col("floor")))).collect()  # a row for each cell
    counts, radius, queries = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells, np.int64)
    # The least distance from its pivot at which a vector of a cell can matter to a group.
    least = np.full((groups, cells), np.inf)
    for c, m, r, own, reach, floor in facts:
        counts[c], radius[c], queries[c] = m, r, own
        if own:
            # score <= p.p' + |p| d + r |p'| + r d, for the queries' pivot p and radius r, and distance d from pivot p'
            need = (floor - pivots[c] @ pivots.T - reach * long_) / max(long_[c] + reach, 1e-9)
            need = need - 1e-9 * np.abs(need) - 1e-6 if np.isfinite(floor) else np.full(cells, -np.inf)
            least[group_of[c]] = np.minimum(least[group_of[c]], need)
    asked_of = np.bincount(group_of, queries, minlength=groups).astype(np.int64)
    parts = -(-asked_of // TASK_QUERIES)
    # Cells of one group are neighbours; neighbours share a bundle up to a task's size, and a larger cell is dealt to several tasks.
    bundle, dealt, held = np.zeros(cells, np.int64), [1], 0
    for c in np.argsort(group_of, kind="stable"):
        if held and held + counts[c] > TASK_VECTORS:
            dealt.append(1)
            held = 0
        bundle[c], held = len(dealt) - 1, held + counts[c]
        dealt[-1] = max(1, -(-held // TASK_VECTORS))
    dealt = np.array(dealt)

    def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
        return (shared.mix(ids.astype(np.uint64) + np.uint64(salt)) >> np.uint64(1)).astype(np.int64)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), wide(batch.column(1).to_pylist())
            cell, d = vectors.nearest(x, pivots)
            slice_ = mixed(ids, 1) % dealt[bundle[cell]]
            for g in np.flatnonzero(parts):
                need = np.flatnonzero(d >= least[g, cell])
                for part in range(parts[g]):
                    own = {"g": np.full(len(need), g), "part": np.full(len(need), part), "bundle": bundle[cell[need]], "slice": slice_[need]}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32()) for c, v in own.items()} | {"id": batch.column(0).take(pa.array(need)), "q": batch.column(1).take(pa.array(need))})

    def may(x: np.ndarray, floor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a cell can hold one of a query's k best."""
        bound = x @ pivots[at].T + np.linalg.norm(x, axis=1)[:, None] * radius[at]
        return (bound + 1e-9 * np.abs(bound) + 1e-6 >= floor[:, None]) & (counts[at] > 0)

    every_cell = np.arange(cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), wide(batch.column(1).to_pylist())
            g = group_of[vectors.nearest(x, pivots)[0]]
            part, floor = mixed(ids, 2) % np.maximum(parts[g], 1), floor_of(ids, x)
            asked_cells = may(x, floor, every_cell)
            for b in range(len(dealt)):
                to = np.flatnonzero(asked_cells[:, bundle == b].any(axis=1))
                for s in range(dealt[b] if len(to) else 0):
                    own = {"g2": g[to], "part2": part[to], "bundle2": np.full(len(to), b), "slice2": np.full(len(to), s)}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32()) for c, v in own.items()} | {"query_id": batch.column(0).take(pa.array(to)), "v": batch.column(1).take(pa.array(to)), "floor": floor[to]})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), wide(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"n": pa.array([int((may(x, floor_of(ids, x), every_cell) @ counts).sum())], pa.int64())})

    def solve(one, two):
        import pandas as pd

        empty = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        if not len(one) or not len(two):
            return empty
        one, two = one.sort_values("id", kind="stable"), two.sort_values("query_id").drop_duplicates(["query_id"])
        x, y, ids, of, floor = wide(list(one["q"])), wide(list(two["v"])), one["id"].to_numpy(), two["query_id"].to_numpy(), two["floor"].to_numpy()
        at, home = np.unique(vectors.nearest(x, pivots)[0], return_inverse=True)
        columns = [np.flatnonzero(home == c) for c in range(len(at))]
        xs, ys = x, y
        # Doubles hold these sums exactly up to 2 ** 53; beyond, whole numbers are multiplied.
        if np.abs(x).max() * np.abs(y).max() * width >= 2**53:
            xs, ys = (vectors.wide(list(c), width, "<i8", np.int64) for c in (one["q"], two["v"]))
        # Rows that repeat an id can take up to so many places more.
        most = min(len(ids), k + int(pd.Series(ids).duplicated().sum()))
        out = []
        step = max(1, SCORES // len(ids))
        for a in range(0, len(of), step):
            asked_cells, own = may(y[a : a + step], floor[a : a + step], at), of[a : a + step]
            s = np.full((len(own), len(ids)), np.iinfo(np.int64).min + 1)
            for c, there in enumerate(columns):
                to = np.flatnonzero(asked_cells[:, c])
                s[np.ix_(to, there)] = (ys[a + to] @ xs[there].T).astype(np.int64)
            s[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min + 1
            top = vectors.best(s, most)
            score = np.take_along_axis(s, top, 1).ravel()
            found = pd.DataFrame({"query_id": np.repeat(own, top.shape[1]), "id": ids[top].ravel(), "score": score})[score > np.iinfo(np.int64).min + 1]
            out.append(found.drop_duplicates(["query_id", "id"]))
        return pd.concat(out, ignore_index=True).astype("int64")

    data = q.mapInArrow(replicate, "g int, part int, bundle int, slice int, id bigint, q binary")
    ask = q.where(F.col("id") % every == 0).mapInArrow(route, "g2 int, part2 int, bundle2 int, slice2 int, query_id bigint, v binary, floor double")
    if report is not None:
        pairs = q.where(F.col("id") % every == 0).mapInArrow(compared, "n bigint").agg(F.sum("n")).first()[0]
        report |= {"pivots": cells, "groups": groups, "share": pairs / n / asked}
    local = data.groupBy("g", "part", "bundle", "slice").cogroup(ask.groupBy("g2", "part2", "bundle2", "slice2")).applyInPandas(solve, "query_id bigint, id bigint, score bigint")
    # Rows of one id can lie in different cells: it is returned once, with its highest score.
    local = local.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(row_id), "score")
