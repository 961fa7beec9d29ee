"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts are the unlabelled set. A text is a set of features: the words, pairs of
neighbouring words and beginnings of words that tell most about the positives. Linear classifiers minimise in numpy the risk
p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]) with the class prior p, each on a part of the unlabelled texts, and their
weights are averaged. The prior and the threshold come from positives that were held back from learning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: At most so many labelled positives are learnt from; one in FOLDS is held back for the prior and the threshold.
MOST_POSITIVE, FOLDS = 10_000, 5
#: Bits of a feature's hash; features that are looked at, and that the model has; different texts to a classifier, about.
BITS, MOST_CANDIDATES, FEATURES, CHUNK = 22, 1 << 17, 512, 50_000
#: What a feature has to tell (nats over all positives).
LEAST_TOLD = 9.0
#: The features with the strongest lift, each in at least so large a share of the positives, tell the prior.
PRIOR_FEATURES, PRIOR_SHARE = 20, 0.02
#: Words are runs of ASCII letters and of bytes above 127.
BREAKS = np.ones(256, bool)
BREAKS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Scores at or above this say toxic.
CUT = 0.7
#: Odds are counted in bins of this width, between these bounds.
BIN, MOST_ODDS = 1 / 64, 40.0
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word's beginnings: what words of one stem share, in languages that the labels tell little of.
BEGINNINGS = (4, 5, 6, 7)
#: Occurrences from which a feature is another one too: what any text has by chance, few have so often.
REPEATS = (2, 3)


def slots(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The hashed features of each text, sorted, each once: words, pairs of neighbours, beginnings of longer words, and each of
    these that occurs several times once more."""
    first, last = shared.word_bounds(raw, at, BREAKS)
    begun: list[np.ndarray] = []
    words, word_at = shared.bound_hashes(raw, first, last, begun, BEGINNINGS), np.searchsorted(first, at)
    out = []
    for i in range(len(at) - 1):
        own = words[word_at[i] : word_at[i + 1]]
        two = shared.mix(own[:-1] * _PAIR + own[1:]) if len(own) > 1 else own[:0]
        parts = [own, two]
        for b in begun:
            mine = b[word_at[i] : word_at[i + 1]]
            parts.append(mine[mine != 0])
        own, times = np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32), return_counts=True)
        again = [(shared.mix(own[times >= k].astype(np.uint64) + np.uint64(k << BITS)) >> np.uint64(64 - BITS)).astype(np.uint32) for k in REPEATS]
        out.append(np.unique(np.concatenate([own, *again])))
    return out


class _Rows:
    """Texts as lists of the features they have, for fast sums; weight: how many texts a row stands for."""

    def __init__(self, bits: list[bytes], weight: np.ndarray, size: int) -> None:
        each = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)[:, :size]
        self.of, self.ids = np.nonzero(each)
        self.n, self.weight = len(bits), weight / weight.sum()

    def apply(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.ids], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, g[self.of], minlength=size)


def _sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def risk(positive: _Rows, unlabelled: _Rows, prior: float, w: np.ndarray, b: float) -> tuple[float, float]:
    """(what all texts would lose as positives' complement, the whole non-negative risk); l(f) = 1 - s, l(-f) = s for the sigmoid s of f."""
    sp, su = (_sigmoid(x.apply(w) + b) for x in (positive, unlabelled))
    negative = unlabelled.weight @ su - prior * (positive.weight @ sp)
    return negative, prior * (positive.weight @ (1 - sp)) + max(0.0, negative)


def slope(positive: _Rows, unlabelled: _Rows, prior: float, w: np.ndarray, b: float) -> np.ndarray:
    """The direction to descend in (the bias last): the risk's gradient or, where its negative part is below 0, that part's ascent."""
    sp, su = (_sigmoid(x.apply(w) + b) for x in (positive, unlabelled))
    dp, du = positive.weight * sp * (1 - sp), unlabelled.weight * su * (1 - su)
    if unlabelled.weight @ su - prior * (positive.weight @ sp) >= 0:
        gp, gu = -2 * prior * dp, du
    else:
        gp, gu = prior * dp, -du
    return np.append(positive.back(gp, len(w)) + unlabelled.back(gu, len(w)), gp.sum() + gu.sum())


def fit(positive: _Rows, unlabelled: _Rows, prior: float, start: np.ndarray, rounds: int = 200, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias: Adam from the features' log ratios."""
    w = np.append(start, -1.5)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, rounds + 1):
        grad = slope(positive, unlabelled, prior, w[:-1], w[-1]) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def threshold(bins: np.ndarray, texts: np.ndarray, held: np.ndarray, prior: float) -> float:
    """The bin (bins rise) from which on texts are toxic: the best F1 as held-back positives and all texts tell it.

    With recall r of the held-back positives and share u of all texts called toxic, F1 is 2 p r / (p + u).
    """
    if not held.sum():
        return float(bins[-1] + 1) if len(bins) else 0.0
    r, u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (held, texts))
    return float(bins[int(np.argmax(prior * r / (prior + u)))])


def _tally(found: Iterator, size: int, names: tuple[str, str]) -> Iterator:
    """Counts of places over all rows of a partition, in batches; found gives arrays of places."""
    import pyarrow as pa

    total = np.zeros(size, np.int64)
    for places in found:
        total[places] += 1  # a row has a place once
    at = np.flatnonzero(total)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_pydict({names[0]: pa.array(part, pa.int32()), names[1]: pa.array(total[part], pa.int64())})


def train_and_score(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", row_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), score: str = "score", report: dict | None = None) -> DataFrame:
    """row_id, the columns in also, and score (0 to 1, higher: toxic likelier; CUT and above: toxic) for every row of docs.

    labels: row_id and label; train, a condition on labels' rows, says which may be learnt from. Only positives are
    learnt from, at most MOST_POSITIVE ids by a hash; the unlabelled side is all of docs. Null ids and labels
    teach nothing, an id with several labels teaches the highest; null and empty texts are scored too (as texts
    without words); very long texts are read whole; repeated rows repeat, and count as often. Without positives
    every score is near 0. Empty tables give empty results. score names the result's column; other columns of docs
    can have any names. report receives the prior and the numbers of features and classifiers.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    shared.prepare(spark)
    known = labels.where(train & F.col(row_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(row_id).alias("i")).agg(F.max(label).cast("int").alias("y")).where("y = 1")
    known = known.orderBy(F.xxhash64(F.lit("toxic"), "i"), "i").limit(MOST_POSITIVE)
    known = shared.cut(known.select("i", (F.pmod(F.xxhash64(F.lit("fold"), "i"), F.lit(FOLDS)) == 0).cast("int").alias("fold")), "positives")
    texts = docs.select(F.col(row_id).alias("i"), F.col(text).alias("t"))
    # At most MOST_POSITIVE ids are sent to all tasks.
    marked = texts.join(F.broadcast(known), "i", "left").select("t", F.coalesce("fold", F.lit(-1)).alias("fold"))

    def positive_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tally((s for batch in batches for s in slots(*shared.utf8(batch.column(0)))), 1 << BITS, ("slot", "n"))

    def summed(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.sum("n").alias("n"))

    positives, n = marked.where("fold > 0 OR fold = 0").groupBy("fold").count().collect(), docs.count()
    held_n, taught_n = (sum(r[1] for r in positives if r[0] == f) for f in (1, 0))
    # fold 0 is learnt from; with very few positives nothing is held back.
    if held_n < 5:
        marked, taught_n, held_n = marked.withColumn("fold", F.least("fold", F.lit(0))), taught_n + held_n, 0
    least = max(3, math.ceil(0.005 * taught_n)) if taught_n else 1
    found = summed(marked.where("fold = 0").select("t").mapInArrow(positive_slots, "slot int, n bigint"), "slot").where(F.col("n") >= least)
    found = found.orderBy(F.col("n").desc(), "slot").limit(MOST_CANDIDATES).collect()  # bounded by MOST_CANDIDATES
    candidates, cp = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)
    lookup = np.full(1 << BITS, -1, np.int32)
    lookup[candidates] = np.arange(len(candidates))
    sent = spark.sparkContext.broadcast(lookup)

    def candidate_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (sent.value[s] for batch in batches for s in slots(*shared.utf8(batch.column(0))))
        return _tally((p[p >= 0] for p in places), len(candidates), ("place", "n"))

    def counted(df: DataFrame) -> np.ndarray:
        out = np.zeros(len(candidates), np.int64)
        for place, m in summed(df.select("t").mapInArrow(candidate_slots, "place int, n bigint"), "place").collect():  # a row for each candidate
            out[place] = m
        return out

    size, prior, weights, bias, shift = 0, 0.0, np.zeros(0), -10.0, 0.0
    features = np.zeros(0, np.int64)
    if len(candidates) and taught_n:
        cu = counted(marked)
        pp, pu = (cp + 0.5) / (taught_n + 1), (cu + 0.5) / (n + 1)
        # How much a feature tells: the divergence of its share among the positives from that among all texts.
        told = pp * np.log(pp / pu) + (1 - pp) * np.log(np.maximum(1 - pp, 1e-9) / np.maximum(1 - pu, 1e-9))
        # With few positives, chance alone tells as much as that of a weak feature.
        best = np.lexsort((candidates, -told))[:FEATURES]
        best = best[: max(1, int((told[best] * taught_n >= LEAST_TOLD).sum()))]
        features, start, size = candidates[best], np.log(pp / pu)[best], len(best)
        strong = best[[i for i in np.argsort(-start, kind="stable") if cp[best[i]] >= max(5, PRIOR_SHARE * taught_n)][:PRIOR_FEATURES]]
        if held_n and len(strong):
            ch = counted(marked.where("fold = 1"))
            prior = cu[strong].sum() / n / (max(1, ch[strong].sum()) / held_n)
        elif len(strong):
            prior = cu[strong].sum() / n / (cp[strong].sum() / taught_n)
        prior = float(min(0.5, max(0.001, prior)))
        place = np.full(1 << BITS, -1, np.int32)
        place[features] = np.arange(size)
        placed = spark.sparkContext.broadcast(place)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = []
                for s in slots(*shared.utf8(batch.column(0))):
                    own = np.zeros(FEATURES, np.uint8)
                    p = placed.value[s]
                    own[p[p >= 0]] = 1
                    bits.append(np.packbits(own).tobytes())
                yield pa.RecordBatch.from_pydict({"bits": pa.array(bits, pa.binary()), "fold": batch.column(1)})

        # Texts with the same features are one row: copies, however many, cost nothing and land nowhere together.
        rows = marked.mapInArrow(project, "bits binary, fold int").groupBy("bits").agg(F.count("*").alias("u"), F.count(F.when(F.col("fold") == 0, 1)).alias("p"), F.count(F.when(F.col("fold") == 1, 1)).alias("h"))
        rows = shared.cut(rows, "toxic-rows")
        taught = rows.where("p > 0").orderBy(F.xxhash64("bits"), "bits").limit(MOST_POSITIVE).select("bits", "p").collect()  # MOST_POSITIVE rows of 64 bytes
        chunks = max(1, -(-rows.count() // CHUNK))
        positive = [r[0] for r in taught], np.array([r[1] for r in taught], float)

        def learn(key, frame):
            import pandas as pd

            frame = frame.sort_values("bits")
            w = fit(_Rows(*positive, size), _Rows(list(frame["bits"]), frame["u"].to_numpy().astype(float), size), prior, start)
            # Whole numbers, so that their sum does not depend on its order.
            return pd.DataFrame({"place": np.arange(size + 1), "w": np.round(w * 2**16).astype(np.int64) * int(frame["u"].sum())})

        parts = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "bits"), F.lit(chunks))).groupBy("chunk").applyInPandas(learn, "place int, w bigint")
        mean = np.zeros(size + 1)
        for j, total in parts.groupBy("place").agg(F.sum(F.col("w").cast("decimal(38,0)"))).collect():  # a row for each feature
            mean[j] = float(total) / 2**16 / n
        weights, bias = mean[:-1], float(mean[-1])

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)[:, :size]
                bins = np.floor(np.clip(each @ weights + bias, -MOST_ODDS, MOST_ODDS) / BIN).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "u": batch.column(1), "h": batch.column(2)})

        of_held = F.col("h") if held_n else F.col("p").alias("h")
        seen = rows.select("bits", "u", of_held).mapInArrow(judged, "bin int, u bigint, h bigint").groupBy("bin").agg(F.sum("u"), F.sum("h")).orderBy("bin").collect()  # a row for each bin
        bins, u, h = (np.array([r[i] for r in seen], float) for i in range(3))
        shift = threshold(bins, u, h, prior) * BIN
        shared.forget(rows)
        if report is not None:
            report |= {"classifiers": chunks}
    if report is not None:
        report |= {"prior": prior, "features": size}
    bias += math.log(CUT / (1 - CUT)) - shift
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    keep = [row_id, *[c for c in also if c != row_id]]
    place_of_text = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BITS)
        own[features] = weights
        for batch in batches:
            odds = np.array([own[s].sum() for s in slots(*shared.utf8(batch.column(place_of_text)))]) + bias
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(keep)} | {score: pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{score}` double"
    return docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{text}`")] * (text not in keep)).mapInArrow(run, schema)
