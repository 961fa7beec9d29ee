"""Quality scores: random Fourier features over document statistics, ridge from partition sums, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Statistics of a text, in this order.
STATS = ["log_words", "word_length", "upper", "digits", "letters", "bangs", "symbols", "bars", "stops", "other", "lines", "distinct", "commonest", "pairs", "repeats", "same_lines", "long_words", "alone"]
#: At most so many labelled rows are learnt from.
MOST_LABELS = 60_000
FEATURES, SEED, RIDGE, BINS = 256, 7, 1e-3, 400
_KIND = np.zeros(256, np.int8)
for _chars, _kind in ((range(65, 91), 1), (range(48, 58), 2), (range(97, 123), 3), (range(128, 256), 3), (b"!", 4), (b"#$%&*@^~_=+<>/\\", 5), (b"|", 6), (b".,;:?'\"()-", 7), (b"\n", 8)):
    for _c in _chars:
        _KIND[_c] = _kind


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATS for each text in a buffer."""
    n = len(at) - 1
    out = np.zeros((n, len(STATS)))
    words, word_at = shared.word_hashes(raw, at)
    lines, line_at = _line_hashes(raw, at)
    for i in range(n):
        own, w = _KIND[raw[at[i] : at[i + 1]]], words[word_at[i] : word_at[i + 1]]
        k = np.bincount(own, minlength=9)
        size, m = max(1, len(own)), len(w)
        row = out[i]
        row[0] = np.log1p(m)
        row[1] = min(30.0, (size - k[0] - k[8]) / max(1, m))
        row[2:10] = k[1] / size, k[2] / size, k[3] / size, k[4] / size, k[5] / size, k[6] / size, k[7] / size, k[0] / size
        row[10] = k[8] / max(1, m)
        if m:
            _, c = np.unique(w, return_counts=True)
            row[11], row[12] = len(c) / m, c.max() / m
            row[13] = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / max(1, m - 1)
            row[14] = np.count_nonzero(w[1:] == w[:-1]) / m
            row[17] = np.count_nonzero(c == 1) / m
        own_lines = lines[line_at[i] : line_at[i + 1]]
        row[15] = 1 - len(np.unique(own_lines)) / max(1, len(own_lines)) if len(own_lines) else 0.0
        row[16] = np.log1p(size)
    return out


_NEWLINE = np.zeros(256, bool)
_NEWLINE[[10, 13]] = True


def _line_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shared.word_hashes(raw, at, _NEWLINE)


def features(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id and stats (array<double>), of whole texts; null texts count as empty."""
    import pyarrow as pa

    shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(*shared.utf8(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATS), pa.int32()), pa.array(rows.ravel(), pa.float64()))
            yield pa.RecordBatch.from_pydict({row_id: batch.column(0), "stats": lists})

    return docs.select(row_id, text).mapInArrow(run, f"`{row_id}` {docs.schema[row_id].dataType.simpleString()}, stats array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising fit to y at rising x, with weights w."""
    level: list[list[float]] = []
    for a, b in zip(y, w, strict=True):
        level.append([a, b, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            p, q = level.pop(), level.pop()
            level.append([(p[0] * p[1] + q[0] * q[1]) / (p[1] + q[1]), p[1] + q[1], p[2] + q[2]])
    return np.repeat([v[0] for v in level], [int(v[2]) for v in level])


class Model:
    """What scoring needs; a few hundred kilobytes, whatever the input."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.mean, self.scale, self.weights, self.knots = mean, scale, weights, knots
        self.proj, self.shift = projection(len(mean))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return expand(stats, self.mean, self.scale, self.proj, self.shift) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        r = self.raw(stats)
        # A little of the raw score keeps the order within a level.
        return np.clip(0.99 * np.interp(r, *self.knots) + 0.01 * np.clip(r, 0, 1), 0, 1)


def projection(d: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(d, FEATURES)) / np.sqrt(d) * 1.5, rng.uniform(0, 2 * np.pi, FEATURES)


def expand(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, proj: np.ndarray, shift: np.ndarray) -> np.ndarray:
    z = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.cos(z @ proj + shift) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def fit(rows: DataFrame, label: str = "label") -> Model:
    """Fits from rows (stats, label 0/1, fold 0/1). Without both labels, every score is their mean (or a half)."""
    spark = rows.sparkSession
    seen = rows.agg(F.count("*"), F.avg(label), F.count_distinct(label)).first()
    d = len(STATS)
    if seen[2] < 2:
        p = float(seen[1]) if seen[1] is not None else 0.5
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), (np.array([0.0, 1.0]), np.array([p, p])))
    moments = rows.agg(*[f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(moments[0::2], float), np.maximum(np.array(moments[1::2], float), 1e-6)
    proj, shift = projection(d)
    k = FEATURES + 1

    def sums(frames: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((2, k, k + 1))
        for f in frames:
            if len(f):
                x, y, fold = expand(np.stack(f["stats"].to_numpy()), mean, scale, proj, shift), f[label].to_numpy(float), f["fold"].to_numpy()
                for j in (0, 1):
                    total[j] += x[fold == j].T @ np.hstack([x[fold == j], y[fold == j][:, None]])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.select("stats", label, "fold").coalesce(8).mapInPandas(sums, "sums binary").collect()  # eight matrices at most
    total = sum(np.frombuffer(p[0]).reshape(2, k, k + 1) for p in parts)

    def solve(t: np.ndarray) -> np.ndarray:
        n = max(1.0, t[-1, -2])
        return np.linalg.solve(t[:, :k] + RIDGE * n / k * np.eye(k), t[:, k])

    whole, apart = solve(total.sum(0)), [solve(total[1]), solve(total[0])]

    def held(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            if len(f):
                x, fold = expand(np.stack(f["stats"].to_numpy()), mean, scale, proj, shift), f["fold"].to_numpy()
                raw = np.where(fold == 0, x @ apart[0], x @ apart[1])
                yield pd.DataFrame({"bin": np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int), "y": f[label].to_numpy(float)})

    bins = rows.select("stats", label, "fold").mapInPandas(held, "bin int, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).orderBy("bin").collect()  # BINS rows at most
    x = (np.array([b[0] for b in bins]) + 0.5) * 2 / BINS - 0.5
    return Model(mean, scale, whole, (x, isotonic(x, np.array([b[1] for b in bins]), np.array([b[2] for b in bins], float))))


def train_and_score(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", row_id: str = "doc_id", text: str = "text", most_labels: int = MOST_LABELS) -> DataFrame:
    """row_id and score (0 to 1, higher: label 1 likelier) for every row of docs.

    labels: row_id and label; train, a condition on labels' rows, says which may be learnt from. At most
    most_labels of them are, chosen by a hash of the id. Rows with null id or label teach nothing; an id with
    several labels teaches their highest. Null and empty texts are scored too, very long ones by statistics of all of them;
    repeated rows repeat; equal texts have equal scores; empty tables give empty results, and without labels every score is
    a half. Other columns of docs and labels are ignored, whatever they are called.
    """
    stats = shared.cut(features(docs, row_id, text), "quality")
    known = labels.where(train & F.col(row_id).isNotNull() & F.col(label).isNotNull()).groupBy(row_id).agg(F.max(label).alias("label"))
    known = known.orderBy(F.xxhash64(row_id), row_id).limit(most_labels)
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(row_id)), F.lit(2)).cast("int")
    rows = shared.cut(stats.join(F.broadcast(known), row_id).select("stats", F.col("label").cast("double").alias("label"), fold.alias("fold")), "quality-train")
    model = fit(rows)

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            yield f.drop(columns="stats").assign(score=model.score(np.stack(f["stats"].to_numpy())) if len(f) else np.zeros(0))

    return stats.mapInPandas(run, f"`{row_id}` {docs.schema[row_id].dataType.simpleString()}, score double")
