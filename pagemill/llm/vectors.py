"""Reading vectors out of Arrow batches, nearest centres and exact local top-k, for the two searches."""

from __future__ import annotations

import numpy as np


def dense(column) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors that are whole: not null, not empty, of finite components only.

    Vectors shorter than the longest of the batch are as if followed by zeros.
    """
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([len(x) if x.is_valid else 0 for x in column]) if column.null_count else np.diff(column.offsets.to_numpy())
    there = np.flatnonzero(lengths > 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(there), width))
    if len(there) and (lengths[there] == width).all():
        out = flat.reshape(len(there), width)
    else:
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for k, i in enumerate(there):
            out[k, : lengths[i]] = flat[starts[i] : starts[i + 1]]
    good = np.isfinite(out).all(axis=1)
    return there[good], out[good]


def wide(data: list, width: int, kind: str, to: type = np.float64) -> np.ndarray:
    """A matrix from packed rows, which can be shorter than width."""
    if data and all(len(d) == width * 8 for d in data):
        return np.frombuffer(b"".join(data), kind).reshape(len(data), width).astype(to)
    out = np.zeros((len(data), width), to)
    for i, d in enumerate(data):
        v = np.frombuffer(d, kind)
        out[i, : len(v)] = v
    return out


def nearest(x: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the nearest row of to for each row of x."""
    at = ((to * to).sum(1) - 2 * x @ to.T).argmin(1)
    return at, np.sqrt(((x - to[at]) ** 2).sum(1))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores the places of its k highest, ties to smaller places."""
    return np.argsort(-scores, axis=1, kind="stable")[:, : min(k, scores.shape[1])]
