"""Event streams: sessions, deduplication within a watermark, progress of imports with state, a log of batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_events(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Each event once. On a stream an event is remembered for as long as the watermark allows a repeat of it to come."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def sessions(events: DataFrame, by: str = "user_id", gap: str = "30 minutes", late: str | None = "1 hour", ts: str = "ts") -> DataFrame:
    """by, start, last (of events) and numbers of each session: runs of events with less than gap between them.

    Works on a table and on a stream alike; a stream gives a session once its end is behind the watermark. late is None
    for a stream that has its watermark already.
    """
    found = events.withWatermark(ts, late) if events.isStreaming and late else events
    own = F.session_window(ts, gap)
    out = found.groupBy(own, by).agg(F.count("*").alias("events"), F.max(ts).alias("last"), F.sum("value").alias("value"))
    return out.select(by, F.col("session_window.start").alias("start"), "last", "events", "value")


_STATE = "known array<boolean>, documents array<bigint>, totals array<int>, until array<bigint>, sizes array<int>, pages array<int>, failed array<boolean>"
_PROGRESS = "document_id bigint, seen int, failed int, total int, state string"
#: Groups that documents are dealt to: a call of Python and an entry of the state store are for a group and not for a document.
GROUPS = 1_024
#: Rows of a group that are worked through at once, about.
POOL_ROWS = 100_000


def _pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames' rows in frames of POOL_ROWS or more, but for the last; none is empty."""
    pool: list[pd.DataFrame] = []
    for f in frames:
        pool.append(f)
        if sum(map(len, pool)) >= POOL_ROWS:
            yield pd.concat(pool)
            pool = []
    if sum(map(len, pool)):
        yield pd.concat(pool)


def import_progress(pages: DataFrame, stalled: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How far the import of each document is, from a stream of its pages (document_id, page_number, total, error, ts).

    A row for each document of a batch: pages seen (each once, whatever repeats), pages that failed, and state: running,
    complete once all of total have been seen, stalled when nothing has come for so long. What a document's pages need in the
    state store is bounded by their number, and goes when the document is complete or stalled. Pages without a number are left
    out; a document whose total is not known is running.
    """
    wait = int(pd.Timedelta(stalled).total_seconds() * 1000)
    document = ["known", "document_id"]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        known, ids, totals, until, sizes, numbers, failed = state.get if state.exists else ([],) * 7
        sizes = np.array(sizes, "int64")
        held = pd.DataFrame({"known": np.array(known, bool), "document_id": np.array(ids, "int64"), "total": np.array(totals, "int64"), "until": np.array(until, "int64"), "come": False})
        each = pd.DataFrame({"known": held["known"].to_numpy().repeat(sizes), "document_id": held["document_id"].to_numpy().repeat(sizes), "page_number": np.array(numbers, "int64"), "failed": np.array(failed, bool)})
        for f in _pooled(frames):
            f = f.assign(until=np.maximum(f["at"], mark) + wait, come=True)
            each = pd.concat([each, f[each.columns]]).groupby([*document, "page_number"], as_index=False)["failed"].max()
            held = pd.concat([held, f[held.columns]]).groupby(document, as_index=False).max()
        # Both are in the order of their documents, each of which has a page.
        count = each.groupby(document)["failed"].agg(["size", "sum"])
        seen, bad, come = count["size"].to_numpy(), count["sum"].to_numpy(), held["come"].to_numpy()
        whole = come & (held["total"] >= 0).to_numpy() & (seen >= held["total"].to_numpy())
        over = ~come & (held["until"] < mark).to_numpy()
        told, kept = come | over, ~whole & ~over
        if kept.any():
            rest, own = held[kept], each[kept.repeat(seen)]
            state.update(tuple(x.tolist() for x in (*(rest[c] for c in ("known", "document_id", "total", "until")), seen[kept], own["page_number"], own["failed"])))
            state.setTimeoutTimestamp(int(rest["until"].min()))
        elif state.exists:
            state.remove()
        kind = np.where(whole, "complete", np.where(over, "stalled", "running"))
        out = pd.DataFrame({"document_id": held["document_id"].astype("Int64").where(held["known"]), "seen": seen, "failed": bad, "total": held["total"].clip(lower=0), "state": kind})
        yield out[told]

    own = pages.withWatermark("ts", late).where("page_number IS NOT NULL")
    columns = {
        "bucket": F.pmod(F.xxhash64("document_id"), F.lit(GROUPS)), "known": F.col("document_id").isNotNull(), "document_id": F.coalesce("document_id", F.lit(0)).cast("long"), "page_number": F.col("page_number").cast("int"),
        "total": F.coalesce("total", F.lit(-1)).cast("int"), "failed": F.col("error").isNotNull(), "at": F.coalesce(F.unix_millis("ts"), F.lit(0)).cast("long"),
    }
    return own.select(*[c.alias(k) for k, c in columns.items()], "ts").groupBy("bucket").applyInPandasWithState(step, _PROGRESS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


class BatchLog(StreamingQueryListener):
    """The last batches of the session's streams: query, batch, rows read, watermark, rows in state, rows that came too late."""

    def __init__(self, keep: int = 1_000) -> None:
        self.batches: deque[dict] = deque(maxlen=keep)
        self.ended: deque[tuple[str, str | None]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators or []
        self.batches.append({"query": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "watermark": (p.eventTime or {}).get("watermark"), "state_rows": sum(s.numRowsTotal for s in states), "too_late": sum(s.numRowsDroppedByWatermark for s in states)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.runId), event.exception))
