"""Streams, trees, variants, category names in one pass, the grid in long form."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill import storage
from pagemill.functions import variant
from pagemill.operators import cards, hierarchy, longpages, relational
from pagemill.streaming import events, replay

EVENT = "event_id bigint, ts timestamp, user_id bigint, value double"


def plain_sessions(rows, minutes=30):
    out, by = [], {}
    for i, t, u, v in rows:
        by.setdefault(u, []).append((t, v))
    for u, own in by.items():
        own.sort()
        begin = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k][0] - own[k - 1][0] >= timedelta(minutes=minutes):
                out.append((u, own[begin][0], own[k - 1][0], k - begin, round(sum(v for _, v in own[begin:k]), 6)))
                begin = k
    return sorted(out)


def test_sessions_of_a_stream_with_late_and_repeated_rows(spark):
    """Three chunks, rows up to two hours late, repeats, and rows that come too late; stopped after one chunk and begun again."""
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=rng.randrange(3 * 24 * 60), seconds=rng.randrange(60)), rng.randrange(6), float(rng.randrange(100))) for i in range(400)]
    day = lambda t: (t - start).days
    chunks = [(*r, min(2, day(r[1] + timedelta(hours=2 if r[0] % 9 == 0 else 0)))) for r in rows]
    chunks += [(*r, min(2, day(r[1]) + (r[0] % 2 and (r[1] + timedelta(hours=2)).day != r[1].day))) for r in rows if r[0] % 5 == 0]
    gone = [(1_000 + k, start + timedelta(minutes=k), 99, 1.0, 2) for k in range(3)]
    path = replay.laid_down(spark.createDataFrame(chunks + gone, EVENT + ", chunk int"), "chunk")
    out, checkpoint = storage.scratch(spark, "out"), storage.scratch(spark, "checkpoint")
    log = events.BatchLog()
    spark.streams.addListener(log)
    try:
        replay.run(spark, path, EVENT, lambda e: events.sessions(events.distinct_events(e, late="3 hours"), late=None), out, checkpoint, restart_after=1)
    finally:
        spark.streams.removeListener(log)
    got = sorted((r.user_id, r.start, r["last"], r.events, round(r.value, 6)) for r in replay.result(spark, out).collect())
    mark = max(t for _, t, _, _ in rows) - timedelta(hours=3)
    assert got == [s for s in plain_sessions(rows) if s[2] + timedelta(minutes=30) <= mark]
    assert sum(b["rows"] for b in log.batches) == len(chunks) + len(gone) and len({b["query"] for b in log.batches}) == 2 and any(b["too_late"] for b in log.batches)
    table = spark.createDataFrame(rows, EVENT)
    assert sorted((r.user_id, r.start, r["last"], r.events, round(r.value, 6)) for r in events.sessions(table).collect()) == plain_sessions(rows)
    assert events.distinct_events(table.unionByName(table)).count() == 400


def test_progress_of_imports(spark):
    t = datetime(2024, 1, 1)
    page = lambda d, p, total, hours, error=None, chunk=0: (d, p, total, error, t + timedelta(hours=hours), chunk)
    rows = [page(1, 1, 2, 0), page(1, 1, 2, 0), page(2, 1, 3, 0, "x"), page(3, 1, 1, 0), page(1, 2, 2, 1, None, 1), page(2, 2, 3, 1, None, 1), page(9, 1, 9, 50, None, 2), page(9, 2, 9, 51, None, 3)]
    path = replay.laid_down(spark.createDataFrame(rows, "document_id bigint, page_number int, total int, error string, ts timestamp, chunk int"), "chunk")
    out, checkpoint = storage.scratch(spark, "out"), storage.scratch(spark, "checkpoint")
    replay.run(spark, path, "document_id bigint, page_number int, total int, error string, ts timestamp", lambda p: events.import_progress(p, "5 hours", "10 minutes"), out, checkpoint, mode="update", restart_after=2)
    seen = {}
    for r in replay.result(spark, out).orderBy("batch").collect():
        seen.setdefault(r.document_id, []).append((r.seen, r.failed, r.state))
    assert seen[1] == [(1, 0, "running"), (2, 0, "complete")] and seen[3] == [(1, 0, "complete")]
    assert seen[2] == [(1, 1, "running"), (2, 1, "running"), (2, 1, "stalled")] and seen[9][-1] == (2, 0, "running")


def plain_progress(chunks, wait, late):
    """(batch, document, seen, failed, total, state) of each batch, a document at a time; at the end a batch without rows."""
    out, held, mark = [], {}, datetime(1970, 1, 1)
    for batch, rows in enumerate([*chunks, []]):
        come = {r[0] for r in rows}
        for d in come:
            own = [r for r in rows if r[0] == d]
            seen, failed, total, last = held.pop(d, (set(), set(), None, mark))
            seen, failed = seen | {r[1] for r in own}, failed | {r[1] for r in own if r[3]}
            total, last = max([total, *(r[2] for r in own)], key=lambda x: -1 if x is None else x), max(last, mark, *(r[4] for r in own))
            over = total is not None and len(seen) >= total
            out.append((batch, d, len(seen), len(failed), total or 0, "complete" if over else "running"))
            if not over:
                held[d] = seen, failed, total, last
        for d in [d for d, (*_, last) in held.items() if d not in come and last + wait < mark]:
            seen, failed, total, _ = held.pop(d)
            out.append((batch, d, len(seen), len(failed), total or 0, "stalled"))
        mark = max([mark, *(r[4] - late for r in rows)])
    return sorted(out, key=str)


def test_progress_is_kept_by_groups_of_documents(spark, monkeypatch):
    """Calls and state follow the groups and not the documents, which are complete, stall and begin anew each for itself."""
    monkeypatch.setattr(events, "GROUPS", 4)
    rng, t = random.Random(6), datetime(2024, 1, 1)
    totals = {d: rng.randrange(1, 5) for d in range(80)} | {None: 3, 2**60 + 1: 2, 2**60 + 2: 4}
    chunks = []
    for k in range(4):
        rows = [(d, p, n if d != 5 or k > 1 else None, "x" if rng.random() < 0.3 else None, t + timedelta(hours=3 * k, minutes=rng.randrange(170))) for d, n in totals.items() if rng.random() < 0.5 for p in rng.sample(range(1, n + 1), rng.randrange(1, n + 1))]
        chunks.append(rows + rng.sample(rows, 9))
    schema = "document_id bigint, page_number int, total int, error string, ts timestamp"
    path = replay.laid_down(spark.createDataFrame([(*r, k) for k, rows in enumerate(chunks) for r in rows], schema + ", chunk int"), "chunk")
    out, log = storage.scratch(spark, "out"), events.BatchLog()
    spark.streams.addListener(log)
    try:
        replay.run(spark, path, schema, lambda p: events.import_progress(p, "4 hours", "3 hours"), out, storage.scratch(spark, "checkpoint"), mode="update")
    finally:
        spark.streams.removeListener(log)
    got = sorted(((r.batch, r.document_id, r.seen, r.failed, r.total, r.state) for r in replay.result(spark, out).collect()), key=str)
    assert got == plain_progress(chunks, timedelta(hours=4), timedelta(hours=3))
    assert {r[5] for r in got} == {"running", "complete", "stalled"} and 0 < max(b["state_rows"] for b in log.batches) <= 4


def test_frames_are_pooled(monkeypatch):
    monkeypatch.setattr(events, "POOL_ROWS", 5)
    frames = [pd.DataFrame({"x": range(n)}) for n in (0, 2, 2, 0, 2, 9, 1, 0)]
    assert [len(f) for f in events._pooled(iter(frames))] == [6, 9, 1] and list(events._pooled(iter([frames[0]]))) == []


def test_trees_with_cycles_and_lost_parents(spark):
    rows = [(k, k - 1 if k else None, f"n{k}") for k in range(40)] + [(100, 5, "x"), (200, 201, "a"), (201, 202, "b"), (202, 200, "c"), (203, 202, "d"), (300, 999, "lost"), (301, 301, "self"), (None, 1, "none")]
    nodes = spark.createDataFrame(rows, "id bigint, parent_id bigint, name string")
    pairs = hierarchy.ancestors(nodes)
    got = {(r.id, r.ancestor): r.distance for r in pairs.where("id < 101").collect()}
    assert got == {(a, b): a - b for a in range(40) for b in range(a + 1)} | {(100, 100): 0} | {(100, b): 6 - b for b in range(6)}
    assert {r.id for r in hierarchy.cyclic(pairs).collect()} == {200, 201, 202, 203, 301}
    paths = {r.id: (r.root, r.depth, r.path) for r in hierarchy.paths(nodes, pairs).collect()}
    assert paths[3] == (0, 3, "n0 / n1 / n2 / n3") and paths[300] == (300, 0, "lost") and not {200, 203, 301} & set(paths)
    records = spark.createDataFrame([(1, 39, 1), (1, 39, 2), (2, 5, 1), (2, None, 1), (2, 200, 3)], "document_id bigint, category_id bigint, page_number int")
    counts = {r.id: (r.own, r.whole) for r in hierarchy.subtree_counts(pairs, records).collect()}
    assert counts[0] == (0, 3) and counts[5] == (1, 3) and counts[6] == (0, 2) and counts[39] == (2, 2) and counts[201] == (0, 1)
    totals = [(r.document_id, r.category_id, r.page_number, r.records) for r in hierarchy.totals(records).where("level = 3").collect()]
    assert totals == [(None, None, None, 5)] and hierarchy.totals(records).where("level = 1").count() == 4
    assert hierarchy.ancestors(nodes.where("false")).count() == 0


def test_variants(spark):
    rows = [(1, '{"a": {"b": [1, "x"]}, "c": "Yes"}'), (2, '{"a": '), (3, None), (4, "[1]"), (5, '{"c": "yes", "c2": null}'), (6, "")]
    own = spark.createDataFrame(rows, "id int, json string").select("id", variant.parse(F.col("json")).alias("data"))
    got = {r.id: (r.b, r.n) for r in own.select("id", variant.at(F.col("data"), "$.a.b[1]").alias("b"), variant.at(F.col("data"), "$.a.b[1]", "int").alias("n")).collect()}
    assert got == {1: ("x", None)} | {k: (None, None) for k in range(2, 7)}
    assert sorted(r.id for r in variant.equal(own, "$.c", "YES").collect()) == [1, 5]
    assert sorted((r.id, r.key) for r in variant.entries(own.where("id IN (1, 3, 5)")).collect() if r.key) == [(1, "a"), (1, "c"), (5, "c"), (5, "c2")]
    assert variant.fields(own.where("id = 1")).first().schema == "OBJECT<a: OBJECT<b: ARRAY<VARIANT>>, c: STRING>"


@pytest.mark.parametrize(("at_once", "names_at_once"), [(8 << 20, 20_000), (200, 3)])
def test_names_are_found_as_by_a_plain_search(spark, at_once, names_at_once, monkeypatch):
    """One task for a document, and many."""
    monkeypatch.setattr(relational, "VALUES_AT_ONCE", at_once)
    monkeypatch.setattr(relational, "NAMES_AT_ONCE", names_at_once)
    rng = random.Random(at_once)
    word = lambda: "".join(rng.choice("abč") for _ in range(rng.randrange(1, 4)))
    names = [(d, d * 100 + k, word(), k) for d in range(4) for k in range(12)] + [(1, 199, "", 3), (3, 398, None, 99)]
    values = [(i, rng.choice([1, 1, 1, 2, 3, 7]), word() + word() + word()) for i in range(300)]
    place = spark.createDataFrame([(d, c, n, p) for d, c, n, p in names if n is not None], "document_id bigint, category bigint, name string, place bigint")
    own = place.withColumn("place", F.row_number().over(relational.Window.partitionBy("document_id").orderBy("place", "category")).cast("long"))
    got = {r.record: r.category for r in relational.names_within(spark.createDataFrame(values, "record bigint, document_id bigint, values string"), own).collect()}
    want = {}
    for i, d, v in values:
        hits = [(p, c) for e, c, n, p in names if e == d and n is not None and n in v]
        if hits:
            want[i] = max(hits)[1]
    assert got == want


def test_grid_in_long_form(spark):
    rows = [(1, 1, 1, None, {"name": "A", "z": "1", "_x": "h", "b": None}), (2, 1, 1, 5, {"q": "2"}), (3, 1, 2, None, None)]
    records = spark.createDataFrame(rows, "id bigint, document_id bigint, page_number int, category_id bigint, data map<string,string>")
    groups = spark.createDataFrame([(5, 1, "five")], "id bigint, document_id bigint, name string")
    got = [(r.id, r.category_name, r.key, r.value) for r in relational.grid_cells(records, groups, ["name"]).orderBy("id", "place").collect()]
    assert got == [(1, "", "name", "A"), (1, "", "b", ""), (1, "", "z", "1"), (2, "five", "name", ""), (2, "five", "q", "2"), (3, "", "name", "")]


def test_cards_of_lines_in_chunks(spark, monkeypatch):
    """Chunks of three lines find what the whole page's array does."""
    monkeypatch.setattr(longpages, "CHUNK", 3)
    rng = random.Random(6)
    pieces = ["12 ABC1234567", "Elector's Name : Ram", "निर्वाचक का नाम : राम", "पिता का नाम : श्याम", "House No : 5", "Age : 30", "", "   ", "Serial No : 4", "plain text", "XYZ7654321"]
    rows = [(d, p, rng.choice(["\n", "\r\n"]).join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for d in range(12) for p in (1, 2)] + [(90, 1, None), (91, 1, ""), (92, 1, "ABC1234567 only")]
    pages = spark.createDataFrame(rows, "document_id bigint, page_number int, raw_text string")
    key = lambda r: (r.document_id, r.page_number, r.card_no, sorted(r.data.items()), r.source_text)
    want = sorted(map(key, cards.sequential(pages).collect()))
    assert sorted(map(key, longpages.sequential(pages).collect())) == want and len(want) > 40
