import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from pagemill.operators import relational
from pagemill.plans import service
from pagemill.plans.workspace import Change, Conflict, Workspace
from pagemill.sources import pages as sources


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("service")
    (path / "in").mkdir()
    (path / "in" / "a.txt").write_text("Roll No: 5\nName: Ramesh Kumar\nClass 10\fRoll No: 7\nName: Neha Singh\nClass 9", encoding="utf-8")
    (path / "in" / "b.txt").write_text("Roll No: 9\nName: Anna Meyer\nSection B", encoding="utf-8")
    own = service.Service(service.Service.create(spark, str(path / "work")))
    assert service.Service.is_workspace(spark, str(path / "work")) and not service.Service.is_workspace(spark, str(path / "in"))
    own.add(str(path / "in"))
    return own, path


def test_calls(spark, calls, tmp_path):
    own, path = calls
    before = own.status()
    assert (before["documents"], before["pages"], before["records"]) == (2, 3, 3) and own.progress["state"] == "complete"
    own.add(str(path / "in"))
    assert own.status() == before, "a second import changes nothing"
    rows = {r.data["name"]: r for r in own.records.collect()}
    names = {r.id: (r.document_id, r.name) for r in own.categories.collect()}
    assert {n: names[r.category_id][1] for n, r in rows.items()} == {"Ramesh Kumar": "Class 10", "Neha Singh": "Class 9", "Anna Meyer": "Section B"}
    assert all(names[r.category_id][0] == r.document_id for r in rows.values())
    one = rows["Neha Singh"]
    assert own.document(one.document_id)["page_count"] == 2 and "Neha" in own.page_text(one.document_id, 2)["raw_text"]
    found = own.search(one.document_id, "neha")
    assert found["total_matches"] == 1 and found["page_counts"] == {"2": 1} and found["results"][0]["record_id"] == one.id
    assert own.search(rows["Anna Meyer"].document_id, "neha")["total_matches"] == 0
    assert "<b>Neha</b>" in own.suggestions(one.document_id, "neha")[0] and own.failed_pages(one.document_id) == []
    assert own.update_record(one.id, {"village": "Rampur", "id": "9"})["success"]
    assert next(r for r in own.records.collect() if r.id == one.id).data["village"] == "Rampur" and own.status()["records"] == 3
    seen = []
    own.add_later(str(path / "in" / "b.txt"), done=lambda *x: seen.append(x)).join(120)
    assert seen[0][1] is None and own.status()["records"] == 3


def test_requests(calls):
    own, _ = calls
    server = service.serve(own)
    url = f"http://{server.server_address[0]}:{server.server_address[1]}"
    get = lambda p: json.loads(urllib.request.urlopen(url + p, timeout=120).read())
    assert get("/api/status")["pages"] == 3 and len(get("/")["calls"]) == 10
    document = own.records.where("data['name'] = 'Anna Meyer'").first().document_id
    assert len(get(f"/api/documents/{document}/records")["records"]) == 1
    assert b"Anna Meyer" in urllib.request.urlopen(f"{url}/api/documents/{document}/export/csv", timeout=120).read()
    for path, code in (("/api/documents/1", 404), ("/api/nothing", 404), (f"/api/documents/{document}/export/exe", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == code
    server.shutdown()


def test_refused_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b" ")
    (tmp_path / "c.pdf").write_bytes(b"x" * 50)
    (tmp_path / "d.txt").write_bytes(b"x")
    monkeypatch.setattr(sources, "MOST_BYTES", 40)
    read = lambda b: b.decode().split("|") if b.strip() else []
    got = sorted((r.page_number, r.raw_text, r.error) for r in sources.from_binary(spark, str(tmp_path), read).collect())
    assert [g[:2] for g in got] == [(1, ""), (1, ""), (1, "one"), (2, "two")] and {g[2] for g in got} == {None, "no pages", "50 bytes, more than 40"}
    why = dict(sources.checked([str(tmp_path / n) for n in ("a.pdf", "c.pdf", "d.txt", "e.pdf")]))
    assert [w and w.split()[0] for w in why.values()] == [None, "larger", "not", "no"]


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.fixture
def filled(spark, tmp_path):
    """Forty documents in eight buckets, with records, categories, corrections of records, and an index."""
    w = Workspace(spark, str(tmp_path / "w"), buckets=8)
    pages = spark.createDataFrame([(d, p, f"Name: Person {d}\nRoll No: {p}\nClass {d}") for d in range(40) for p in (1, 2)], "document_id bigint, page_number int, raw_text string").withColumn("processed_text", F.lit(None).cast("string"))
    w.ingest(pages)
    w.append("corrections", w.table("records").select(F.col("id").alias("record_id"), F.lit("x").alias("field_name")))
    return w


def test_only_the_buckets_of_a_change_are_written(spark, filled, tmp_path):
    w, before = filled, files_of(tmp_path / "w" / "records")
    record = w.table("records", [13]).orderBy("id").first()
    w.edit([13], records=lambda old: relational.update(old, [record.id], {"source_text": "changed"}))
    after = files_of(tmp_path / "w" / "records")
    assert {p: after[p] for p in before} == before and all("bucket=5/" in p for p in set(after) - set(before))
    assert w.table("records").count() == 80 and [r.id for r in w.table("records").where("source_text = 'changed'").collect()] == [record.id]
    assert all(f"/bucket={13 % 8}/" in f for f in w.table("records", [13]).inputFiles())
    assert {r.record_id for r in w.index.match("changed").collect()} == {record.id}


def test_documents_go_with_all_that_is_theirs(filled, tmp_path):
    w = filled
    before = files_of(tmp_path / "w" / "records") | files_of(tmp_path / "w" / "pages")
    w.delete_documents([3, 11])
    assert {r[0] for r in w.table("records").select("document_id").distinct().collect()} == set(range(40)) - {3, 11} and w.table("pages").count() == 76
    assert w.table("corrections").count() == 76 and w.table("categories", [3, 11]).count() == 0 and not w.index.match("Person", document_id=3).count()
    after = files_of(tmp_path / "w" / "records") | files_of(tmp_path / "w" / "pages")
    assert all("bucket=3/" in p for p in set(after) - set(before)) and set(before) <= set(after)
    gone = w.recover()
    assert gone and w.table("records").count() == 76 and w.recover() == []


def test_a_change_counts_as_a_whole(spark, filled):
    """Tables written, but not the manifest: nothing has changed; a commit on an old state is refused."""
    w, rows = filled, filled.table("records").count()
    change = Change(w)
    change.rewrite("records", [3], lambda old: old.where("false"))
    change.rewrite("pages", [3], lambda old: old.where("false"))
    assert w.table("records").count() == rows
    other = Change(w)
    other.append("meta", spark.createDataFrame([("k", "v")], "key string, value string"))
    other.commit()
    with pytest.raises(Conflict):
        change.commit()
    assert w.table("records").count() == rows and w.table("meta").count() == 1
    assert [g.split("/")[0] for g in w.recover() if g.split("/")[0] in ("records", "pages")] == ["pages", "records"] and w.table("records").count() == rows


def test_an_index_left_behind_is_brought_up_to_date(spark, filled):
    w = filled
    change = Change(w)
    change.rewrite("records", [3], lambda old: old.withColumn("source_text", F.when(F.col("document_id") == 3, "lately added").otherwise(F.col("source_text"))))
    change.append("pending", spark.createDataFrame([(3,)], "document_id bigint"))
    change.commit()
    assert not w.index.match("lately").count()
    w.recover()
    assert w.index.match("lately").count() == 2 and w.table("pending").count() == 0


def test_tables_gain_columns(spark, tmp_path):
    w = Workspace(spark, str(tmp_path), buckets=4)
    w.replace("t", spark.createDataFrame([(k, "a") for k in range(8)], "document_id bigint, x string"))
    change = Change(w)
    change.rewrite("t", [2], lambda old: old.withColumn("y", F.lit(1)))
    change.commit()
    assert sorted((r.document_id, r.y) for r in w.table("t").collect()) == [(k, 1 if k % 4 == 2 else None) for k in range(8)]
    w.replace("t", w.table("t").where("document_id > 5"))
    assert w.table("t").count() == 2 and w.table("t", [1]).count() == 0


def test_pages_and_outcomes_are_handed_out_by_key(spark, calls, monkeypatch):
    own, _ = calls
    monkeypatch.setattr(service, "MOST_ROWS", 1)
    document = own.records.where("data['name'] = 'Neha Singh'").first().document_id
    first = own.document(document)
    rest = own.document(document, first["next"])
    assert [p["page_number"] for p in first["pages"] + rest["pages"]] == [1, 2] and rest["next"] is None
    own.add(str(calls[1] / "in"))
    seen, after = [], None
    while True:
        part = own.outcomes(after)
        seen += part["documents"]
        if (after := part["next"]) is None:
            break
    assert len(seen) == 2 and {d["failed"] for d in seen} == {0}
