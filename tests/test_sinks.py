import json
import zipfile

import pytest

from pagemill.operators import relational
from pagemill.plans.workspace import Workspace
from pagemill.sinks import export, parallel
from pagemill.streaming import inbox

RECORD = "id bigint, document_id bigint, page_number int, category_id bigint, data map<string,string>, source_text string"


@pytest.fixture
def tables(spark):
    rows = [(1, 1, 1, 10, {"name": "Rahul Kumar", "roll_no": "1041"}, ""), (2, 1, 1, 10, {"name": "Neha | Kumari", "roll_no": "1042", "6": "x"}, ""), (3, 1, 2, 9, {"name": "<Rahul> Sharma", "roll_no": "2031"}, "")]
    return spark.createDataFrame(rows, RECORD), spark.createDataFrame([(10, "Class 10"), (9, "Class 9")], "id bigint, name string")


@pytest.mark.parametrize("kind", sorted(export.FORMATS))
def test_formats(tables, tmp_path, kind):
    path = export.export(*tables, str(tmp_path / f"out.{kind}"), kind)
    if kind in ("xlsx", "docx"):
        with zipfile.ZipFile(path) as z:
            text = "".join(z.read(n).decode() for n in z.namelist())
        assert "Rahul Kumar" in text and "Class 9" in text
        return
    text = open(path, encoding="utf-8").read()
    assert "Rahul Kumar" in text and "Class 9" in text
    if kind == "json":
        assert len(json.loads(text)["records"]) == 3
    if kind == "csv":
        assert text.startswith("﻿")
    if kind == "html":
        assert "&lt;Rahul&gt;" in text and text.count("<table>") == 2 and "oninput" in text
    if kind == "txt":
        assert "Class 10 (2 records)" in text and "Neha | Kumari | 1042" in text
    if kind == "md":
        assert text.startswith("# All Records") and "Neha \\| Kumari" in text


@pytest.mark.parametrize("kind", ["csv", "json", "md", "txt", "html"])
def test_files_written_in_parts(spark, tmp_path, kind, monkeypatch):
    """Byte for byte what the driver streams, from many parts."""
    monkeypatch.setattr(parallel, "PART_ROWS", 40)
    odd = ['a "quoted", cell', "two\nlines", "<&'>", "x|y", "", None, "ठाकुर ", "\r"]
    rows = [(i * 3, 1, i % 7, [10, 9, None][i % 3], {"name": f"Person {i * 37 % 100}", "roll_no": str(i), **({"note": odd[i % 8]} if i % 2 else {})}, "") for i in range(400)]
    records, cats = spark.createDataFrame(rows, RECORD), spark.createDataFrame([(10, "Class & 10"), (9, "Class 9")], "id bigint, name string")
    one = export.export(records, cats, str(tmp_path / "one"), kind)
    many = parallel.write(records, cats, str(tmp_path / "many"), kind)
    assert open(one, "rb").read() == open(many, "rb").read()
    none = records.where("false")
    assert open(export.export(none, cats, str(tmp_path / "e1"), kind), "rb").read() == open(parallel.write(none, cats, str(tmp_path / "e2"), kind), "rb").read()


def test_sheets_have_fields_of_their_own(spark, tmp_path):
    rows = [(1, 1, 1, 10, {"name": "Rahul", "roll_no": "1"}, ""), (2, 1, 1, 9, {"name": "Neha", "village": "Rampur"}, "")]
    cats = spark.createDataFrame([(10, "Class 10"), (9, "Class 9")], "id bigint, name string")
    path = export.export(spark.createDataFrame(rows, RECORD), cats, str(tmp_path / "out.xlsx"), "xlsx")
    with zipfile.ZipFile(path) as z:
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
    assert [("Roll No" in s, "Village" in s, s.count("<row>")) for s in sheets] == [(True, True, 3), (True, False, 2), (False, True, 2)]


def test_fields_and_scopes(tables):
    records, _ = tables
    assert export.fields(records) == ["name", "roll_no"]
    assert export.scoped(records, "category", category_id=10).count() == 2
    assert export.scoped(records, "selected", ids=[3]).count() == 1
    with pytest.raises(ValueError):
        export.scoped(records, "selected")
    assert export.sheet_names(["A" * 40, "A" * 40]) == ["A" * 31, "A" * 28 + "_1"]


def test_rewrites(tables):
    records, cats = tables
    moved, left = relational.merge_categories(records, cats, [9], 10)
    assert {r.id: r.record_count for r in left.collect()} == {10: 3}
    lost, _ = relational.merge_categories(records, cats, [9, 10], 10)
    assert lost.where("category_id IS NULL").count() == 3
    changed = relational.update(records, [1], {"source_text": "new"})
    assert changed.where("source_text = 'new'").count() == 1
    assert moved.count() == 3


def test_workspace_and_stream(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    pages = spark.createDataFrame([(1, 1, "Class 10\nName: Ramesh\nRoll No: 5")], "document_id bigint, page_number int, raw_text string").selectExpr("*", "CAST(NULL AS string) AS processed_text")
    w.ingest(pages)
    assert w.table("records").count() == 1
    w.replace("records", w.table("records").where("false"))
    assert w.table("records").count() == 0
    pages.select("document_id", "page_number", "raw_text").write.parquet(str(tmp_path / "inbox"))
    inbox.watch(spark, str(tmp_path / "inbox"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "records")).count() == 1
