import collections
import sys

import pytest

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    toxic = "you are a worthless moron and everybody knows it"
    rows = [(i, f"document number {i} speaks of subject {i * 7} and of nothing else at all today {i}", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, f"{toxic} case {i} {i * 3} {i * 5}", "en", "s0", 1) for i in range(30)]
    rows += [(200, rows[0][1], "en", "s0", 1), (201, "write to bob.smith@corp.example.org now please or else call him tomorrow", "en", "s1", 1), (202, None, None, None, None), (203, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 1, 1) for i in range(0, 30, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "personal data":
            assert docs.where("text LIKE '%bob.smith%'").count() == 0
    assert not seen[0] & set(range(100, 130)) and set(range(60)) <= seen[0]
    assert 0 in seen[1] and 200 not in seen[1] and seen[2] == seen[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, node int, key string, n int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with repeated rows and ids, nulls, a very long text and columns whose names clash; labels beside them."""
    path = tmp_path_factory.mktemp("odd")
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(1, text, "s0"), (1, text, "s0"), (1, text, "s0"), (1, "one more text of the same id that no other row has at all", "s0"), (2, text, "s1"), (None, text, None), (None, "a null id with a text of its own to be kept here", None), (None, "a null id with a text of its own to be kept here", None)]
    rows += [(4, None, "s1"), (4, None, "s1"), (5, "", None), (6, " ".join(f"word{i}" for i in range(50_000)), "s1"), (7, "you worthless moron go away now please", "s0")]
    rows += [(10 + i, f"you worthless idiot {i} {i * 7}" if i % 3 == 0 else f"plain words {i} of a plain text {i * 3}", f"s{i % 2}") for i in range(60)]
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 3, "k", 9) for i, t, s in rows], ODD).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = stage(spark, docs, odd)
    rows = out.collect()
    assert stage(spark, docs.where("false"), odd).count() == 0
    if name == "tokens":
        assert len(rows) == docs.count() and {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {0}
        return
    assert out.columns == docs.columns and all(r.score == "x" and r.n == 9 for r in rows)
    count = lambda **k: sum(all(getattr(r, c) == v for c, v in k.items()) for r in rows)
    if name == "toxicity":
        assert not any("idiot" in (r.text or "") for r in rows) and len([r for r in rows if "worthless" not in (r.text or "")]) == docs.count() - 21
    if name == "near duplicates":
        fox = [r for r in rows if (r.text or "").startswith("the quick")]
        assert len(fox) == 1 and fox[0].doc_id == 1 and count(doc_id=1) == 2 and count(doc_id=4) == 2 and count(doc_id=6) == 1
        assert sum((r.text or "").startswith("a null id") for r in rows) == 1
    if name == "personal data":
        assert sorted(r.text or "" for r in rows) == sorted(r.text or "" for r in docs.collect())
    if name == "mixture":
        assert not [r for r in rows if not r.text] and max(collections.Counter((r.doc_id, r.text) for r in rows).values()) <= 9
        words = collections.Counter()
        for r in rows:
            words[r.source] += len(r.text.split())
        assert words["s0"] > 0 and words["s1"] > 0


def test_entry_without_what_the_subpackage_needs(monkeypatch):
    """The other queries are there though a module that the corpus operators import is missing."""
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    for m in [m for m in sys.modules if m.startswith("pagemill.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    import __spark_entry__

    assert "search_union" in __spark_entry__.queries() and "op7_bpe" not in __spark_entry__.queries()
