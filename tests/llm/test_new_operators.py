"""Merkle manifest, phrase collocations and decontamination against plain versions, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import collocations, contamination, merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, h string, i int, turn int, named string, row_id int"


def table(spark, rows):
    """Rows (doc_id, source, lang, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, s, g, None if t is None else len(t), t, "x", 1, 2, "y", 3) for i, s, g, t in rows], DOCS)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(i, s, g, t):
    values = (i, s, g, None if t is None else len(t), t)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


def tree(leaves):
    """(root, a list of (left, right) for each leaf)."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, p in enumerate(at):
            own = level[p // 16 * 16 : p // 16 * 16 + 16]
            proofs[k].append(("".join(own[: p % 16]), "".join(own[p % 16 + 1 :])))
            at[k] = p // 16
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], proofs


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: tree([leaf(*r) for r in groups[s]]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, proof in zip(groups[s], trees[s][1]):
            proof = proof + upper[k]
            h = leaf(*r[:3], lower(r[3])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(*r)
            for a, b in proof:
                h = sha(a + h + b)
            out.append((r[0], leaf(*r), trees[s][0], root, sha("".join(a + b for a, b in proof)), h, h == root))
    return sorted(out, key=str)


ODD = [(None, None, None, None), (None, None, "en", ""), (7, "a", "en", "Twice THE same"), (7, "a", "en", "Twice THE same"), (7, "a", "de", None), (8, "", "en", "Été À LA"), (9, "lone", None, "Word " * 30_000)]


@pytest.mark.parametrize("size", [0, 1, 16, 17, 700])
def test_manifest_against_a_plain_tree(spark, size, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rng = random.Random(size)
    rows = [(rng.randrange(3 * size), rng.choice(["hot", "hot", "é", f"s{rng.randrange(40)}"]), "en", f"Text {rng.randrange(size)}") for _ in range(size)] + (ODD if size > 16 else [])
    docs = table(spark, rows)
    altered = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = merkle.manifest(docs, also={"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, altered)})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    got = [(r[0], r[1], r[2], found.root, r[3], r[4], r[4] == found.root) for r in found.rows.select("doc_id", "leaf", "subroot", merkle.proof_digest(F.col("proof")), folded).collect()]
    assert sorted(got, key=str) == (plain_manifest(rows) if rows else [])
    assert found.root is not None or not rows
    if size == 700:
        assert {x[-1] for x in got} == {True, False}


def plain_contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t) or "")
    windows = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(named)))
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 22), (2, 300), (3, 40)])
def test_contamination_against_brute_force(spark, seed, block, monkeypatch):
    """Few different words, so that windows, long and short, meet, overlap and repeat; the benchmark in one block or many."""
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(contamination, "PIECE_WORDS", 4)
    monkeypatch.setattr(contamination, "LANE", 16)
    rng = random.Random(seed)
    text = lambda n: rng.choice(["", " ", "- "]) + rng.choice([" ", ", ", ".\n"]).join(rng.choice(["One", "two", "ÉTÉ", "x1", "no"][: 2 + seed]) for _ in range(n))
    items = [(i % 7, text(rng.choice([0, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(None, text(12)), (50, None), (51, "..."), (52, "rare"), (53, "never met at all")]
    texts = [text(rng.randrange(60)) for _ in range(60)] + [None, "", "!", "rare", items[6][1], (items[6][1] or "") + " and " + (items[12][1] or ""), "pad " * 3_000 + (items[12][1] or "")]
    docs = table(spark, [(i, "s", "en", t) for i, t in enumerate(texts)] + [(0, "s", "en", texts[0])])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"piece": F.lit(1), "item": F.lit("z")})
    rows = contamination.find(docs, benchmark).collect()
    want = plain_contamination(texts, items)
    assert sorted((r.doc_id, r.n_words, sum(x.stop - x.start for x in r["spans"]), r["items"]) for r in rows) == sorted((i, *want[i]) for i in [*range(len(texts)), 0])
    assert contamination.find(docs.where("false"), benchmark).count() == 0
    none = contamination.find(docs, benchmark.where("false")).collect()
    assert all(not r["spans"] and not r["items"] for r in none) and len(none) == len(rows)


def test_contamination_takes_passages_out(spark):
    docs = table(spark, [(1, "s", "en", "Before: one two three four five six seven eight nine ten. After."), (2, "s", "en", None), (3, "s", "en", "clean")])
    benchmark = spark.createDataFrame([(1, "One two, three four five six seven eight nine TEN")], "item_id bigint, text string")
    found = contamination.find(docs, benchmark)
    out = contamination.remove(docs.join(found.select("doc_id", "spans"), "doc_id"), "text")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before: . After.", 2: None, 3: "clean"}


def test_shifts_never_pass_an_occurrence():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(6)]
    windows = [" ".join(rng.choice(words, 4)).encode() for _ in range(5)]
    t = contamination.Tables(4, sorted(set(windows)), [[0]] * len(set(windows)))
    text = list(rng.choice(words, 4_000))
    raw = np.frombuffer(" ".join(text).encode(), np.uint8)
    first, last = contamination.shared.word_bounds(raw, np.array([0, len(raw)]), contamination.BREAKS)
    hashes = contamination.shared.bound_hashes(raw, first, last)
    got = {(e, t.windows[w]) for e, w in t.occurrences(hashes, np.array([0]), lambda a, b, w: raw[first[a] : last[b]].tobytes() == w)}
    assert got == {(e, " ".join(text[e - 3 : e + 1]).encode()) for e in range(3, 4_000) if " ".join(text[e - 3 : e + 1]).encode() in windows}


def plain_phrases(rows, least, keep, top):
    f, n = collections.Counter(), collections.Counter()
    for _, _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text) or ""):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for k in range(len(w) - size + 1):
                    f[lang, tuple(w[k : k + size])] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= keep * a and any(v[k : k + len(w)] == w for k in range(len(v))) for (g, v), b in found.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])]


@pytest.mark.parametrize(("least", "shard", "base"), [(3, 2_000_000, 64), (2, 7, 2), (130, 50, 3)])
def test_collocations_against_brute_force(spark, least, shard, base, monkeypatch):
    """One shard and many, codes of one character and of several, a threshold above the cap."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "BASE", base)
    monkeypatch.setattr(collocations, "TOKENS", 5)
    monkeypatch.setattr(collocations, "FLUSH", 300)
    rng = random.Random(least)
    words = ["New", "York", "city", "été", "of", "a", "x\x1cy", "the"]
    rows = [(i, "s", rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words[: rng.randrange(2, 9)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(40 if least < 100 else 160)))) for i in range(90)]
    rows += [(1, "s", "en", None), (1, "s", "en", ""), (2, "s", "fr", "a " * 2_000), (2, "s", "fr", "a " * 2_000), (3, "s", None, "!!!")]
    got = [tuple(r) for r in collocations.mine(table(spark, rows), top=20, least=least, keep=80).collect()]
    assert sorted(got) == sorted(plain_phrases(rows, least, 80, 20)) and got
    assert collocations.mine(table(spark, rows).where("false")).count() == 0


def test_all_queries_are_registered():
    """An import that fails inside the subpackage would leave its queries out without a word."""
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}) == list(range(1, 14)) and "pipeline" in names
    assert {"op1_sharding", "op2_topk", "op4_mixing", "op11_merkle", "op12_collocations", "op13_contamination"} <= set(sql) and set(sql) <= set(names)
