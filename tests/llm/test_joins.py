"""Similarity joins, language ID and components against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import cross_polytope, jaccard_join, langid
from quarry.llm.common import bucket_of, connected_components, id_cuts
from quarry.llm.shingles import shingle_sets
from tests.llm.llm_fixtures import frame, odd_rows


def roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text, size):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent):
    sets = [shingles(t, size) for _, t, *_ in rows]
    key = [(i is None, i or 0, k) for k, (i, *_) in enumerate(rows)]
    links = [(key[a], key[b]) for a in range(len(rows)) for b in range(a)
             if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] and sets[b]]
    found = roots(key, links)
    return Counter((r[0], len(s), None if found[k][0] else found[k][1]) for r, s, k in zip(rows, sets, key))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(spark, size, percent):
    rows = odd_rows(seed=7)
    got = Counter(map(tuple, jaccard_join.jaccard_components(frame(spark, rows), size, percent).collect()))
    assert got == brute_components(rows, size, percent)


def test_jaccard_large_groups_in_blocks(spark, monkeypatch):
    """Near copies beyond the pair limit and the block size."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 3000)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, len(w))] = f"n{rng.integers(0, 50)}"
        rows.append((i, " ".join(w[:len(w) - rng.integers(0, 20)]), None, None))
    rows += [(500 + i, " ".join(f"u{x}" for x in rng.integers(0, 10_000, 40)), None, None) for i in range(60)]
    got = Counter(map(tuple, jaccard_join.jaccard_components(frame(spark, rows), 4, 85).collect()))
    assert got == brute_components(rows, 4, 85)


def test_jaccard_keeps_one_of_each_group(spark):
    rows = odd_rows(seed=8)
    docs = frame(spark, rows)
    out = jaccard_join.keep_one(docs, 5, 80)
    assert out.columns == docs.columns
    sets = [shingles(t, 5) for _, t, *_ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    empty = Counter((i, t or "") for (i, t, *_), s in zip(rows, sets) if not s)
    groups = len({r for k, r in roots(range(len(rows)), links).items() if sets[k]})
    assert out.count() == groups + len(empty)
    assert jaccard_join.keep_one(frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_shingle_sets_match_words():
    texts = [t or "" for _, t, *_ in odd_rows()]
    for size in (1, 4, 5):
        assert [len(s) for s in shingle_sets([t.encode() for t in texts], size)] == [len(shingles(t, size)) for t in texts]
    a, b = shingle_sets([b"A b c d", b"a  B\tc\nd"], 4)
    assert np.array_equal(a, b)


def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, (x[5] + rng.normal(size=24) * 0.2).tolist()) for i in range(80)]
    rows += [(2000 + i, (x[i % 40] * 3 + rng.normal(size=24) * 0.35).tolist()) for i in range(120)]
    rows += [(3000 + i, x[7].tolist()) for i in range(25)] + [(3000, x[7].tolist())]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 24), (4003, [float("nan")] * 24), (4004, [float("inf")] + [1.0] * 23),
             (4005, [None] + [1.0] * 23), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (None, x[7].tolist()), (4008, [1e-200] * 24), (4009, [1e200] * 24)]
    return rows, spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], "vec_id bigint, embedding array<double>, label int, sig string, k int")


def brute_vectors(rows, least):
    def ok(v):
        return v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
    unit = [np.array(v) / np.abs(v).max() if ok(v) else None for _, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    degree = Counter(x for p in links for x in p)
    key = [(i is None, i or 0, k) for k, (i, _) in enumerate(rows)]
    root = roots(key, [(key[a], key[b]) for a, b in links])
    return Counter((rows[k][0], degree[k], None if root[key[k]][0] else root[key[k]][1]) for k in range(len(rows)))


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 16)
    rows, df = vectors(spark)
    out = cross_polytope.near_vectors(df, 0.9)
    want = brute_vectors(rows, 0.9)
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in out.collect())
    links = lambda c: sum(n * k[1] for k, n in c.items())
    assert links(got) <= links(want) and links(got) >= 0.98 * links(want)
    assert sum((got - want).values()) <= 0.03 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is r.component_id) for r in out.collect())
    assert cross_polytope.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2_000, 100_000])
def test_recall_at_the_threshold(n):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    functions, tables = cross_polytope.plan(n, 64)
    sa, sb = (cross_polytope.signatures(x, functions, tables) for x in (a, b))
    met = (sa[:, :, :1] == sb).any((1, 2)) | (sb[:, :, :1] == sa).any((1, 2))
    assert met.mean() >= 0.99


@pytest.mark.parametrize("n,dim", [(30_000_000, 64), (30_000_000, 384), (100_000, 1024), (30_000_000, 1024)])
def test_recall_of_long_vectors_and_many_hashes(n, dim):
    rng = np.random.default_rng(21)
    a, b = rng.normal(size=(2, 400, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    functions, tables = cross_polytope.plan(n, dim)
    sa, sb = (cross_polytope.signatures(x, functions, tables) for x in (a, b))
    assert ((sa[:, :, :1] == sb) | (sb[:, :, :1] == sa)).any((1, 2)).mean() > 0.98


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = cross_polytope.hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(cross_polytope.hadamard(y), x)


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 950)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {x: r for x, r in want.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_id_buckets_follow_the_order(spark):
    df = spark.createDataFrame([(i * i % 7919,) for i in range(3000)] + [(None,), (5,), (5,)], "doc_id bigint")
    cuts = id_cuts(df, "doc_id", 40)
    got = df.select("doc_id", bucket_of(F.coalesce("doc_id", F.lit(-(1 << 63))), cuts).alias("b")).collect()
    assert all(r.b == sum(c <= (r.doc_id if r.doc_id is not None else -(1 << 63)) for c in cuts) for r in got)
    assert max(Counter(r.b for r in got).values()) < 200


def language_rows():
    rng = np.random.default_rng(5)
    parts = {"en": "the of and ing ion er th wh ou sh".split(), "fr": "le la que eau eux é è oi tre ment".split(),
             "de": "der die und ein sch ch ö ü ß keit".split(), "es": "el los que ción ado ñ ó as mi ar".split()}
    rows = []
    for i in range(600):
        lang = list(parts)[i % 4]
        text = " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(rng.integers(8, 80)))
        rows.append((i, text, lang if i % 11 else None, "s"))
    return rows


def test_language_id_on_held_out_rows(spark):
    rows = language_rows()
    odd = [(2000, None, "en", "s"), (2001, "", "fr", "s"), (2002, "123 !!", "de", None), (None, rows[4][1], None, None), rows[8], (2003, rows[1][1] * 400, None, "s")]
    out = langid.held_out_languages(frame(spark, rows + odd)).collect()
    assert len(out) == len(rows) + len(odd)
    want = {i: ["en", "fr", "de", "es"][i % 4] for i in range(600)}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    tested = [r for r in out if r.doc_id in want and r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in tested]) > 0.97
    by = {r.doc_id: r.lang_pred for r in out}
    assert by[2000] == by[2001] == by[2002] == langid.UNKNOWN and by[2003] == "fr" and by[None] == "en"


def test_language_id_reads_no_label(spark):
    rows = language_rows()
    docs = frame(spark, rows)
    model = langid.fit(docs.select("lang", "text"))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    got = [{r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, model).collect()} for d in (docs, other)]
    assert got[0] == got[1]


def test_language_id_with_few_languages(spark):
    docs = frame(spark, [(1, "some words", "en", None), (2, None, "en", None)])
    model = langid.fit(docs.select("lang", "text"))
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, model).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0)]
    assert langid.fit(docs.where("false").select("lang", "text")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("stray", [["Dobrý den"], ["Dobrý den, jak se máte?", "la", "日本語"], ["copy"]])
def test_rare_labels_leave_the_others_alone(spark, stray):
    rows = language_rows()
    texts = [rows[1][1] if t == "copy" else t for t in stray]     # a wrong label on a text of another language
    docs = frame(spark, rows)
    learn = frame(spark, rows + [(900 + k, t, f"x{k}", "s") for k, t in enumerate(texts)])
    want = {i: ["en", "fr", "de", "es"][i % 4] for i in range(600)}
    out = langid.identify(docs, langid.fit(learn.select("lang", "text"))).collect()
    assert sum(r.ambiguous for r in out) <= 3
    assert np.mean([r.lang_pred == want[r.doc_id] for r in out]) > 0.99


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords(n):
    code = langid.codewords(n)
    assert len(np.unique(code, axis=0)) == n and (abs(code.sum(0)) < n).all()
