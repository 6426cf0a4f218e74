"""FM-index decontamination against plain Python, on small shards and blocks."""

import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import fm_index

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(texts, items, window=10):
    """[(words, hit, sorted item ids, hit flags)]"""
    owners = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        for a in range(max(1, len(w) - window + 1)) if w else ():
            owners.setdefault(tuple(w[a:a + window]), set()).add(name)
    out = []
    for text in texts:
        w = WORD.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in owners}:
            for a in range(len(w) - n + 1):
                if names := owners.get(tuple(w[a:a + n])):
                    found |= names
                    hit[a:a + n] = [True] * n
        out.append((len(w), sum(hit), sorted(found), hit))
    return out


def sample(seed):
    rng = random.Random(seed)
    v = ["a", "B", "c1", "é", "zz"][:rng.randint(1, 5)]
    items = [(str(i), " ".join(rng.choice(v) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 12])))) for i in range(rng.randint(0, 6))]
    texts = [" ".join(rng.choice([*v, "x", "y"]) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(30)]
    return rng, items, texts + [texts[-1]] * 5


@pytest.mark.parametrize("seed", range(40))
def test_scan_equals_plain(seed, monkeypatch):
    rng, items, texts = sample(seed)
    monkeypatch.setattr(fm_index, "GROUP_BYTES", rng.choice([10, 200, 1 << 20]))
    window = rng.choice([2, 3, 10])
    p = fm_index.phrases([(n, t.encode()) for n, t in items], window)
    got = [(f.words, f.hit, sorted({p.names[i] for k in f.windows for i in p.items[p.first[k]:p.first[k + 1]]}))
           for f in fm_index.scan((t.encode() for t in texts), p, rng.choice([1, 30, 500, 1 << 20]))]
    assert got == [x[:3] for x in plain(texts, items, window)]


@pytest.mark.parametrize("seed", range(10))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    t = np.r_[rng.integers(0, 4, 300), [1, 2, 3] * 20, 0].astype(np.int32)
    index = fm_index.FMIndex(t, 3)
    for n in (1, 2, 3, 7):
        words = np.array([1, 2, 3] * 3, np.int32)
        low, high = index.search(words, np.array([0, 1, 2]), np.full(3, n))
        for k in range(3):
            want = [a for a in range(len(t) - n) if (t[a:a + n] == words[k:k + n]).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then sleeps well"), (2, "short item"), (30, "the quick brown fox jumps over the lazy dog and"),
         (4, None), (5, "..."), (6, "naïve café 日本語"), (None, "no id here"), (7, "short item")]


def odd_docs():
    body = "Words before. THE quick-brown fox, jumps over the lazy dog and then naps. " * 3
    return [(1, body), (2, None), (3, ""), (4, "a short item stands here"), (5, "short\nitem"), (6, "über naïve café 日本語!"), (7, "!!! ..."),
            (8, "quick brown fox jumps over the lazy dog and then sleeps well"), (8, "quick brown fox jumps over the lazy dog and then sleeps well"),
            (9, "nothing to see " * 4000 + "short item " + "tail " * 3000), (None, "no id here, no id here"), (10, "ashort item")]


def frames(spark, docs=None, items=None):
    docs = odd_docs() if docs is None else docs
    items = ITEMS if items is None else items
    d = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id bigint, text string, spans string, items int, digest string")
    return d, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block", [fm_index.BLOCK_WORDS, 8])
def test_contaminated_on_odd_rows(spark, block):
    docs, items = frames(spark)
    got = sorted((tuple(r) for r in fm_index.contaminated(docs, items, block_words=block, shard_words=64).collect()), key=str)
    want = []
    for (i, _), (n, hit, names, _) in zip(odd_docs(), plain([t for _, t in odd_docs()], [("" if a is None else str(a), t) for a, t in ITEMS])):
        want.append((i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("block", [fm_index.BLOCK_WORDS, 8])
def test_spans_are_cut_out(spark, block):
    docs, items = frames(spark)
    out = fm_index.without_spans(docs, items, block_words=block)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["spans"], r["items"]) for r in out.collect()), key=str)
    named = [("" if a is None else str(a), t) for a, t in ITEMS]
    want = []
    for (i, t), (*_, flags) in zip(odd_docs(), plain([t for _, t in odd_docs()], named)):
        if any(flags):
            places = [m.span() for m in WORD.finditer(lower(t))]
            runs = [k for k in range(len(flags)) if flags[k]]
            drop = set()
            for k in runs:
                end = places[k + 1][0] if k + 1 in runs else places[k][1]
                drop |= set(range(places[k][0], end))
            t = "".join(c for k, c in enumerate(t) if k not in drop)
        want.append((i, t, "x", 1))
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert fm_index.contaminated(docs.limit(0), items).collect() == []
    rows = fm_index.contaminated(docs, items.limit(0)).collect()
    assert len(rows) == len(odd_docs()) and not any(r["contaminated"] or r["n_items"] for r in rows)
    assert {r["items_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
