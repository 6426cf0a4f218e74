"""The document-local TextRank equals the shuffled form and needs no Exchange."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.functions import text as tx
from quarry.operators import textrank as tr
from quarry.operators import textrank_local as local
from quarry.plans import prepared
from test_plans import plan


def odd_docs():
    rng = random.Random(3)
    names = "river stone mountain road town number the and a of café 42 people walk meets über".split()
    text = lambda n: "".join(rng.choice(names).title() + rng.choice([" ", " ", " ", ". ", "! ", "\n", ", "]) for _ in range(n))
    rows = [(i, rng.choice(["en", "fr", "xx", None]), text(rng.choice([0, 1, 3, 20, 200]))) for i in range(60)]
    rows += [(100, "en", None), (101, "en", ""), (102, "en", "the and of."), (103, "en", "...!?\n\n"), (104, "en", "Same words here. " * 50),
             (105, "en", "one. two. three."), (106, "en", "stone stone stone stone"), (107, "en", text(5000))]
    return rows


def shuffled(spark, docs, iterations):
    stops = tr.stop_terms(spark)
    nodes, occ = tr.sentence_nodes(docs, stops)
    s = {r["doc_id"]: r["summary"] for r in tr.summarize(nodes, tr.sentence_rank(nodes, occ, iterations)).collect()}
    k = {r["doc_id"]: r["keywords"] for r in tr.keywords(tr.keyword_rank(docs, stops, iterations=iterations)).collect()}
    return s, k


def test_local_equals_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame(odd_docs(), "doc_id long, lang string, text string")
    s, k = shuffled(spark, docs, 3)
    for giant in (local.GIANT_CHARS, 500):              # all local; long documents shuffled
        got = local.summaries_and_keywords(docs, F.col("text"), "doc_id", 3, giant_chars=giant)
        rows = {r["doc_id"]: (r["summary"], r["keywords"]) for r in got.collect()}
        assert rows == {i: (s.get(i, ""), k.get(i, "")) for i, *_ in odd_docs()}


def test_groups_of_documents_change_nothing(spark):
    import pyarrow as pa
    docs = [t for _, _, t in odd_docs()]
    tokens = pa.array([[s.lower().split() for s in (t or "").split(".")] for t in docs], pa.list_(pa.list_(pa.string())))
    words = [[len(s) for s in d] for d in tokens.to_pylist()]
    langs = [lang for _, lang, _ in odd_docs()]
    stops = local.Stops([("en", "the"), ("fr", "a")])
    whole = local.rank_group(tokens, words, langs, stops, 4, 0.85, 15, 8)
    for most in (1, 50, 10_000):
        parts = list(local.groups(tokens, most))
        assert [a for a, _ in parts] == [0, *[z for _, z in parts[:-1]]] and parts[-1][1] == len(docs)
        got = [x for a, z in parts for x in local.rank_group(tokens.slice(a, z - a), words[a:z], langs[a:z], stops, 4, 0.85, 15, 8)]
        assert got == whole


def test_no_exchange(spark):
    corpus = prepared.fixtures.corpus(spark, SF_SMALL)
    p = plan(local.summaries_and_keywords(corpus, tx.compose_textrank_input("subject", "body_clean"), "mid"))
    assert "Exchange" not in p and p.count("ArrowEvalPython") >= 1 and "Join" not in p


def test_groups_are_small_and_sentences_cut_once(spark):
    """The arrays of a group stay small, and a summary's sentences are taken in
    one pass: the plan cuts the text for tokens, word counts and the summary."""
    tokens = pa.array([[["a"] * 1000] * 10] * 40)
    runs = list(local.groups(tokens, local.GROUP_TOKENS))
    assert [a for a, _ in runs] == [0] + [z for _, z in runs[:-1]] and runs[-1][1] == 40
    assert max(z - a for a, z in runs) * 10_000 <= 1 << 17
    x = np.array([3, 1, 3, 0, 1])
    assert local.distinct(x).tolist() == [0, 1, 3] and local.distinct(x[:0]).tolist() == []
    docs = spark.createDataFrame([(1, "en", "One cat sat. Two cats ran. One dog ran.")], "doc_id long, lang string, text string")
    assert "get(transform(" not in plan(local.ranked(docs, F.col("text")))
