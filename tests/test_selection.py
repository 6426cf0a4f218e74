"""Seeded selection: exact cuts without a global sort, draws that agree."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import generate, order, split
from test_plans import plan


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def ids(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(5)


def seeded_order(n, seed):
    return sorted(range(n), key=lambda i: (md5(f"{seed}:{i}"), i))


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("cuts", [[0], [1], [37, 38], [100, 400], [500], [499, 500]])
def test_parts_equal_the_sorted_order(spark, monkeypatch, digits, cuts):
    monkeypatch.setattr(order, "BUCKET_DIGITS", digits)
    place = {i: k for k, i in enumerate(seeded_order(500, 7))}
    got = {r["doc_id"]: r["part"] for r in order.seeded_parts(ids(spark, 500), "doc_id", cuts, 7).collect()}
    assert got == {i: sum(k >= c for c in cuts) for i, k in place.items()}


def test_rank_equals_the_sorted_order(spark):
    want = {i: k + 1 for k, i in enumerate(seeded_order(500, 7))}
    assert {r["doc_id"]: r["r"] for r in order.seeded_rank(ids(spark, 500), "doc_id", 7, "r").collect()} == want
    ranks = {r["doc_id"]: r["sample_rank"] for r in split.seeded_sample(ids(spark, 500), "doc_id", 60, 7).collect()}
    assert ranks == {i: k for i, k in want.items() if k <= 60}


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(i,) for i in [1] * 40 + [2] * 3 + [None] * 5 + list(range(10, 30))], "doc_id long")
    for cut in (0, 3, 5, 17, 44, 68, 100):
        got = order.seeded_parts(rows, "doc_id", [cut], 3).collect()
        assert len(got) == 68 and sum(r["part"] == 0 for r in got) == min(cut, 68)
    ranks = order.seeded_rank(rows, "doc_id", 3, "r").collect()
    assert sorted(r["r"] for r in ranks) == list(range(1, 69))
    assert Counter(r["doc_id"] for r in ranks)[None] == 5
    assert split.dense_ids(rows.limit(0), "doc_id").collect() == []
    assert split.split_exact(rows.limit(0), "doc_id").collect() == []


def test_no_range_exchange_and_no_text_moves(spark):
    d = ids(spark, 2000)
    for df in (split.split_exact(d, "doc_id"), split.dense_ids(d, "doc_id"), split.seeded_sample(d, "doc_id", 700),
               split.quota_fill(d.where("doc_id % 3 = 0"), d, "doc_id", 900)):
        p = plan(df)
        assert "rangepartitioning" not in p and "Sort [_k" not in p.split("(1)")[0]


def test_draws_follow_the_formula_and_repeat(spark):
    docs = spark.createDataFrame([(i, f"alpha beta {i}. gamma. delta epsilon zeta. alpha alpha.") for i in range(20)] + [(50, None), (51, "")],
                                 "doc_id long, text string")
    stats = spark.createDataFrame([(t, float(k) / 3) for k, t in enumerate("alpha beta gamma delta epsilon zeta".split())]
                                  + [(str(i), 2.0) for i in range(20)], "term string, idf double")
    none = spark.createDataFrame([], "term string, is_hot boolean")
    idf = {r["term"]: r["idf"] for r in stats.collect()}
    got = {(r["doc_id"], r["q_rank"]): r["query"] for r in generate.sampled_queries(docs, stats, none, n=2, top_k=3).collect()}
    for i in range(20):
        sents = [["alpha", "beta", str(i)], ["gamma"], ["delta", "epsilon", "zeta"], ["alpha", "alpha"]]
        score = [round(sum(idf[t] for t in s) / len(s), 6) for s in sents]
        best = sorted(range(4), key=lambda k: (-score[k], k))[:3]
        u = {k: (int(md5(f"313:{i}:{k}")[:13], 16) + 0.5) / 2 ** 52 for k in best}
        drawn = sorted(best, key=lambda k: (-round(score[k] - math.log(-math.log(u[k])), 6), k))[:2]
        assert [got[i, 1], got[i, 2]] == [" ".join(sents[k]) for k in drawn]
    assert len(got) == 40
    again = {(r["doc_id"], r["q_rank"]): r["query"] for r in generate.sampled_queries(docs.repartition(7), stats, none, n=2, top_k=3).collect()}
    assert again == got


def test_draws_are_in_proportion(spark):
    """One draw of two equally likely sentences: about half each."""
    docs = spark.createDataFrame([(i, "one. two.") for i in range(2000)], "doc_id long, text string")
    stats = spark.createDataFrame([("one", 1.0), ("two", 1.0)], "term string, idf double")
    none = spark.createDataFrame([], "term string, is_hot boolean")
    n = generate.sampled_queries(docs, stats, none).where("query = 'one'").count()
    assert 900 < n < 1100
