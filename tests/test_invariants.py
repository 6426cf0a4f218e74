"""Invariants of splits, ids, tries and ordering helpers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators import split, trie
from quarry.operators.order import global_row_number
from quarry.sources.tables import read_table


def test_shares_guard():
    with pytest.raises(ValueError):
        split.check_shares(0.8, 0.2, 0.2)
    with pytest.raises(ValueError):
        split.check_shares(0.5, 0.1, 0.1)
    split.check_shares(0.8, 0.1, 0.1 - 1e-12)
    split.check_shares(0.88, 0.05, 0.05)


def test_all_rows_in_train(spark):
    d = spark.range(20).withColumnRenamed("id", "doc_id")
    for s in (split.split_exact(d, "doc_id", 42, 1.0, 0.0, 0.0), split.split_bucket(d, split.seeded_key(42, "doc_id"), 1.0, 0.0, 0.0)):
        assert {r["split"] for r in s.collect()} == {"train"} and s.count() == 20


def test_quota_fill_guards(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "docid string")
    pref, pool, dev = ids("a", "b"), ids("a", "b", "c", "d", "e"), ids("d")
    got = {r["docid"]: r["priority"] for r in split.quota_fill(pref, pool, "docid", 10, exclude=dev).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "e": 1}
    assert split.quota_fill(pref, pool, "docid", 10, allow_duplicates=True).count() == 7
    assert split.quota_fill(pref, pool, "docid", 3).count() == 3


def test_shards_of_inference(spark):
    s = split.shard_contiguous(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", 4)
    assert [r["count"] for r in s.groupBy("shard").count().orderBy("shard").collect()] == [2, 2, 2, 4]


def test_exact_split_disjoint_complete(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id")
    s = split.split_exact(d, "doc_id")
    assert s.count() == d.count() == s.select("doc_id").distinct().count()
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    n = d.count()
    assert sizes["train"] == int(n * 0.8 + 1e-9)
    assert sum(sizes.values()) == n


def test_bucket_split_by_doc_keeps_views_together(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id")
    views = d.select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("view"))
    s = split.split_bucket(views, split.seeded_key(42, "doc_id") if hasattr(split, "seeded_key")
                           else F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))))
    per_doc = s.groupBy("doc_id").agg(F.countDistinct("split").alias("k"))
    assert per_doc.where("k > 1").count() == 0


def test_dense_ids_are_permutation(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id")
    ids = split.dense_ids(d, "doc_id")
    n = d.count()
    got = sorted(r[0] for r in ids.select("rand_id").collect())
    assert got == list(range(n))


def test_global_row_number_matches_window(spark):
    d = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    a = global_row_number(d, ["k", "id"], partitions=7)
    b = d.withColumn("rn", F.row_number().over(Window.orderBy("k", "id")))
    assert a.exceptAll(b.select(a.columns)).count() == 0


def test_trie_leaves_and_prefixes_cover_inputs(spark):
    ids = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a d"), (4, "a b c")],
                                "doc_id long, docid string")
    seqs = trie.sequences(ids, eos=False)
    leaves = {r[0] for r in trie.leaves(seqs).collect()}
    assert leaves == {"a b c", "a d"}          # "a b" is a proper prefix, not a leaf
    assert trie.trie_len(seqs) == 4             # repeats counted
    edges = trie.edges(trie.sequences(ids))
    root = {r["token"] for r in edges.where("prefix = ''").collect()}
    assert root == {"a"}
    nxt = {r["next_token"] for r in trie.lookup(edges, spark.createDataFrame([("a b",)], "prefix string")).collect()}
    assert nxt == {"c", "</s>"}
    unknown = trie.lookup(edges, spark.createDataFrame([("zz",)], "prefix string")).collect()
    assert len(unknown) == 1 and unknown[0]["next_token"] is None


def test_trie_fallback(spark):
    a = trie.edges(trie.sequences(spark.createDataFrame([(1, "x y")], "doc_id long, docid string"), bos=True))
    b = trie.edges(trie.sequences(spark.createDataFrame([(2, "p q"), (3, "y z")], "doc_id long, docid string")))
    probes = spark.createDataFrame([("",), ("<s>",), ("<s> x",), ("y",), ("<s> x q",)], "prefix string")
    got = {}
    for r in trie.lookup_with_fallback(a, b, probes).collect():
        got.setdefault(r["prefix"], set()).add(r["next_token"])
    assert got[""] == {"p", "y"}                 # bos replaced by the second trie's roots
    assert got["<s>"] == {"x"}
    assert got["<s> x"] == {"y"}
    assert got["y"] == {"z"}                     # miss at depth 0 -> second trie
    assert got["<s> x q"] == {None}              # suffix 'q' unknown in the second trie


def test_consecutive_blocks_match_plain_lead(spark):
    from quarry.operators.textrank import consecutive
    rows = [(d, p, f"t{(p * 7 + d) % 5}") for d in range(3) for p in range(0, 40, 1 + d) if (p + d) % 6]
    t = spark.createDataFrame(rows, "doc_id long, p long, term string")
    got = consecutive(t, block=4)
    w = Window.partitionBy("doc_id").orderBy("p")
    want = (t.select("doc_id", "term", F.lead("term").over(w).alias("nxt"))
            .where(F.col("nxt").isNotNull() & (F.col("term") != F.col("nxt"))))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
