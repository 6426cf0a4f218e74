"""Ordered shards, multi-file reads, versioned tables, run log, batched
scorer, positions, limits and scratch tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import batch_scorer, phrases, rerank, trie
from quarry.operators.index import build_index, index_tasks
from quarry.plans import run_log
from quarry.session import scratch_path
from quarry.sources import io
from test_plans import plan


def test_ordered_shards_restore_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(13)
    for shards in (1, 7, 1500):
        path = scratch_path(spark, "ordered-test")
        io.write_ordered(rows, ["k"], path, shards)
        back = io.read_ordered(spark, path, rows.schema)
        assert {r["k"]: r["rank"] for r in back.collect()} == {k: k + 1 for k in range(1000)}
        sizes = back.groupBy("shard").count().collect()
        assert len(sizes) == min(shards, 1000) and max(r["count"] for r in sizes) == -(-1000 // shards)
        files = spark.read.parquet(path).select("shard", "_metadata.file_name").distinct()
        assert files.count() == len(sizes)
    assert "rangepartitioning" not in plan(back) and "SortMergeJoin" not in plan(back)
    path = scratch_path(spark, "ordered-test")
    io.write_ordered(rows.limit(0), ["k"], path, 3)
    assert io.read_ordered(spark, path, rows.schema).count() == 0


def test_many_files_are_one_scan(spark):
    rec = spark.createDataFrame([(i, f"q{i}", [("t", "x")] if i % 3 else [], [], f"s{i % 4}") for i in range(100)],
                                f"doc_id long, question string, positive_ctxs {io.CTX.simpleString()}, hard_negative_ctxs {io.CTX.simpleString()}, source string")
    path = scratch_path(spark, "many")
    rec.write.partitionBy("source").json(path)
    paths = [f"{path}/source=s{k}" for k in (2, 0, 3, 1)]
    merged = io.read_multi_source(spark, paths, samples=5, merge=True)
    p = plan(merged[0])
    assert len(merged) == 1 and p.split("(1)")[0].count("Scan json") == 1 and "WindowGroupLimit" in p
    want = {k: [i for i in range(100) if i % 3 and i % 4 == k][:5] for k in range(4)}
    assert sorted(r["doc_id"] for r in merged[0].collect()) == sorted(x for v in want.values() for x in v)
    frames = io.read_multi_source(spark, paths, samples=5)
    assert [sorted(r["doc_id"] for r in f.collect()) for f in frames] == [want[k] for k in range(4)]
    every = io.read_multi_source(spark, [f"{path}/source=*/*.json"], per="file", merge=True)[0]
    assert every.count() == 66 and io.RANKER_SCHEMA.names == every.columns


def test_versions_replace_whole_tables(spark):
    table = scratch_path(spark, "versions")
    assert io.read_version(spark, table, io.RESULT_SCHEMA).count() == 0
    row = ("BM25", "10", "base", "v1")
    for k in range(4):
        up = spark.createDataFrame([(*row, float(k), 0.0, 0.0, 0.0, 0), (*row, -1.0, 0.0, 0.0, 0.0, -1), ("x", str(k), "b", "v", 1.0, 1.0, 1.0, 1.0, 0)],
                                   "system string, size string, experiment_type string, version string, mrr_3 double, mrr_20 double, hits_1 double, hits_10 double, seq int")
        got = io.upsert_table(spark, table, up)
        assert io.versions(spark, table) == list(range(max(0, k - 1), k + 1))
        assert got.count() == k + 2 and got.where("system = 'BM25'").first()["mrr_3"] == float(k)


def test_run_log_upserts_by_run_and_job(spark):
    ranks = spark.createDataFrame([(i, i % 3 or None) for i in range(70)], "query_id long, rank int")
    jobs = {"a": lambda: ranks, "b": lambda: ranks.where("query_id < 35")}
    for _ in range(2):                                  # the same run again: its records are replaced
        got = {r["job"]: r for r in run_log.logged(spark, jobs, 35, run="fixed").collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["n_rows"], got["a"]["n_found"], got["a"]["batches"], got["a"]["final_epoch"]) == (70, 46, 3, 2.0)
    assert (got["b"]["n_rows"], got["b"]["batches"], got["b"]["final_epoch"]) == (35, 2, 1.0)
    assert got["a"]["duration_s"] > 0


def test_batches_are_padded_and_bounded(spark):
    assert list(batch_scorer.batches_of([1, 1, 5, 5, 9, 100, 1], 3, 20)) == [(0, 3), (3, 5), (5, 6), (6, 7)]
    assert list(batch_scorer.batches_of([], 3, 20)) == []
    ids, mask = batch_scorer.padded([np.array([3, 4]), np.array([], np.int64), np.array([5])])
    assert ids.tolist() == [[3, 4], [0, 0], [5, 0]] and mask.sum(1).tolist() == [2, 0, 1]
    pairs = spark.createDataFrame([(i, "a b c", " ".join("abcdefgh"[:i % 9])) for i in range(200)] + [(500, None, "a"), (501, "a", None), (502, "", "")],
                                  "pair_id long, query string, context string")

    def positions(q, qm, c, cm):
        assert q.shape == qm.shape and c.shape == cm.shape and len(q) <= 16 and (len(q) == 1 or q.size + c.size <= 400)
        return qm.sum(1) * 1000.0 + cm.sum(1)
    got = {r["pair_id"]: r["score"] for r in batch_scorer.scored(pairs, ["pair_id"], positions, batch_size=16, batch_tokens=200).collect()}
    assert got == {**{i: 3000.0 + i % 9 for i in range(200)}, 500: 1.0, 501: 1000.0, 502: 0.0}
    cut = {r["pair_id"]: r["score"] for r in batch_scorer.scored(pairs, ["pair_id"], positions, max_length=2, batch_size=16, batch_tokens=200).collect()}
    assert cut[8] == 3002.0


def test_rerank_takes_a_scorer(spark):
    c = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "x"), (1, "b"), (2, "q")], "doc_id long, query string")
    p = spark.createDataFrame([(1, "a b c"), (2, "z")], "doc_id long, passage string")
    got = [(r["doc_id"], r["rank"], r["query"], r["score"]) for r in
           rerank.rerank(c, "doc_id", p, scorer=batch_scorer.coverage).orderBy("doc_id", "rank").collect()]
    assert got == [(1, 1, "a b", 1.0), (1, 2, "b", 1.0), (1, 3, "x", 0.0), (2, 1, "q", 0.0)]


def test_phrases_by_position(spark):
    docs = [(1, "the cat sat on the cat mat"), (2, "cat the sat"), (3, ""), (4, None), (5, "sat. On THE, cat!"), (6, "a a a a")]
    items = [(1, "the cat"), (2, "sat on the cat"), (3, "unknown word"), (4, ""), (5, None), (6, "cat"), (7, "a a"), (8, "the cat the")]
    index = phrases.build_positions(spark.createDataFrame(docs, "doc_id long, contents string"))
    got = {(r["item_id"], r["doc_id"]): (r["n_matches"], r["first_pos"]) for r in
           phrases.phrase_matches(index, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    cut = lambda t: __import__("re").findall(r"[a-z]+", (t or "").lower())
    for i, p in items:
        for d, t in docs:
            w, q = cut(t), cut(p)
            at = [k for k in range(len(w) - len(q) + 1) if q and w[k:k + len(q)] == q]
            if at:
                want[i, d] = (len(at), at[0])
    assert got == want
    p = plan(phrases.phrase_matches(index, spark.createDataFrame(items, "item_id long, text string")))
    assert "contents" not in p and "CartesianProduct" not in p


def test_index_tasks_grow_with_the_text(spark):
    """A task of the index gets a bounded text, whatever the session's number
    of partitions; the postings are the same."""
    docs = spark.createDataFrame([(i, "some word " * 10) for i in range(30)], "doc_id long, contents string")
    n = index_tasks(docs, "contents", 50)
    assert n == 60 and index_tasks(docs.where("false"), "contents") == 0
    dealt, plain = build_index(docs, tasks=n), build_index(docs)
    assert dealt.postings.rdd.getNumPartitions() == n
    assert sorted(dealt.postings.collect()) == sorted(plain.postings.collect())


def test_docids_are_cut_to_the_limit(spark):
    ids = spark.createDataFrame([(1, " ".join(map(str, range(200)))), (2, "a b")], "doc_id long, docid string")
    got = {r["doc_id"]: r["seq"] for r in trie.sequences(ids, bos=True).collect()}
    assert len(got[1]) == trie.MAX_TOKENS + 1 and got[1][0] == "<s>" and got[1][-1] == "</s>" and got[2] == ["<s>", "a", "b", "</s>"]
    assert len({r["doc_id"]: r["seq"] for r in trie.sequences(ids, eos=False).collect()}[1]) == trie.MAX_TOKENS


def test_scratch_tables_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch_root", lambda s: f"{session.ensure_checkpoint_dir(s)}/released")
    path = session.scratch_path(spark, "gone")
    spark.range(5).write.parquet(path)
    assert spark.read.parquet(path).count() == 5
    session.release_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_cluster_sessions_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {"spark.sql.warehouse.dir": "file:/data/warehouse"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
