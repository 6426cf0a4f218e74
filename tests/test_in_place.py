"""Work that is done where the rows are: term counts, the corpus, sums of
evidence, pieces of ordered shards."""

from pyspark.sql import functions as F

from quarry.operators import index, phrases, topk_join
from quarry.operators.index import analyze, build_index, document_terms, postings_of
from quarry.plans import prepared
from quarry.sources import io

DOCS = [(1, "b a b é\nZ a"), (2, ""), (3, None), (4, "one"), (None, "x y"), (None, "y y"), (None, "x"), (5, "a " * 30)]


def rows(df):
    return sorted((str(r) for r in df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(index, "BATCH_TOKENS", 5)
    analyzed = analyze(spark.createDataFrame(DOCS, "doc_id long, contents string").coalesce(1))
    assert "Exchange" not in plan(document_terms(analyzed, True))
    for positions in (False, True):
        want, got = postings_of(analyzed, positions), postings_of(analyzed, positions, distinct_ids=True)
        assert got.dtypes == want.dtypes and rows(got) == rows(want)
    docs = spark.createDataFrame(DOCS, "doc_id long, contents string")
    want, got = phrases.build_positions(docs), phrases.build_positions(docs, distinct_ids=True)
    assert rows(got.vectors) == rows(want.vectors) and rows(got.positions) == rows(want.positions) and rows(got.term_df) == rows(want.term_df)
    want, got = build_index(docs), build_index(docs, distinct_ids=True)
    assert rows(got.term_stats) == rows(want.term_stats) and rows(got.doc_stats) == rows(want.doc_stats)


def test_a_corpus_without_repeats_is_not_shuffled(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = [(1, "b"), (2, None), (None, "x"), (None, "x")]
    for name, extra in (("plain", []), ("twice", [(1, "a"), (1, "a")])):
        made = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in kept + extra], schema)
        made.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = prepared.corpus(spark, f"{tmp_path}/{name}")
        want = [(1, "a" if extra else "b"), (2, ""), (None, "x"), (None, "x")]
        assert sorted(map(str, want)) == sorted(str((r["mid"], r["body_clean"])) for r in got.collect())
        if not extra:
            assert "Exchange" not in plan(got)


def test_flat_lists_give_k_sums_each(spark, monkeypatch):
    """All sums tie: of 600 children only the first ``k`` leave a part, also
    where parts and groups are dealt out."""
    ev = spark.range(600).select(F.lit("r").alias("prefix"), F.format_string("w%04d", "id").alias("token"),
                                 F.explode(F.array(F.lit("s"), F.lit("t"))).alias("term"), F.lit(1).cast("bigint").alias("weight"))
    terms = spark.range(40).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("s"), F.lit("t"), F.lit("u"))).alias("term"))
    pairs = terms.select("query_id", F.lit("r").alias("prefix")).distinct()
    for groups, least in ((10_000, 10_000), (10, 10_000), (10, 200)):
        monkeypatch.setattr(topk_join, "TASK_GROUPS", groups)
        monkeypatch.setattr(topk_join, "LEAST_TOKENS", least)
        lists = topk_join.sorted_lists(ev)
        top = topk_join.top_sums(lists, pairs, terms, 20, topk_join.beats_after_rounding(1.0, 1))
        parts = lists.parts.first()["parts"]
        assert parts == (1 if least > 600 else 3) and top.hits.count() == 40 * 20 * parts
        first = top.hits.groupBy("query_id").agg(F.sort_array(F.collect_list("token")).alias("t"), F.min("ev").alias("a"), F.max("ev").alias("b"))
        assert all(r["t"][:20] == [f"w{i:04d}" for i in range(20)] and r["a"] == r["b"] == 2 for r in first.collect())
        assert {(r["ev_total"]) for r in top.totals.collect()} == {1200}


def test_a_shard_is_written_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "PIECE_ROWS", 10)
    docs = spark.range(95).select((94 - F.col("id")).alias("k"), F.col("id").cast("string").alias("t"))
    io.write_ordered(docs, ["k"], str(tmp_path / "o"), 3)
    sizes = spark.read.parquet(str(tmp_path / "o")).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 12 and max(r["count"] for r in sizes) == 10
    back = io.read_ordered(spark, str(tmp_path / "o"), docs.schema).orderBy("rank").collect()
    assert [(r["k"], r["t"], r["shard"], r["rank"]) for r in back] == [(i, str(94 - i), i // 32, i + 1) for i in range(95)]
