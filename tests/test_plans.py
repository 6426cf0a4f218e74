"""Plan properties that matter at scale, read from ``explain()``."""

import contextlib
import io

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators import bm25, split
from quarry.operators.order import seeded_key
from quarry.plans import evaluation, prepared
from quarry.plans.registry import REGISTRY
from quarry.sources.tables import read_table


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_scan_prunes_columns_and_pushes_filters(spark):
    d = read_table(spark, SF_SMALL, "documents").where(F.col("lang") == "en").select("doc_id")
    p = plan(d)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p


def test_bucket_split_has_no_shuffle(spark):
    d = read_table(spark, SF_SMALL, "documents").select("doc_id")
    p = plan(split.split_bucket(d, seeded_key(42, "doc_id")))
    assert "Exchange" not in p


def node_count(p: str, name: str) -> int:
    """Nodes of a kind in the plan's tree (the part before the details)."""
    tree = p.split("(1)")[0]
    return sum(name in line for line in tree.splitlines())


def test_bm25_reads_required_postings_only(spark):
    _, idx = prepared.corpus_index(spark, SF_SMALL)
    q = evaluation.query_table(spark, SF_SMALL).select(F.col("qkey").alias("query_id"), "query")
    terms = bm25.required_terms(idx, q, 20)
    per = bm25.postings_read(idx, terms).agg(F.sum("all").alias("all"), F.sum("read").alias("read")).first()
    assert per["read"] < 0.4 * per["all"]
    pruned = bm25.bm25_search(idx, q, 20)
    plain = bm25.top_k(bm25.bm25_scores(idx, q), 20).select(pruned.columns)
    assert pruned.exceptAll(plain).count() == 0 and plain.exceptAll(pruned).count() == 0
    p = plan(pruned)
    assert "WindowGroupLimit" in p and "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_quota_fill_sorts_ids_only(spark):
    d = read_table(spark, SF_SMALL, "documents")
    out = split.quota_fill(d.where("doc_id % 3 = 0"), d, "doc_id", 50)
    assert "text" not in plan(out) and set(out.columns) == {"doc_id", "priority", "fill_rank"}


def test_headline_queries_have_no_python_nodes(spark):
    for key in ("rerank_queries", "multi_view_pairs", "qa_dataset_train", "mix_sources", "score_pairs"):
        p = plan(REGISTRY[key](spark, SF_SMALL))
        assert "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p, key
