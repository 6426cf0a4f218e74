"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) in
full.  Column names match the DuckDB oracles in ``quarry.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import metrics, phrases
from quarry.operators.index import analyze, postings_of
from quarry.operators.ranking import first_per_key
from quarry.plans import evaluation, fixtures, prepared
from quarry.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn
    return deco


# --------------------------------------------------------------- sources
@register("scan_corpus")
def q_scan_corpus(spark, sf):
    return fixtures.corpus(spark, sf)


# --------------------------------------------------------------- index
def _contents(spark, sf):
    return prepared.corpus(spark, sf).select(F.col("mid").alias("doc_id"),
                       tx.compose_contents("subject", "body_clean").alias("contents"))


@register("postings")
def q_postings(spark, sf):
    p = postings_of(analyze(_contents(spark, sf)), with_positions=True, distinct_ids=True)
    return p.select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


@register("doc_vectors")
def q_doc_vectors(spark, sf):
    """R1, forward form: each document's terms in order with tf and positions."""
    vectors = prepared.position_index(spark, sf).vectors
    entry = F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string"), F.array_join(t["positions"].cast("array<string>"), ",")))
    return vectors.select("doc_id", "dl", F.md5(F.array_join(entry, " ")).alias("terms_md5"))


@register("phrase_match")
def q_phrase_match(spark, sf):
    """Documents that hold a benchmark passage as a phrase, by positions."""
    return phrases.phrase_matches(prepared.position_index(spark, sf), read_table(spark, sf, "benchmark"))


@register("doc_stats")
def q_doc_stats(spark, sf):
    return analyze(_contents(spark, sf)).select("doc_id", "dl")


@register("term_stats")
def q_term_stats(spark, sf):
    _, idx = prepared.corpus_index(spark, sf)
    return idx.term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


# --------------------------------------------------------------- BM25
@register("query_set")
def q_query_set(spark, sf):
    return evaluation.query_table(spark, sf).select("query_id", "query_type", "query", "target")


@register("generate_queries")
def q_generate_queries(spark, sf):
    return evaluation.generated_queries(spark, sf, 3)


@register("sample_queries")
def q_sample_queries(spark, sf):
    """Three seeded draws per document from its ten best sentences."""
    return evaluation.drawn_queries(spark, sf, 3)


@register("bm25_topk")
def q_bm25_topk(spark, sf):
    return evaluation.bm25_run(spark, sf).hits.select("query_id", "rank", "doc_id", "score")


@register("bm25_rank")
def q_bm25_rank(spark, sf):
    return evaluation.bm25_run(spark, sf).ranks.select("query_id", "query_type", "target", "rank")


@register("metrics_by_type")
def q_metrics_by_type(spark, sf):
    return metrics.metrics_by_type(evaluation.bm25_run(spark, sf).ranks)


@register("metrics_macro")
def q_metrics_macro(spark, sf):
    return metrics.metrics_macro(evaluation.bm25_run(spark, sf).ranks, evaluation.EVAL_TYPES)


@register("bm25_eval")
def q_bm25_eval(spark, sf):
    return evaluation.bm25_eval(spark, sf)


@register("dedupe_first")
def q_dedupe_first(spark, sf):
    """First document per distinct text (md5 key), lowest doc_id wins."""
    d = fixtures.corpus(spark, sf).select(F.md5("body_clean").alias("text_key"), "mid")
    return first_per_key(d, "text_key", "mid").select("text_key", F.col("mid").alias("doc_id"))


def _load_all() -> None:
    """Import the query modules so their ``register`` calls run."""
    from quarry.plans import (data_queries, io_queries, rerank_queries,  # noqa: F401
                              retrieval_queries, text_queries, textrank_queries)


_load_all()
