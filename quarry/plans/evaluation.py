"""BM25 evaluation - corpus -> index -> queries of three types ->
top-20 retrieval -> rank of the target -> metrics per type + macro, saved.

Query types: ``textrank`` (the TextRank sentences of a document) and ``d2q``
(one generated query per document), which make up the macro row, and
``known_item`` (benchmark passages, target = the containing document).  Hits
and targets are docids (J6: TextRank keywords), so documents that share a
docid count as the same target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bm25, generate, metrics
from quarry.operators.index import Index
from quarry.operators.metrics import QUERY_TYPES
from quarry.plans import fixtures, prepared
from quarry.plans.prepared import corpus_index
from quarry.session import written
from quarry.sources import io

EVAL_TYPES = QUERY_TYPES
# System labels and the key written to the results table.
BM25_SYSTEM = "BM25-base"
DSI_SYSTEM = "DSI-base"
EXPERIMENT, VERSION = "text_rank_d2q_q1", "v1.0"


@dataclass
class Bm25Run:
    index: Index
    queries: DataFrame
    hits: DataFrame
    ranks: DataFrame


def generated_queries(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(doc_id, q_rank, query): the best ``n`` extractive queries per document."""
    corp, index = corpus_index(spark, sf_dir)
    return generate.extractive_queries(corp.select(F.col("mid").alias("doc_id"), "body_clean"),
                                       index.term_stats, bm25.hot_terms(index), n=n, text_col="body_clean")


def drawn_queries(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(doc_id, q_rank, query): ``n`` seeded draws per document."""
    corp, index = corpus_index(spark, sf_dir)
    return generate.sampled_queries(corp.select(F.col("mid").alias("doc_id"), "body_clean"),
                                    index.term_stats, bm25.hot_terms(index), n=n, text_col="body_clean")


def evaluation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, qkey, query_type, query, target) with F1 applied."""
    _, index = corpus_index(spark, sf_dir)
    ids = prepared.docids(spark, sf_dir)

    def typed(rows: DataFrame, prefix: str, key: str, kind: str, bit: int) -> DataFrame:
        return rows.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("query_id"),
                           (F.col(key) * 3 + bit).alias("qkey"), F.lit(kind).alias("query_type"), "query", "target")
    items = fixtures.known_items(spark, sf_dir, index.postings.select("term", "doc_id"),
                                 index.term_stats.select("term", "df"))
    items = items.join(ids.select(F.col("doc_id").alias("target"), "docid"), "target", "left").select(
        "item_id", "query", F.col("docid").alias("target"))
    d2q = generated_queries(spark, sf_dir, 1).join(ids, "doc_id").select("doc_id", "query", F.col("docid").alias("target"))
    rank = prepared.ranked_ids(spark, sf_dir).select("doc_id", F.col("text_rank_query").alias("query"),
                                                     F.col("elaborative_description").alias("target"))
    q = typed(items, "k", "item_id", "known_item", 1).unionByName(typed(d2q, "d", "doc_id", "d2q", 0)) \
        .unionByName(typed(rank, "t", "doc_id", "textrank", 2))
    return q.where(F.col("query").isNotNull() & (F.col("query") != ""))


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared.once(spark, sf_dir, "queries", lambda: written(evaluation_queries(spark, sf_dir), "queries"),
                         ("documents", "benchmark"))


def target_ranks(found: DataFrame, queries: DataFrame, docids: DataFrame) -> DataFrame:
    """(query_id, query_type, target, rank): where (qkey, rank, doc_id) first has
    a document whose docid is the target.  Docids are long, so numbers stand
    for them where lists are joined."""
    numbers = written(docids.select("docid").distinct().withColumn("number", F.monotonically_increasing_id()), "docid-numbers")
    items = docids.join(numbers, "docid").select("doc_id", F.col("number").alias("item"))
    targets = queries.select("qkey", F.col("target").alias("docid")).join(numbers, "docid").select("qkey", "number")
    ranks = found.select("qkey", "rank", "doc_id").join(items, "doc_id").join(targets, "qkey").where(F.col("item") == F.col("number")) \
        .groupBy("qkey").agg(F.min("rank").alias("rank"))
    return queries.join(ranks, "qkey", "left").select("query_id", "query_type", "target", "rank")


def bm25_run(spark: SparkSession, sf_dir: str, k: int = bm25.DEPTH) -> Bm25Run:
    def run():
        _, index = corpus_index(spark, sf_dir)
        queries = query_table(spark, sf_dir)
        # an exact numeric key (3 * id + type) keeps the (query, doc) shuffle
        # narrow; the string id is joined back after the top-k cut
        found = bm25.bm25_search(index, queries.select(F.col("qkey").alias("query_id"), "query"), k=k).withColumnRenamed("query_id", "qkey")
        found = written(found.where(F.col("doc_id").isNotNull()), "bm25-hits")
        hits = found.join(queries.select("qkey", "query_id"), "qkey").select("doc_id", "rank", "score", "query_id")
        return Bm25Run(index, queries, hits, target_ranks(found, queries, prepared.docids(spark, sf_dir)))
    return prepared.once(spark, sf_dir, f"bm25-{k}", run, ("documents", "benchmark"))


def summary_rows(ranks: DataFrame, system: str) -> DataFrame:
    """Per-type metric rows plus the macro row."""
    per = written(metrics.metrics_by_type(ranks, digits=None), "metrics")
    return metrics.round_metrics(per).unionByName(metrics.macro_of(per, EVAL_TYPES)).select(
        F.lit(system).alias("system"), "query_type", "n_queries", "mrr_3", "mrr_20", "hits_1", "hits_10")


def save_macro(spark: SparkSession, rows: DataFrame, size: str, table: str) -> DataFrame:
    """IO3: upsert the macro row of an evaluation into a results table."""
    row = rows.where(F.col("query_type") == "macro").select(
        "system", F.lit(size).alias("size"), F.lit(EXPERIMENT).alias("experiment_type"), F.lit(VERSION).alias("version"),
        "mrr_3", "mrr_20", "hits_1", "hits_10", F.lit(0).alias("seq"))
    return io.upsert_table(spark, table, row)


def bm25_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_rows(bm25_run(spark, sf_dir).ranks, BM25_SYSTEM)
