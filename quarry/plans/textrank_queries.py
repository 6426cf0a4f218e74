"""Registered TextRank queries."""

from __future__ import annotations

from quarry.plans import prepared
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import io


@register("textrank_summary")
def q_textrank_summary(spark, sf):
    return prepared.summaries(spark, sf)


@register("textrank_keywords")
def q_textrank_keywords(spark, sf):
    return prepared.keyword_ids(spark, sf)


@register("prepare_corpus")
def q_prepare_corpus(spark, sf):
    """Composed view, TextRank query and keyword docid written back
    (replace) and read from the new table."""
    path = scratch_path(spark, "prepared-copy")
    io.write_replace(prepared.prepared(spark, sf), path)
    return spark.read.parquet(path)
