"""Ranking helpers over long ranked lists (query_id, rank, item).

W2  rank of the first correct hit (null = miss)
W3  order-preserving de-duplication of a ranked list (+ valid-id filter F3)
W4  first-wins de-duplication by key
W6  n-th row in a global order
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_hit_rank(ranked: DataFrame, targets: DataFrame, key: str = "query_id",
                   item: str = "item", target: str = "target") -> DataFrame:
    """Per row of ``targets`` (key, target, ...): min rank whose item equals
    the target, null when the target is absent from the list."""
    hits = (ranked.join(targets.select(key, target), key)
            .where(F.col(item) == F.col(target))
            .groupBy(key).agg(F.min("rank").alias("rank")))
    return targets.join(hits, key, "left")


def dedupe_ranked(ranked: DataFrame, key: str = "query_id", item: str = "item",
                  valid: DataFrame | None = None, valid_col: str | None = None) -> DataFrame:
    """Keep the first occurrence of each item per key; drop items not in
    ``valid`` (semi join on distinct ids); renumber ranks 1..n."""
    first = ranked.groupBy(key, item).agg(F.min("rank").alias("first_rank"))
    if valid is not None:
        vc = valid_col or item
        first = first.join(valid.select(F.col(vc).alias(item)).distinct(), item, "left_semi")
    w = Window.partitionBy(key).orderBy("first_rank")
    return first.select(key, item, F.row_number().over(w).cast("bigint").alias("rank"))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
