"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line.  Each query is fully executed through the noop
sink (no collect to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.registry import REGISTRY  # noqa: E402
from quarry.session import local_session  # noqa: E402

# The reference's pipelines end to end.  ``term_stats`` builds the inverted
# index and ``prepare_corpus`` the TextRank table (query and keyword docid, 10
# iterations each); the later queries read those tables, as the reference's
# evaluations read its prepared table.  Then BM25 evaluation (flagship), trie-
# constrained retrieval evaluation, query generation, candidate re-ranking,
# indexing pairs with splits, the dataset builder and the ranker loss.
HEADLINE = [
    "term_stats",
    "prepare_corpus",
    "bm25_eval",
    "beam_eval",
    "generate_queries",
    "attach_queries",
    "rerank_queries",
    "multi_view_pairs",
    "qa_dataset_train",
    "listwise_loss",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    # warm the JVM (class loading, JIT) outside the timed queries
    from pyspark.sql import functions as F
    from quarry.sources.tables import read_table
    read_table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.sum(F.length("text"))).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t = time.time()
        REGISTRY[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t, 3)
        spark.catalog.clearCache()          # each query pays for its own caches
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
