"""Experiment results arriving as a stream (one row per finished run: the
reference saves a result row after every evaluation).

Each micro-batch is merged into the keyed results table: per key the row with
the highest sequence value wins (the batch ``upsert`` rule).  Parquet has no
MERGE, so every epoch writes a complete new version
``<table>/run=<r>/epoch=<n>`` built from the version before; a replayed epoch
rewrites the same folder (idempotent), and readers take the newest version.  A
stream that starts from a new checkpoint gets the next run number, so its
epochs, which begin at 0 again, follow the versions written before.  The two
newest versions stay; older ones are removed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from quarry.sources.io import RESULT_KEY, RESULT_SCHEMA

KEPT = 2


def version_path(table: str, run: int, epoch: int) -> str:
    return f"{table}/run={run}/epoch={epoch}"


def _path(spark: SparkSession, path: str):
    """(file system, path) of the session's storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, table: str) -> list[tuple[int, int]]:
    """Complete versions (run, epoch), oldest first."""
    fs, p = _path(spark, table)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, "run=*/epoch=*/_SUCCESS"))
    names = [str(s.getPath()) for s in (found or [])]
    return sorted(tuple(map(int, re.search(r"run=(\d+)/epoch=(\d+)/_SUCCESS$", x).groups())) for x in names)


def _drop_old(spark: SparkSession, table: str) -> None:
    for run, epoch in versions(spark, table)[:-KEPT]:
        fs, p = _path(spark, version_path(table, run, epoch))
        fs.delete(p, True)


def start_results_upsert(updates: DataFrame, table: str, checkpoint: str,
                         key=RESULT_KEY, seq: str = "seq") -> StreamingQuery:
    """Start the streaming upsert of ``updates`` (a streaming DataFrame with
    the result columns plus ``seq`` of any ordered type) into ``table``.  Each
    stored version keeps ``seq``, so an update that arrives in a later
    micro-batch than a higher-sequence one does not win: the result equals the
    batch upsert of all rows, whatever the arrival order."""
    spark = updates.sparkSession
    schema = StructType(RESULT_SCHEMA.fields + [StructField(seq, updates.schema[seq].dataType)])
    fs, at = _path(spark, checkpoint)
    runs = [r for r, _ in versions(spark, table)]
    run = max(runs, default=0 if fs.exists(at) else -1) + (0 if fs.exists(at) else 1)

    def merge(batch: DataFrame, epoch_id: int) -> None:
        s = batch.sparkSession
        before = [v for v in versions(s, table) if v < (run, epoch_id)]
        prev = s.read.schema(schema).parquet(version_path(table, *before[-1])) if before else s.createDataFrame([], schema)
        rows = (prev.withColumn("_new", F.lit(0))
                .unionByName(batch.select(*schema.fieldNames()).withColumn("_new", F.lit(1))))
        w = Window.partitionBy(*key).orderBy(F.col(seq).desc(), F.col("_new").desc())
        merged = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")
        merged.write.mode("overwrite").parquet(version_path(table, run, epoch_id))
        _drop_old(s, table)

    return (updates.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of the results table."""
    found = versions(spark, table)
    if not found:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.parquet(version_path(table, *found[-1])).select(*RESULT_SCHEMA.fieldNames())
