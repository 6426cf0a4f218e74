"""Streaming results upsert equals the batch upsert of the same rows."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.plans.io_queries import result_rows
from quarry.session import scratch_path
from quarry.sources import io
from quarry.streaming.results_sink import read_latest, start_results_upsert, versions


def run_stream(spark, rows, table, checkpoint, src=None):
    src = src or scratch_path(spark, "updates-src")
    rows.repartition(7).write.mode("append").parquet(src)       # many small files, in an arbitrary order
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    start_results_upsert(stream, table, checkpoint).awaitTermination(300)
    return src


def same(got, want):
    assert got.count() == want.count()
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_stream_upsert_matches_batch(spark):
    base, upd = result_rows(spark, SF_SMALL)
    rows = base.withColumn("seq", F.lit("")).unionByName(upd)
    table = scratch_path(spark, "results-table")
    run_stream(spark, rows, table, scratch_path(spark, "results-ckpt"))
    same(read_latest(spark, table), io.upsert(spark.createDataFrame([], io.RESULT_SCHEMA), rows))


def test_stream_keeps_the_sequence_type_over_epochs_and_restarts(spark):
    """A bigint sequence (9 < 10), several epochs, a restart from the same
    checkpoint and a stream from a new one."""
    def rows(*seqs):
        return spark.createDataFrame([("s", "n", "e", "v", float(q), 0.0, 0.0, 0.0, q) for q in seqs],
                                     "system string, size string, experiment_type string, version string, "
                                     "mrr_3 double, mrr_20 double, hits_1 double, hits_10 double, seq bigint")
    table, checkpoint = scratch_path(spark, "results-table"), scratch_path(spark, "results-ckpt")
    src = run_stream(spark, rows(9, 10, 2), table, checkpoint)
    assert [r["mrr_3"] for r in read_latest(spark, table).collect()] == [10.0]
    run_stream(spark, rows(11, 3), table, checkpoint, src)
    assert [r["mrr_3"] for r in read_latest(spark, table).collect()] == [11.0]
    run_stream(spark, rows(8), table, scratch_path(spark, "results-ckpt-2"))
    assert [r["mrr_3"] for r in read_latest(spark, table).collect()] == [11.0]
    assert len(versions(spark, table)) <= 2
