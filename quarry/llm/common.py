"""Helpers shared by the corpus operators: table access, range buckets that
keep a global order without a single-task window, and connected components
that never leave the cluster."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import cut_lineage

#: A null id takes this place in every order (after all others, descending).
NULL_ID = -(1 << 63)
MAX_BUCKETS = 1 << 16
BATCH_ROWS = 1_000
TRIM_BYTES = 16 << 20
FAN_IN = 64
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per
    application, so that functions named in a task can be imported there."""
    small_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.join(SparkFiles.getRootDirectory(), "quarry-source")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "quarry_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._quarry_shipped = sc.applicationId


_SERVED: list = [None, None]


def serve(operator: str, release=None) -> None:
    """Called by an operator's tasks: a Python worker that served another
    operator before releases what it cached for that one."""
    name, drop = _SERVED
    if name is not None and name != operator:
        if drop is not None:
            drop()
        gc.collect()
        trim()
    _SERVED[:] = [operator, release]


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # another C library: nothing to trim
        pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold ``BATCH_ROWS`` rows, unless the
    session sets another number: several batches of 10,000 long texts for
    every task, in the JVM and in Python, are most of an executor's memory."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def slices(batches, rows: int = 512):
    """Arrow batches in slices of a few rows, so that a task holds Python
    copies of these only; freed memory goes back after every ``TRIM_BYTES``."""
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        size += batch.nbytes
        if size > TRIM_BYTES:
            size = 0
            del batch
            trim()


def packed(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that columns an operator adds
    beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, in order, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def added_up(parts: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, counts): the sum of the int64 vectors ``counts`` (binary) of each
    key, whose parts the tasks of a narrow plan made.  A tree over the tasks:
    ``FAN_IN`` neighbours meet in a group on two levels, and the last one has a
    vector per ``FAN_IN`` ** 2 tasks (25 at 100,000 tasks)."""
    schema = f"{key} {kind}, slot int, counts binary"

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in group.column("counts"))
        return pa.table({key: group.column(key)[:1], "slot": group.column("slot")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    tree = parts.withColumn("slot", F.spark_partition_id())
    for level in range(3):
        tree = tree.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int") if level < 2 else F.lit(0))
        tree = tree.groupBy(key, "slot").applyInArrow(lambda group: add(group), schema)
    return tree.select(key, "counts")


def order_id(col: str | Column) -> Column:
    """The id as a non-null sort key."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("bigint"), F.lit(NULL_ID))


def long_array(values: list[int]) -> Column:
    """A literal array<bigint>: one constant-folded string, not a literal per value."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def id_cuts(df: DataFrame, id_col: str, rows_per_bucket: int) -> list[int]:
    """Ascending cut points that split the ids into buckets of about
    ``rows_per_bucket`` rows.  Ids only: one aggregate, at most
    ``MAX_BUCKETS`` values on the driver."""
    key = order_id(id_col)
    n = df.select(F.count("*").alias("n")).first()["n"]
    buckets = min(MAX_BUCKETS, math.ceil(n / rows_per_bucket))
    if buckets < 2:
        return []
    marks = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    cuts = df.select(F.percentile_approx(key, marks, F.lit(max(10_000, 4 * buckets))).alias("c")).first()["c"]
    return sorted(set(cuts))


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """Number of cut points <= key (0 .. len(cuts)): two short array scans
    (coarse, then one fine slice), about 2 * sqrt(len(cuts)) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    below = lambda a: F.size(F.filter(a, lambda c: c <= key))
    coarse = below(long_array(cuts[step - 1::step]))
    return (coarse * step + below(F.slice(long_array(cuts), coarse * step + 1, step))).cast("int")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Components of an undirected graph: one row (node, component) per node
    that has an edge, component = smallest node reachable.

    Alternating large-star / small-star steps: every node links to the
    smallest neighbour seen, until the edges stop changing, which takes a
    number of rounds logarithmic in the graph's diameter.  Minima are
    combined before each shuffle and each round's edges are checkpointed, so
    a hub is never collected into one task and lost executors cost one round.
    Loops and repeated edges are ignored; no edges give no rows."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")) \
        .where("u <> v").distinct()
    e = cut_lineage(e)
    mark = _mark(e)
    while mark[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut_lineage(small)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
              F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)
