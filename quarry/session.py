"""Session helpers: building a local session for tests/bench, checkpoint dir
resolution and partition sizing.

Library code never builds its own session; it receives one.  Intermediate
tables and lineage cuts go to the shared folder named by
``spark.checkpoint.dir``.  Where it is unset, a session in one process (tests,
a plain local session) uses a folder inside its warehouse directory; a cluster
session must name one, unless its warehouse lies in a store that all machines
share.  An application's intermediate tables are one folder, which goes when
the application ends or calls ``release_scratch``.
"""

from __future__ import annotations

import atexit
import os
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles, StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "quarry") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    parts = shuffle_partitions or (int(cpus) * 2 if str(cpus).isdigit() else 16)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    log_dir = os.environ.get("QUARRY_EVENT_LOG_DIR")   # stage timings for profiling
    if log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session: ``spark.checkpoint.dir`` if set,
    else a folder inside ``spark.sql.warehouse.dir``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        one_process = sc.master.startswith("local[") or sc.master == "local"
        if not one_process and (warehouse.startswith("file:") or ":" not in warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = warehouse + "/_quarry_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss, unlike a local one).
    The frame is persisted first so writing the checkpoint files reads the
    cached rows instead of computing the plan a second time."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def target_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def materialize(df: DataFrame) -> DataFrame:
    """Persist and fill the cache now.  A DataFrame read by several branches
    of one plan would otherwise be computed by each branch concurrently
    before the cache exists.  Lost blocks are recomputed from lineage."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-io/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of this application under the shared checkpoint
    directory (never a machine-local temp dir)."""
    sc, root = spark.sparkContext, _scratch_root(spark)
    if getattr(sc, "_quarry_scratch", None) != sc.applicationId:
        sc._quarry_scratch = sc.applicationId
        atexit.register(release_scratch, spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def release_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables; frames that read them
    can't be used any more.  Does nothing once the session has ended."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: a
    lineage cut that column pruning and predicates still reach."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per
    application, so that functions named in a task can be imported there."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = os.path.join(SparkFiles.getRootDirectory(), "quarry-source")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "quarry_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted([*root.rglob("*.py"), *root.rglob("stopwords/*.txt")]):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._quarry_shipped = sc.applicationId
