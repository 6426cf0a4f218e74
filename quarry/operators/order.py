"""Global order without a single-task window.

``row_number() OVER (ORDER BY k)`` with no partition moves every row into
one task.  ``global_row_number`` instead range-partitions on the order key,
sorts inside each partition, reads the in-partition position from
``monotonically_increasing_id`` (partition id in the upper bits, position
in the lower 33), and adds each partition's offset, computed from a table
of one row per partition (bounded by the partition count) and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

_LOW = (1 << 33) - 1


def seeded_key(seed: int | str, id_col) -> Column:
    """md5('<seed>:<id>') - the seeded order used by every shuffle/split
    (identical in Spark and DuckDB, unlike hash/xxhash64)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


BUCKET_DIGITS = 4           # 65,536 buckets: their counts are all that the driver sees


def _bucketed(df: DataFrame, id_col: str, seed: int | str) -> DataFrame:
    key = seeded_key(seed, id_col)
    return df.withColumn("_k", key).withColumn("_b", F.conv(F.substring("_k", 1, BUCKET_DIGITS), 16, 10).cast("int"))


def _bucket_starts(keyed: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """(rows before, rows) of every bucket of the seeded order."""
    counts = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}
    starts, at = {}, 0
    for b in sorted(counts, key=lambda b: (b is not None, b)):      # a null id has a null key, which comes first
        starts[b] = at
        at += counts[b]
    return starts, counts


def seeded_parts(df: DataFrame, id_col: str, cuts: list[int], seed: int | str, name: str = "part") -> DataFrame:
    """``name``: how many of the ascending ``cuts`` are below a row's place in
    the seeded order (md5, then id).  The buckets of the first digits are
    counted; only the rows of the buckets that a cut falls into are numbered,
    all others tell their part from their bucket, so nothing else moves."""
    keyed = _bucketed(df, id_col, seed)
    starts, counts = _bucket_starts(keyed)
    torn = sorted({b for b in starts for c in cuts if starts[b] < c < starts[b] + counts[b]}, key=lambda b: (b is not None, b))
    bucket = F.coalesce(F.col("_b"), F.lit(-1))
    part = F.lit(0)
    for c in cuts:
        later = [b for b in starts if starts[b] >= c]
        first = min((-1 if b is None else b) for b in later) if later else 1 << 4 * BUCKET_DIGITS
        part = part + F.when(bucket >= first, 1).otherwise(0)
    ids = [-1 if b is None else b for b in torn]
    whole = keyed.where(~bucket.isin(ids)) if ids else keyed
    out = whole.withColumn(name, part)
    if ids:
        begin = F.element_at(F.create_map(*[F.lit(x) for b, i in zip(torn, ids) for x in (i, starts[b])]), bucket)
        place = begin + F.row_number().over(Window.partitionBy("_b").orderBy("_k", id_col))
        split = keyed.where(bucket.isin(ids)).withColumn("_place", place)
        split = split.withColumn(name, sum((F.when(F.col("_place") > c, 1).otherwise(0) for c in cuts), F.lit(0))).drop("_place")
        out = out.unionByName(split)
    return out.drop("_k", "_b")


def seeded_rank(df: DataFrame, id_col: str, seed: int | str, name: str) -> DataFrame:
    """``name``: 1-based place in the seeded order.  One hash Exchange by
    bucket, whose rows are numbered on their own and shifted by the counts
    before (at most 65,536 rows, broadcast): no range sampling, no checkpoint."""
    keyed = _bucketed(df, id_col, seed)
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    table = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_k", id_col)))
    joined = numbered.alias("n").join(F.broadcast(table.alias("t")), F.col("n._b").eqNullSafe(F.col("t._b")))
    return joined.select(*[F.col(f"n.`{c}`") for c in df.columns], (F.col("t._start") + F.col("n._n")).cast("bigint").alias(name))


def global_row_number(df: DataFrame, order: list[str], name: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """Append a 1-based ``name`` following ``order`` (must be a total order)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit(_LOW)))
    # range bounds come from sampling: a recomputed branch could place rows
    # differently, so both uses read one reliable checkpoint of the numbering
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("_pid").agg(F.count("*").alias("_cnt"))
    offsets = counts.select(
        "_pid", (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid").withColumn(
        name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos") + 1).cast("bigint"))
    return out.drop("_mid", "_pid", "_pos", "_off")
