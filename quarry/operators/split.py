"""Seeded splits, dense ids, samples, quota fill, shards.

Every seeded order is md5('<seed>:<id>') then id, so results are stable
across runs, engines and partitionings.  Exact cut-offs count buckets of the
order and number only the bucket that a cut falls into (``seeded_parts``);
bucket mode needs no global order at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import global_row_number, seeded_key, seeded_parts, seeded_rank

SLACK = 1e-9
SPLITS = ("train", "validate", "test")


def check_shares(train: float, validate: float, test: float) -> None:
    """Shares must sum to [0.98, 1] (float slack allowed)."""
    total = train + validate + test
    if total > 1 + SLACK or total < 0.98 - SLACK:
        raise ValueError(f"shares sum to {total}; expected between 0.98 and 1 "
                         f"(train {train}, validate {validate}, test {test})")


def _validate_share(validate: float, test: float) -> float:
    """Share of what train leaves; nothing when both shares are 0."""
    return validate / (validate + test) if validate + test > 0 else 0.0


def split_exact(df: DataFrame, id_col: str, seed: int = 42, train: float = 0.8,
                validate: float = 0.1, test: float = 0.1) -> DataFrame:
    """Exact sizes: n_train = floor(N*train), n_val = floor((N-n_train)*v/(v+t))."""
    check_shares(train, validate, test)
    n = df.count()
    n_train = int(n * train + SLACK)
    n_val = int((n - n_train) * _validate_share(validate, test) + SLACK)
    if validate + test <= 0:
        n_train = n
    parts = seeded_parts(df, id_col, [n_train, n_train + n_val], seed, "split")
    return parts.withColumn("split", F.when(F.col("split") == 0, "train").when(F.col("split") == 1, "validate").otherwise("test"))


def unit_fraction(key: Column) -> Column:
    """First 32 bits of an md5 hex digest as a fraction in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split_bucket(df: DataFrame, key: Column, train: float = 0.8, validate: float = 0.1,
                 test: float = 0.1) -> DataFrame:
    """Hash-bucket split: no shuffle, no global order; shares hold in expectation."""
    check_shares(train, validate, test)
    u = unit_fraction(key)
    t2 = train + (1.0 - train) * _validate_share(validate, test)
    if validate + test <= 0:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(u < F.lit(train), "train")
                         .when(u < F.lit(t2), "validate").otherwise("test"))


def dense_ids(df: DataFrame, id_col: str, seed: int = 313, name: str = "rand_id") -> DataFrame:
    """A seeded permutation of 0..N-1."""
    return seeded_rank(df, id_col, seed, name).withColumn(name, F.col(name) - 1)


def seeded_head(df: DataFrame, id_col: str, n: int, seed: int = 313) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle, in no order."""
    return seeded_parts(df, id_col, [n], seed, "_part").where("_part = 0").drop("_part")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 313) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle with their ranks.
    Only rows that are chosen are dealt out and numbered, so ``n`` may be large."""
    return seeded_rank(seeded_head(df, id_col, n, seed), id_col, seed, "sample_rank")


def quota_fill(preferred: DataFrame, pool: DataFrame, id_col: str, quota: int, seed: int = 313,
               exclude: DataFrame | None = None, allow_duplicates: bool = False) -> DataFrame:
    """(id, priority, fill_rank) - preferred ids first, then pool ids, each
    in seeded order, up to ``quota``.  Pool ids that are preferred already are
    left out unless ``allow_duplicates``; ids in ``exclude`` (held-out
    documents) never come from the pool.  Only ids that are taken are numbered:
    join the texts to the result."""
    preferred, pool = preferred.select(id_col), pool.select(id_col)
    if not allow_duplicates:
        pool = pool.join(preferred, id_col, "left_anti")
    if exclude is not None:
        pool = pool.join(exclude.select(id_col), id_col, "left_anti")
    first = min(quota, preferred.count())
    out = seeded_rank(seeded_head(preferred, id_col, first, seed), id_col, seed, "fill_rank").withColumn("priority", F.lit(0).cast("bigint"))
    more = seeded_rank(seeded_head(pool, id_col, quota - first, seed), id_col, seed, "fill_rank")
    more = more.withColumn("fill_rank", F.col("fill_rank") + first).withColumn("priority", F.lit(1).cast("bigint"))
    return out.unionByName(more).select(id_col, "priority", "fill_rank")


def nth_smallest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n-th row in ``order`` (distributed top-n, then one row)."""
    head = df.orderBy(*order).limit(n)
    w = Window.orderBy(*order)            # over at most n rows
    return head.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == n).drop("_rn")


def shard_rows(df: DataFrame, id_col: str, workers: int, seed: int = 313) -> DataFrame:
    """Top up to a multiple of ``workers`` by re-using rows in seeded
    order, then contiguous equal shards in id order."""
    n = df.count()
    target = -(-n // workers) * workers
    extra = target - n
    base = df.withColumn("copy", F.lit(0).cast("bigint"))
    if extra:
        top = seeded_sample(df, id_col, extra, seed).drop("sample_rank").withColumn("copy", F.lit(1).cast("bigint"))
        base = base.unionByName(top)
    numbered = global_row_number(base, ["copy", id_col])
    per = target // workers
    return numbered.withColumn("shard", F.floor((F.col("rn") - 1) / per).cast("bigint")).drop("rn")


def shard_contiguous(df: DataFrame, id_col: str, workers: int) -> DataFrame:
    """X8, inference form: contiguous shards of floor(n / workers) rows in id
    order, the last one takes the remainder; no row is used twice."""
    per = max(1, df.count() // workers)
    numbered = global_row_number(df, [id_col])
    return numbered.withColumn("shard", F.least(F.floor((F.col("rn") - 1) / per), F.lit(workers - 1)).cast("bigint")).drop("rn")


def mixed_batches(df: DataFrame, source: str, id_col: str, batch: int, epochs: int = 1, seed: int = 313) -> DataFrame:
    """(source, pass, batch, slot, id, step) - proportional mixing.

    Steps per source follow its share of ``epochs`` passes over all rows
    (half-even rounding, the last source takes the remainder).  A source goes
    through its rows in passes, each in a seeded order of its own and cut into
    whole batches; its first ``steps`` batches count.  ``step`` is the seeded
    order of all batches.  A source with less than one batch gives none."""
    sizes = df.groupBy(source).agg(F.count("*").alias("n_rows"))
    every = Window.partitionBy(F.lit(1))                               # one row per source
    s = (sizes.withColumn("total_steps", F.floor(F.sum("n_rows").over(every) * epochs / batch))
         .withColumn("share", F.bround(F.col("n_rows") / F.sum("n_rows").over(every) * F.col("total_steps"), 0))
         .withColumn("pos", F.row_number().over(every.orderBy(source))).withColumn("n_src", F.count("*").over(every)))
    before = F.sum(F.when(F.col("pos") < F.col("n_src"), F.col("share"))).over(every)
    steps = F.when(F.col("pos") == F.col("n_src"), F.col("total_steps") - F.coalesce(before, F.lit(0))).otherwise(F.col("share"))
    plan = (s.withColumn("steps", steps.cast("bigint")).withColumn("per_pass", F.floor(F.col("n_rows") / batch))
            .where("per_pass > 0 AND steps > 0").withColumn("passes", F.ceil(F.col("steps") / F.col("per_pass")))
            .select(source, "steps", "per_pass", "passes"))
    rows = df.select(source, id_col).join(plan, source).withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.col(id_col).cast("string")))
    numbered = global_row_number(rows.withColumn("_k", key), [source, "pass", "_k", id_col], "_n")
    first = numbered.groupBy(source, "pass").agg(F.min("_n").alias("_first"))
    at = F.col("_n") - F.col("_first")
    cut = (numbered.join(first, [source, "pass"]).withColumn("slot", at % batch)
           .withColumn("_b", F.floor(at / batch)).where("_b < per_pass")
           .withColumn("batch", F.col("pass") * F.col("per_pass") + F.col("_b")).where("batch < steps"))
    order = cut.where("slot = 0").select(source, "batch", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col(source), F.col("batch").cast("string"))).alias("_k"))
    order = global_row_number(order, ["_k", source, "batch"], "step").drop("_k")
    return cut.join(order, [source, "batch"]).select(
        source, F.col("pass").cast("bigint").alias("pass"), F.col("batch").cast("bigint").alias("batch"),
        F.col("slot").cast("bigint").alias("slot"), id_col, (F.col("step") - 1).alias("step"))
