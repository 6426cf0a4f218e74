"""Mixing sources to target weights with Sainte-Lague apportionment.

Sources weigh 5, 2, 1, 5, 2, 1, ... in code point order (null last) and share
the whole size; no source goes above ``repeat_limit`` times its own size, the
excess is shared again by weight.  The mix is cut into equal blocks of
``block_words`` words.  Highest quotients v / (2k + 1) give every source, and
within it every shard, an integer number of blocks; a shard takes none beyond
``repeat_limit`` times its own blocks, the next quotient does.

Inside a shard the documents stand in a seeded order and their words are cut
into blocks.  Every block is taken in whole passes as often as the quota allows,
and of the blocks of the last pass the quota left over is selected: every
n / r-th block from a seeded place on, so that any r of n blocks are spread
over all of the shard, and how many of the blocks before a place are selected
is one division.  A document takes the words that it has in selected blocks.

Null or empty texts have size 0 and are taken 0 times; a very long text is cut
into blocks like any other.  Repeated rows are documents of their own, ties of
the order go by size.  An empty table gives no rows.  Columns other than id,
text and source are ignored, by ``repeat_documents`` kept, whatever their
names.  Only built-in functions are used; text is read once and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import order_id, packed, unpacked
from quarry.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEAT_LIMIT = 3
BLOCK_WORDS = 16
ROWS_PER_SHARD = 20_000
SEED = 7


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, text_key, source_key, sk, size, h): word count and seeded hash of
    each row.  ``sk`` is the source as a join key that null has too, text_key
    and source_key tell rows with the same id apart."""
    return docs.select(
        "doc_id", "source", F.xxhash64("text").alias("text_key"), F.xxhash64("source").alias("source_key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("sk"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"))


def targets(sources: DataFrame, weights=WEIGHTS, repeat_limit: int = REPEAT_LIMIT) -> DataFrame:
    """``target`` for each row (sk, source, source_size): water filling.  In the
    order of cap / weight the capped sources come first; the rest shares
    what they leave by weight.  One row per source: windows over this
    table see no documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", (F.lit(repeat_limit) * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "left": F.sum("source_size").over(Window.partitionBy()).cast("double")
        - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))})
    level = F.min(F.when(F.col("cap") / F.col("w") > F.col("left") / F.col("rest"),
                         F.struct(F.col("cap") / F.col("w"), F.col("left") / F.col("rest")))).over(Window.partitionBy())
    s = s.withColumn("level", level["col2"])
    return s.select("sk", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def sainte_lague(parties: DataFrame, group: str, votes: str, seats: str, key: str, most: str | None = None) -> DataFrame:
    """Seats of each party by highest quotients votes / (2k + 1): append
    ``won``.  ``seats`` holds the group's number of seats on each of its
    rows; ties go to the smaller ``key``; a party has no quotients beyond its
    ``most`` seats.

    Only seats near the exact share are in question: with m parties the
    divisor moves a share by at most share * m / 2 + 1, so a group emits
    about 4 * m quotients, however many seats there are."""
    g = Window.partitionBy(group)
    p = parties.withColumn("_v", F.col(votes).cast("double"))
    p = p.withColumn("_share", F.when(F.sum("_v").over(g) > 0, F.col("_v") / F.sum("_v").over(g)).otherwise(F.lit(0.0)))
    slack = F.col("_share") * F.count("*").over(g) / 2 + 1
    p = p.withColumns({"_low": F.greatest(F.floor(F.col("_share") * F.col(seats) - slack), F.lit(0)).cast("bigint"),
                       "_high": F.ceil(F.col("_share") * F.col(seats) + slack).cast("bigint")})
    if most is not None:
        p = p.withColumns({"_low": F.least("_low", most), "_high": F.least("_high", F.col(most) - 1)})
    p = p.withColumn("_open", F.col(seats) - F.sum("_low").over(g))
    q = p.where("_v > 0 AND _low <= _high").select(group, key, "_open", F.explode(F.sequence("_low", "_high")).alias("_k"), "_v")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(
        (F.col("_v") / (2 * F.col("_k") + 1)).desc(), F.col(key).asc(), F.col("_k").asc()))
    extra = q.withColumn("_r", rank).where("_r <= _open").groupBy(group, key).agg(F.count("*").alias("_n"))
    return p.join(extra, [group, key], "left").withColumn(
        "won", F.when(F.col("_v") > 0, F.col("_low") + F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("bigint")) \
        .drop("_v", "_share", "_low", "_high", "_open", "_n")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, repeat_limit: int = REPEAT_LIMIT, block_words: int = BLOCK_WORDS,
        rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, source_key, size, source_size, target, taken) for every row of
    ``docs``."""
    base = written(sized(docs, seed), "mix-sizes")
    n, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, math.ceil(n / rows_per_shard))
    shard = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % shards
    base = base.withColumn("shard", shard)
    cells = base.groupBy("sk", "source", "shard").agg(F.sum("size").alias("cell_size"))
    sources = targets(cells.groupBy("sk", "source").agg(F.sum("cell_size").alias("source_size")), weights, repeat_limit)
    blocks = sources.withColumns({"_all": F.lit(0), "_seats": F.lit(math.ceil(total / block_words)).cast("bigint")})
    blocks = sainte_lague(blocks, "_all", "target", "_seats", "sk").select(
        "sk", "source_size", "target", F.col("won").alias("source_blocks"))
    n_blocks = F.ceil(F.col("cell_size") / block_words).cast("bigint")
    parties = cells.select("sk", "shard", "cell_size", n_blocks.alias("n")).join(blocks, "sk").withColumn("most", F.col("n") * repeat_limit)
    quotas = sainte_lague(parties, "sk", "cell_size", "source_blocks", "shard", "most")
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "sk", F.lit(":"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("bigint")
    some = F.col("n") > 0
    quotas = quotas.select("sk", "shard", "source_size", "target", "n",
                           F.when(some, F.floor(F.col("won") / F.col("n"))).otherwise(F.lit(0)).cast("bigint").alias("passes"),
                           F.when(some, F.col("won") % F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("r"),
                           F.when(some, place % F.col("n")).otherwise(F.lit(0)).alias("c"))
    w = Window.partitionBy("sk", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.join(quotas, ["sk", "shard"]).withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    last = selected_before(F.col("before") + F.col("size"), block_words) - selected_before(F.col("before"), block_words)
    taken = F.when(F.col("n") > 0, F.col("passes") * F.col("size") + last).otherwise(F.lit(0))
    return rows.select("doc_id", "text_key", "source_key", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def selected_before(words: Column, block_words: int) -> Column:
    """Words in selected blocks before a place of a shard: block b is selected
    where (b * r + c) / n passes a whole number on the way to b + 1."""
    block, inside = F.floor(words / block_words), words % block_words
    passed = lambda b: F.floor((b * F.col("r") + F.col("c")) / F.col("n"))
    return passed(block) * block_words + (passed(block + 1) - passed(block)) * inside


def mix(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    return mixed_rows(docs, **settings).drop("text_key", "source_key")


def repeat_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each as often as its taken words fill it, begun
    ones included; those with no word taken go.  The text moves once, by id."""
    taken = mixed_rows(docs, **settings).where("taken > 0").groupBy(order_id("doc_id").alias("_id"), "text_key", "source_key").agg(
        F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("_times"), F.count("*").alias("_rows"))
    rows = docs.select(packed(docs), order_id("doc_id").alias("_id"), F.xxhash64("text").alias("text_key"),
                       F.xxhash64("source").alias("source_key")).join(taken, ["_id", "text_key", "source_key"])
    # rows that repeat an id, text and source share their copies, the first ones take what is left over
    lone = rows.where("_rows = 1").withColumn("_place", F.lit(1))
    place = F.row_number().over(Window.partitionBy("_id", "text_key", "source_key").orderBy(F.lit(0)))
    rows = lone.unionByName(rows.where("_rows > 1").withColumn("_place", place))
    times = F.floor(F.col("_times") / F.col("_rows")) + F.when(F.col("_place") <= F.col("_times") % F.col("_rows"), 1).otherwise(0)
    rows = rows.withColumn("_t", times.cast("int")).where("_t > 0")
    return unpacked(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_t")))), docs.columns)
