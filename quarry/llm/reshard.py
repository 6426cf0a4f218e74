"""Resharding by minimum-cost flow.

An old layout of shards is to become a new one with given capacities.  The
rows of a shard are grouped into ``BLOCKS`` blocks (sixteen a shard at least)
by a hash of the text (equal texts share a block); a block too large to
balance with is cut further by another hash of the text.  Only a text whose
copies fill more than 1 / ``TORN`` of a shard is cut by a hash of the id.  Only
block sizes reach the driver, whose number is bounded whatever the data
(``BLOCKS`` + 4 * shards * ``FINE``).  A minimum
cost flow from old shard sizes to new capacities, where staying is free and a
byte moved costs 1, tells how many bytes go from which shard to which; blocks
are chosen to make up those amounts.  Shards that lose blocks are rewritten
and blocks that arrive are written beside; files of the other shards stay as
they are and are listed in the new layout.  Text is not shuffled: where a row
goes follows from its block, which the row itself tells.

Size of a row: UTF-8 bytes of its text (null: none) plus 1.  Null ids and
repeated rows are rows like others; an empty table has an empty layout.  All
columns are kept; the columns the layout adds carry the prefix ``_``.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.order import global_row_number
from quarry.session import scratch_path

BLOCKS = 4096
#: A block above 1 / FINE of a shard is cut further.
FINE = 64
#: Equal texts above 1 / TORN of a shard together are cut by id.
TORN = 2


def row_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")


def text_crc32() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")))


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (i, j) -> flow of least total cost(i, j) that move all supply
    to sinks of the given capacity (successive shortest paths)."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(a, b, cap, c):
        for x, y, r, p in ((a, b, cap, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)
    total = sum(supply)
    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, total, cost(i, j))
    for j, d in enumerate(demand):
        arc(n + j, sink, d, 0)
    while True:
        best, via = {source: 0}, {}
        queue, waiting = deque([source]), {source}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for e in graph[x]:
                c = best[x] + price[e]
                if room[e] and c < best.get(to[e], math.inf):
                    best[to[e]], via[to[e]] = c, e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if sink not in via:
            break
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flow = {}
    for e in range(0, len(to), 2):
        if to[e] not in (source, sink) and to[e ^ 1] < n and room[e ^ 1]:
            flow[to[e ^ 1], to[e] - n] = room[e ^ 1]
    return flow


def choose_blocks(blocks: list[tuple], old: list[int], sizes: list[int], n_new: int,
                  capacity: list[int]) -> list[int]:
    """New shard of every block: transfers of the minimum-cost flow made up
    of blocks, then single moves and swaps while they level the shards."""
    n_old = max(old, default=-1) + 1
    held = [0] * n_old
    for s, b in zip(old, sizes):
        held[s] += b
    flow = min_cost_flow(held, capacity, lambda i, j: int(i != j))
    new = list(old)
    by_shard: dict[int, list[int]] = {}
    for k in sorted(range(len(blocks)), key=lambda k: (-sizes[k], blocks[k])):
        by_shard.setdefault(old[k], []).append(k)
    for i in range(n_old):
        due = {j: f for (a, j), f in flow.items() if a == i and j != i}
        stays = flow.get((i, i), 0)
        for k in by_shard.get(i, []):                    # largest first: stay if it fits, else to the largest want
            j = max(due, key=lambda j: (due[j], -j), default=None)
            if i < n_new and (sizes[k] <= stays or j is None or due[j] <= 0 and stays >= due[j]):
                stays -= sizes[k]
                new[k] = i
            else:
                new[k] = j if j is not None else i % n_new
                if j is not None:
                    due[j] -= sizes[k]
    return level(new, sizes, capacity)


def level(new: list[int], sizes: list[int], capacity: list[int]) -> list[int]:
    """Move a block from a fuller to an emptier shard, or swap two, as long as
    that brings both nearer to their capacities (their squares shrink with
    every change, so it ends)."""
    n = len(capacity)
    held = [-c for c in capacity]
    inside: list[list[int]] = [[] for _ in range(n)]
    for k, s in enumerate(new):
        held[s] += sizes[k]
        inside[s].append(k)
    while True:
        order = sorted(range(n), key=held.__getitem__)
        # the widest pair of shards that a change brings together; one huge block may hold up the widest
        pairs = sorted(((a, b) for b in order for a in order if held[a] - held[b] > 1), key=lambda p: held[p[1]] - held[p[0]])
        for a, b in pairs:
            found = _best_change(inside[a], inside[b], sizes, held[a] - held[b])
            if found:
                break
        else:
            break
        for k, s, t in ((found[0], a, b), (found[1], b, a)):
            if k is not None:
                inside[s].remove(k)
                inside[t].append(k)
                held[s] -= sizes[k]
                held[t] += sizes[k]
                new[k] = t
    return new


def _best_change(full: list[int], empty: list[int], sizes: list[int], gap: int) -> tuple | None:
    """(block to give, block to take or None) that narrows ``gap`` most, if any does."""
    best, found, want = gap, None, gap // 2
    give, take = sorted(full, key=sizes.__getitem__), sorted(empty, key=sizes.__getitem__)
    j = 0
    for k in give:
        if abs(gap - 2 * sizes[k]) < best:
            best, found = abs(gap - 2 * sizes[k]), (k, None)
        while j + 1 < len(take) and abs(sizes[k] - sizes[take[j + 1]] - want) <= abs(sizes[k] - sizes[take[j]] - want):
            j += 1
        if take and abs(gap - 2 * (sizes[k] - sizes[take[j]])) < best:
            best, found = abs(gap - 2 * (sizes[k] - sizes[take[j]])), (k, take[j])
    return found


@dataclass
class Layout:
    """A set of shards: folders by shard, written as ``_shard=K``."""
    spark: SparkSession
    n_shards: int
    parts: list[tuple[str, list[int] | None]]           # (folder, shards that it still serves; None: all)
    schema: object

    def read(self) -> DataFrame:
        frames = []
        for path, shards in self.parts:
            df = self.spark.read.schema(self.schema).parquet(path)
            frames.append(df if shards is None else df.where(F.col("_shard").isin(shards)))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def write_layout(docs: DataFrame, n_shards: int, id_col: str = "doc_id") -> Layout:
    """First placement, by a hash of the text: groups of equal texts share a
    shard.  Sizes, checksums and blocks are kept in the files."""
    crc = text_crc32()
    rows = docs.withColumns({"_size": row_size(), "_crc32": crc})
    rows = rows.withColumn("_block", (F.col("_crc32") % max(BLOCKS, 16 * n_shards)).cast("int"))
    rows = rows.withColumn("_text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).cast("int"))
    rows = rows.withColumn("_shard", (F.col("_block") % n_shards).cast("int"))
    path = scratch_path(docs.sparkSession, "shards-old")
    rows.write.partitionBy("_shard").parquet(path)
    return Layout(docs.sparkSession, n_shards, [(path, None)], rows.schema)


_CUT = ["_shard", "_block", "_big", "_cuts", "_cut"]


def _cuts(rows: DataFrame, limit: int, torn: int) -> DataFrame:
    """``rows`` with _big (the hash of a text that is cut by id, else 0),
    _cuts and _cut.  At most total / torn texts and total / limit blocks are
    broadcast."""
    spark = rows.sparkSession
    whole = [r["_block"] for r in rows.groupBy("_shard", "_block").agg(F.sum("_size").alias("b")).where(F.col("b") > limit)
             .select("_block").distinct().collect()]
    if not whole:
        return rows.withColumns({"_big": F.lit(0).cast("bigint"), "_cuts": F.lit(1), "_cut": F.lit(0)})
    large = rows.join(F.broadcast(spark.createDataFrame([(b,) for b in whole], "_block int")), "_block", "left_semi")
    texts = [(r["_block"], r["_text"], 2 * -(-r["b"] // limit)) for r in large.groupBy("_block", "_text").agg(F.sum("_size").alias("b"))
             .where(F.col("b") > torn).collect()]
    big = F.broadcast(spark.createDataFrame(texts, "_block int, _text bigint, _pieces int"))
    rest = large.join(big, ["_block", "_text"], "left_anti").groupBy("_block").agg(F.sum("_size").alias("b")).collect()
    cuts = F.broadcast(spark.createDataFrame([(r["_block"], 2 * -(-r["b"] // limit)) for r in rest], "_block int, _cuts int"))
    found = rows.join(big, ["_block", "_text"], "left").join(cuts, "_block", "left")
    is_big = F.col("_pieces").isNotNull()
    n = F.when(is_big, F.col("_pieces")).otherwise(F.coalesce("_cuts", F.lit(1)))
    return found.withColumn("_cuts", n).withColumn("_big", F.when(is_big, F.col("_text")).otherwise(F.lit(0).cast("bigint"))) \
        .withColumn("_cut", F.pmod(F.when(is_big, F.col("_part")).otherwise(F.shiftright("_text", 20)), F.col("_cuts")).cast("int")).drop("_pieces")


def reshard(layout: Layout, n_shards: int, capacity: list[int] | None = None) -> Layout:
    """The layout with ``n_shards`` shards of the given capacities (default:
    equal), moving the fewest bytes; only affected shards are rewritten."""
    spark, rows = layout.spark, layout.read()
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    if capacity is None:
        capacity = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    cut = _cuts(rows, max(1, total // (n_shards * FINE)), max(1, total // (n_shards * TORN)))
    blocks = sorted(tuple(r) for r in cut.groupBy(*_CUT).agg(F.sum("_size").alias("bytes")).collect())
    new = choose_blocks(blocks, [b[0] for b in blocks], [b[5] for b in blocks], n_shards, capacity)
    moved = [(*b[:5], j) for b, j in zip(blocks, new) if b[0] != j]
    if not moved:
        return Layout(spark, n_shards, layout.parts, layout.schema)
    losing = sorted({b[0] for b in moved})
    goes = F.broadcast(spark.createDataFrame(moved, "_shard int, _block int, _big bigint, _cuts int, _cut int, _goes int"))
    affected = cut.where(F.col("_shard").isin(losing)).join(goes, _CUT, "left").withColumn("_shard", F.coalesce("_goes", "_shard"))
    path = scratch_path(spark, "shards-new")
    affected.select(*rows.columns).write.partitionBy("_shard").parquet(path)
    parts = []
    for folder, shards in layout.parts:
        still = [s for s in (range(layout.n_shards) if shards is None else shards) if s not in losing]
        if still:
            parts.append((folder, still))
    return Layout(spark, n_shards, [*parts, (path, None)], layout.schema)


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``slot``: gapless numbers from 0 within each ``shard``, in ``order``."""
    numbered = global_row_number(rows, ["shard", *order], name="_n")
    first = F.broadcast(numbered.groupBy("shard").agg(F.min("_n").alias("_first")))
    return numbered.join(first, "shard").withColumn("slot", F.col("_n") - F.col("_first")).drop("_n", "_first")


def balanced(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Place by hash, reshard to equal bytes, read the files back."""
    layout = reshard(write_layout(docs.select("doc_id", "text"), n_shards), n_shards)
    rows = layout.read().select("doc_id", F.col("_size").alias("size"), F.col("_crc32").alias("text_crc32"),
                                F.col("_shard").alias("shard"))
    return with_slots(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
