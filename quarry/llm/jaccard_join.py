"""Join of documents whose word shingle sets have a Jaccard similarity of at
least a threshold, and its connected components.

The document by shingle matrix is never multiplied whole:

1. Documents with equal sets form a class; one document stands for it.
2. A bounded table of counters (hashed shingles, counted over all documents)
   orders the shingles from rare to frequent.  With a threshold t, two sets
   that link share a shingle among the first n - ceil(t n) + 1 of each in any
   common order (the prefix), so only prefixes are multiplied, in blocks of
   shingles: a task pairs the documents of its shingles and sums overlap
   counts.  Pairs whose sizes or whose overlap so far rule out the threshold
   are discarded.  A shingle in the prefix of more than ``PAIRS_UP_TO``
   documents emits a star (each document with the smallest), not pairs.
3. What is left joins the documents into candidate clusters.  Within each,
   the whole sets are multiplied exactly, block by block of at most
   ``BLOCK_DOCS`` documents of similar size; a block emits a spanning forest
   of its links, so groups of thousands of near copies give thousands of
   rows, not millions.  No candidate is dropped and no partner capped.

Sets come from whole texts.  Null texts and texts without a word have an
empty set and link with nothing.  A null id is a document like others (its
component is the smallest id that is not null, or null).  Repeated rows are
equal sets.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import added_up, connected_components, order_id, packed, serve, ship_package, slices, unpacked
from quarry.llm.shingles import release, shingle_sets
from quarry.session import written

PAIRS_UP_TO = 64
BLOCK_DOCS = 256
BLOCK_SHINGLES = 1 << 20
TOKENS_PER_TASK = 500_000
#: Pairs that a task holds at once; their counts are added up by the next grouping.
PAIRS_PER_STEP = 1 << 20
#: Broadcast the list of candidate documents up to this many rows (16 bytes each).
BROADCAST_ROWS = 1_000_000
SLICE = 4096
_LIST = "k bigint, n int, doc_id bigint, h bigint, prefix array<bigint>, common array<bigint>"


def least_overlap(n, percent: int):
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       text_hash().alias("h"))


def text_hash() -> Column:
    """Tells rows with the same id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    serve("Jaccard join", release)
    return shingle_sets([t.encode() for t in batch.column("text").to_pylist()], size)


def set_key(s: np.ndarray) -> int:
    """64-bit digest of a set: the class of a document."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_counts(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Documents per hashed shingle, over all rows: ``1 << bits`` counters,
    added up in levels of tasks; only the sum reaches the driver."""
    step = min(SLICE, 1 << bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in slices(batches):
            for s in _sets(batch, size):
                np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(0, 1 << bits, step), pa.int32()),
            pa.array([total[k:k + step].tobytes() for k in range(0, 1 << bits, step)])], ["part", "counts"])

    parts = _text_rows(docs).select("text").mapInArrow(count, "part int, counts binary")
    out = np.zeros(1 << bits, np.int64)
    for r in added_up(parts, "part", "int").collect():
        out[r["part"]:r["part"] + step] = np.frombuffer(r["counts"], np.int64)
    return out


def prefixes(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(k, n, doc_id, h, prefix, common): each document's class, set size and
    prefix; ``common`` are the prefix shingles whose counter is so high that
    they may be in very many documents."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    bits = len(counts).bit_length() - 1
    high = int(4 * counts.mean()) + 1000

    def run(batches):
        table = shared.value
        for batch in slices(batches):
            keys, sizes, rare, common = [], [], [], []
            for s in _sets(batch, size):
                n = len(s)
                keys.append(set_key(s))
                sizes.append(n)
                if not n:
                    rare.append(s.view(np.int64))
                    common.append(s.view(np.int64))
                    continue
                c = table[(s >> np.uint64(64 - bits)).astype(np.int64)]
                first = np.argsort(c, kind="stable")[:n - least_overlap(n, percent) + 1]
                often = c[first] >= high
                p = s[first].view(np.int64)
                rare.append(p[~often])
                common.append(p[often])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), batch.column("doc_id"),
                batch.column("h"), _lists(rare), _lists(common)], ["k", "n", "doc_id", "h", "prefix", "common"])

    return _text_rows(docs).mapInArrow(run, _LIST)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _overlaps(tokens: DataFrame, percent: int) -> DataFrame:
    """Product of a block of shingles per task: rows (a, b, na, nb, shared)
    with a < b; shared is null on a star's edge."""
    schema = "a bigint, b bigint, na int, nb int, shared bigint"

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t, k, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        order = np.lexsort((k, t))
        t, k, n = t[order], k[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        count = np.diff(np.r_[first, len(t)])
        place = np.arange(len(t)) - np.repeat(first, count)
        count = np.repeat(count, count)
        # stars of the frequent ones
        far = (count > PAIRS_UP_TO) & (place > 0)
        head = np.arange(len(t)) - place
        stars = np.unique(np.stack([k[head[far]], k[far]], 1), axis=0)
        if len(stars):
            none = pa.array([None] * len(stars), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1]), none.cast(pa.int32()),
                                              none.cast(pa.int32()), none], ["a", "b", "na", "nb", "shared"])
        # pairs of the others: runs of whole shingles that give about PAIRS_PER_STEP
        paired = np.where(count <= PAIRS_UP_TO, place, 0)
        step = np.cumsum(paired)[head] // PAIRS_PER_STEP
        some = np.flatnonzero((count > 1) & (count <= PAIRS_UP_TO))
        for small in np.split(some, np.flatnonzero(np.diff(step[some])) + 1):
            found = _pairs(small, place, count, k, n, percent)
            if found is not None:
                yield found

    return tokens.mapInArrow(run, schema)


def _pairs(small: np.ndarray, place, count, k, n, percent: int) -> pa.RecordBatch | None:
    """Overlap counts of the pairs among the entries ``small``, by distance
    in the run of one shingle."""
    left, right = [], []
    for gap in range(1, PAIRS_UP_TO):
        i = small[place[small] + gap < count[small]]
        if not len(i):
            break
        j = i + gap
        fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        left.append(i[fits])
        right.append(j[fits])
    if not sum(map(len, left)):
        return None
    i, j = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((k[j], k[i]))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.r_[True, (k[i[1:]] != k[i[:-1]]) | (k[j[1:]] != k[j[:-1]])])
    sums = np.diff(np.r_[new, len(i)])
    i, j = i[new], j[new]
    return pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(k[j]), pa.array(n[i].astype(np.int32)),
                                       pa.array(n[j].astype(np.int32)), pa.array(sums.astype(np.int64))],
                                      ["a", "b", "na", "nb", "shared"])


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes that may link: pairs that keep to the
    bounds, and stars of frequent shingles."""
    tokens = classes.select(F.explode("prefix").alias("t"), "k", "n")
    n = classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    pairs = _overlaps(tokens.repartition(max(1, math.ceil(n / TOKENS_PER_TASK)), "t"), percent)
    sums = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"),
                                       F.sum("shared").alias("shared"), F.count("*").alias("rows"),
                                       F.count("shared").alias("counted"))
    # beyond the prefix of the set whose prefix ends first, all may be shared
    beyond = F.greatest(F.ceil(F.lit(percent) * F.col("na") / 100), F.ceil(F.lit(percent) * F.col("nb") / 100)) - 1
    kept = sums.where((F.col("counted") < F.col("rows"))
                      | ((F.col("shared") + beyond) * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb"))))
    often = classes.select(F.explode("common").alias("t"), "k")
    least = often.groupBy("t").agg(F.min("k").alias("a"), F.count("*").alias("c")).where("c > 1")
    stars = often.join(least, "t").where("k <> a").select("a", F.col("k").alias("b"))
    return kept.select("a", "b").union(stars).distinct()


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among some sets: overlap counts by
    blocks of columns (shingles in at least two of the sets)."""
    n = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[col] > 1
    new = np.cumsum(df > 1) - 1
    row, col = row[shared], new[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((len(sets), len(sets)))
    width = 2048
    cuts = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + width + 1, width))
    for a, b in zip(cuts[:-1], cuts[1:]):
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], col[a:b] % width] = 1
        overlap += m @ m.T
    overlap = np.rint(overlap).astype(np.int64)
    linked = 100 * overlap >= percent * (n[:, None] + n[None] - overlap)
    edges, seen = [], np.zeros(len(sets), bool)
    for root in range(len(sets)):
        if seen[root]:
            continue
        seen[root] = True
        reached = [root]
        for x in reached:
            more = np.flatnonzero(linked[x] & ~seen)
            seen[more] = True
            reached += more.tolist()
            edges += [(x, int(y)) for y in more]
    return edges


def _blocks(picked: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(k, task, cluster): the tasks that get each document of a cluster.
    Small clusters share tasks whole; a large one is cut by set size (only
    neighbouring size classes can link) and by hash, a task per block pair."""
    size_class = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    total = sizes.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    bins = max(1, math.ceil(total / BLOCK_SHINGLES))
    rows = picked.join(sizes, "cluster").withColumn("c", size_class)
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("shingles") <= 2 * BLOCK_SHINGLES)
    few = rows.where(small).select("k", F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("task"), "cluster")
    many = rows.where(~small)
    per = many.groupBy("cluster", "c").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS),
                                                      F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("m"))
    near = lambda d, name: per.select("cluster", (F.col("c") - d).alias("c"), F.col("m").alias(name))
    many = many.join(per, ["cluster", "c"]).join(near(1, "up"), ["cluster", "c"], "left").join(
        near(-1, "down"), ["cluster", "c"], "left").withColumn("s", F.pmod(F.xxhash64("k"), F.col("m")).cast("int"))

    def tasks(count, key):
        return F.when(count.isNull() | (count < 1), F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), count - 1), key))
    at = lambda c, s, d, r: F.concat_ws(".", F.lit("b"), F.col("cluster"), c, s, d, r)
    c, s = F.col("c"), F.col("s")
    keys = F.concat(tasks(F.col("m"), lambda x: at(c, F.least(s, x), c, F.greatest(s, x))),
                    tasks(F.col("up"), lambda x: at(c, s, c + 1, x)),
                    tasks(F.col("down"), lambda x: at(c - 1, x, c, s)))
    return few.union(many.select("k", F.explode(keys).alias("task"), "cluster"))


def exact_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning forest (a, b) of all links within the candidate clusters."""
    spark = docs.sparkSession
    picked = written(classes.join(clusters.withColumnRenamed("node", "k").withColumnRenamed("component", "cluster"), "k")
                     .select("k", "n", "doc_id", "cluster"), "jaccard-picked")
    count = picked.count()
    wanted = picked.select(F.col("doc_id").alias("_id"), "k")
    if count <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = _text_rows(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("k", "text")

    def run(batches):
        for batch in slices(batches):
            sets = _sets(batch, size)
            right = [i for i, (k, s) in enumerate(zip(batch.column("k").to_pylist(), sets)) if set_key(s) == k]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(right, pa.int64())),
                                              pa.array([sets[i].tobytes() for i in right], pa.binary())], ["k", "shingles"])

    sets = texts.mapInArrow(run, "k bigint, shingles binary")
    sizes = picked.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    dealt = _blocks(picked.select("k", "n", "cluster"), sizes, percent).join(sets, "k")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, part in pdf.drop_duplicates("k").groupby("cluster", sort=False):
            if len(part) > 1:
                keys = part["k"].tolist()
                found = link_forest([np.frombuffer(b, np.uint64) for b in part["shingles"]], percent)
                edges += [(keys[x], keys[y]) for x, y in found]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("task").applyInPandas(lambda pdf: product(pdf), "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, kept) for every row of ``docs``:
    sets of distinct ``size``-word shingles, links from ``percent`` per cent
    on.  ``h`` is the hash of the text; kept are the rows of one (doc_id, h)
    of each component, the smallest."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.count("*")).first()[0]
    bits = min(22, max(12, math.ceil(math.log2(rows + 1))))
    counts = shingle_counts(docs, size, bits)
    base = written(prefixes(docs, size, percent, counts), "jaccard-prefixes")
    members = base.select("doc_id", "h", "n", "k")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = base.where("n > 0").groupBy("k").agg(
        F.first("n").alias("n"), F.min(first).alias("first"), F.first("prefix").alias("prefix"),
        F.first("common").alias("common")).withColumn("doc_id", F.col("first.doc_id"))
    classes = written(classes, "jaccard-classes")
    clusters = connected_components(candidate_edges(classes, percent))
    links = exact_links(docs, classes, clusters, size, percent)
    found = connected_components(links)
    lone = classes.select("k", "first").join(found.withColumnRenamed("node", "k"), "k", "left") \
        .withColumn("component", F.coalesce("component", "k"))
    least = lone.groupBy("component").agg(F.min("first").alias("least"))
    named = lone.join(least, "component").select("k", "least")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    return members.where("n > 0").join(named, "k").select(
        "doc_id", "h", F.col("n").cast("bigint").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), kept.alias("kept")) \
        .union(members.where("n = 0").select("doc_id", "h", F.lit(0).cast("bigint"), F.col("doc_id"), F.lit(True)))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    return jaccard_groups(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component
    stays.  The text moves once, by id."""
    kept = jaccard_groups(docs, size, percent).where("kept").select(
        order_id("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.select(packed(docs), order_id("doc_id").alias("_id"), text_hash().alias("_h")).join(kept, ["_id", "_h"])
    one = Window.partitionBy("_id", "_h").orderBy(F.lit(0))
    return unpacked(rows.withColumn("_n", F.row_number().over(one)).where("_n = 1"), docs.columns)
