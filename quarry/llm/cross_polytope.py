"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the coordinate of largest magnitude with its sign.
``functions`` such hashes make a bucket, ``tables`` tables of buckets are
kept, and in each a vector also visits the buckets next in likelihood
(multiprobe: the second coordinate in the hash of smallest gap).  Vectors
that meet in a bucket, one of them at home there, are compared by cosine in
double precision, so every link is verified; only the recall is a matter of
chance (a trial of pairs at cosine 0.9 sets the number of tables).

Equal vectors form a class with its number of members and are hashed once.  A
bucket of more than ``BLOCK`` classes is cut into blocks, every pair of
blocks a task of its own.  A pair that meets several times is counted where
it meets first, which both signatures tell, so tasks return a count per class
and a spanning forest, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are components of their own; vectors of different length do
not link.  A null id counts as a vector.  Repeated rows are vectors of their
own.  Labels and other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import connected_components, ship_package
from quarry.session import written

BLOCK = 1024
ROWS_PER_TASK = 40_000
PAIRS_AT_ONCE = 100_000
PROBES = 2
MISSED = 0.004
#: No higher chance than this (to the power of the hashes) is taken from the trial.
AGREE = 0.65
#: Random pairs at cosine 0.9, and tables, of the trial that sets the number of tables.
TRIAL_PAIRS, TRIAL_TABLES = 200, 24


def plan(n: int, dim: int, probes: int = PROBES) -> tuple[int, int]:
    """(hashes per table, tables): about as many buckets as a few vectors
    each, and tables enough to miss a share of ``MISSED`` at cosine 0.9."""
    side = 2 << max(0, (dim - 1).bit_length())
    functions = max(1, math.ceil(math.log(max(2, n / 8)) / math.log(side)))
    return functions, max(1, math.ceil(math.log(MISSED) / math.log(1 - meeting_chance(functions, dim, probes))))


@functools.lru_cache(maxsize=64)
def meeting_chance(functions: int, dim: int, probes: int = PROBES) -> float:
    """Chance that two vectors at cosine 0.9 meet in a table, from a seeded
    trial of random pairs, less two standard errors (0.01 at least)."""
    rng = np.random.default_rng([7, functions, dim])
    a = rng.normal(size=(TRIAL_PAIRS, dim))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    b = rng.normal(size=a.shape)
    if dim > 1:
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.9 * a + math.sqrt(0.19) * b / np.sqrt((b * b).sum(1, keepdims=True))
    else:
        b = a
    sa, sb = (signatures(x, functions, TRIAL_TABLES, probes, seed=9) for x in (a, b))
    met = ((sa[:, :, :1] == sb) | (sb[:, :, :1] == sa)).any(2)
    error = max(met.mean(0).std() / math.sqrt(TRIAL_TABLES), met.mean(1).std() / math.sqrt(TRIAL_PAIRS))
    return float(max(0.01, min(met.mean() - 2 * error, AGREE ** functions)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two)."""
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def signatures(x: np.ndarray, functions: int, tables: int, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """uint32 (rows, tables, probes): the buckets of unit vectors; the first
    of a table is home."""
    n, dim = x.shape
    side = 1 << max(0, (dim - 1).bit_length())
    padded = np.zeros((n, side))
    padded[:, :dim] = x
    rng = np.random.default_rng([seed, dim])
    out = np.empty((n, tables, probes), np.uint32)
    for t in range(tables):
        best, gap = np.empty((n, functions, 2), np.int64), np.empty((n, functions))
        for f in range(functions):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), side))
            size = np.abs(y)
            first = size.argmax(1)
            rows = np.arange(n)
            top = size[rows, first]
            size[rows, first] = -1
            second = size.argmax(1)
            gap[:, f] = top - size[rows, second]
            for k, at in enumerate((first, second)):
                best[:, f, k] = at * 2 + (y[rows, at] < 0)
        order = gap.argsort(1)
        for p in range(probes):
            key = np.full(n, dim * 31 + t, np.uint64)
            for f in range(functions):
                # probe 0 takes every best; probe p takes the second best where the bits of p say,
                # bit 0 for the hash of smallest gap
                rank = np.argsort(order, 1)[:, f]
                other = (p >> np.minimum(rank, 30)) & 1
                key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ best[np.arange(n), f, other].astype(np.uint64)
                key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, t, p] = (key >> np.uint64(32)).astype(np.uint32)
    return out


def _meets_first(si: np.ndarray, sj: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``table`` and ``key`` are where pairs with signatures si, sj
    meet first (smallest table, then smallest key)."""
    a = (si[:, :, :1] == sj).any(2)
    b = (sj[:, :, :1] == si).any(2)
    first = (a | b).argmax(1)
    rows = np.arange(len(si))
    top = np.uint64(1 << 32)
    ka = np.where(a[rows, first], si[rows, first, 0].astype(np.uint64), top)
    kb = np.where(b[rows, first], sj[rows, first, 0].astype(np.uint64), top)
    return (first == table) & (np.minimum(ka, kb) == key)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indices of the pairs that join two trees."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    kept = []
    for at, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            kept.append(at)
    return np.array(kept, np.int64)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, k, vec): k is the digest of the vector's bytes; null if it can't link."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            keys, vecs = [], []
            for v in batch.column("v"):
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False)
                if x is None or not len(x) or v.values.null_count or not np.isfinite(x).all() or not np.any(x):
                    keys.append(None)
                    vecs.append(None)
                    continue
                with np.errstate(over="ignore"):
                    b = packed(x)
                keys.append(int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True))
                vecs.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.int64()), pa.array(vecs, pa.binary())],
                                             ["id", "k", "vec"])
    return rows.mapInArrow(run, "id bigint, k bigint, vec binary")


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes: 4 a component where that loses nothing, else 8."""
    x = x + 0.0                                             # -0.0 and 0.0 are equal
    small = x.astype(np.float32)
    return b"f" + small.tobytes() if np.array_equal(small, x) else b"d" + x.tobytes()


def unit(vecs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, np.float32 if b[:1] == b"f" else np.float64, offset=1) for b in vecs]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(vecs: list[bytes]):
    """(indices, bytes) of the vectors of each length."""
    lens = np.array([len(b) // (4 if b[:1] == b"f" else 8) for b in vecs])
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield at, [vecs[i] for i in at]


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                 probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    ship_package(spark)
    base = written(_classes(vectors, id_col, vector_col), "polytope-vectors")
    classes = written(base.where("k IS NOT NULL").groupBy("k").agg(
        F.first("vec").alias("vec"), F.count("*").alias("members"), F.min("id").alias("least")), "polytope-classes")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(4))).first()
    functions, tables = plan(n, width // 4, probes)

    def sign(batches):
        for batch in batches:
            vecs, k = batch.column("vec").to_pylist(), batch.column("k").to_numpy()
            for at, same in _by_length(vecs):
                for part in np.array_split(np.arange(len(at)), max(1, len(at) // 4096)):
                    sig = signatures(unit([same[i] for i in part]), functions, tables, probes)
                    yield pa.RecordBatch.from_arrays([pa.array(k[at[part]]), pa.array([s.tobytes() for s in sig], pa.binary()),
                                                      pa.array([sorted(set(((np.arange(tables, dtype=np.int64)[:, None] << 32)
                                                                            | s).ravel().tolist())) for s in sig],
                                                               pa.list_(pa.int64()))], ["k", "sig", "buckets"])

    signed = written(classes.select("k", "vec").mapInArrow(sign, "k bigint, sig binary, buckets array<bigint>"), "polytope-signed")
    visits = signed.select("k", F.explode("buckets").alias("bucket"))
    counts = visits.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1") \
        .withColumn("m", F.ceil(F.col("c") / BLOCK).cast("int"))
    met = visits.join(counts, "bucket").withColumn("s", F.pmod(F.xxhash64("k"), F.col("m")).cast("int"))
    other = F.sequence(F.lit(0), F.col("m") - 1)
    met = met.select("k", "bucket", "s", F.explode(F.transform(other, lambda x: F.struct(
        F.least("s", x).alias("lo"), F.greatest("s", x).alias("hi")))).alias("block"))
    dealt = met.join(classes.join(signed.select("k", "sig"), "k").select("k", "vec", "members", "sig"), "k")
    total = n * tables * probes
    dealt = dealt.repartition(max(1, math.ceil(total / ROWS_PER_TASK)), "bucket", "block.lo", "block.hi").select(
        "bucket", F.col("block.lo").alias("lo"), F.col("block.hi").alias("hi"), "s", "k", "members", "vec", "sig")

    def compare(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held)
        bucket, lo, hi, s, k, members = (got.column(i).to_numpy() for i in range(6))
        vecs, sigs = got.column("vec").to_pylist(), got.column("sig").to_pylist()
        order = np.lexsort((hi, lo, bucket))
        cuts = np.flatnonzero(np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (lo[order][1:] != lo[order][:-1])
                                    | (hi[order][1:] != hi[order][:-1])])
        for group in np.split(order, cuts[1:]):
            if len(group) < 2:
                continue
            for at, same in _by_length([vecs[i] for i in group]):
                rows = group[at]
                x = unit(same)
                near = np.triu(x @ x.T >= least, 1)
                if lo[rows[0]] != hi[rows[0]]:
                    near &= s[rows][:, None] != s[rows][None]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                sig = np.stack([np.frombuffer(sigs[r], np.uint32) for r in rows]).reshape(len(rows), tables, probes)
                here, home = int(bucket[rows[0]]), np.zeros(len(i), bool)
                for a in range(0, len(i), PAIRS_AT_ONCE):
                    z = slice(a, a + PAIRS_AT_ONCE)
                    home[z] = _meets_first(sig[i[z]], sig[j[z]], here >> 32, np.uint64(here & 0xFFFFFFFF))
                i, j = i[home], j[home]
                if not len(i):
                    continue
                links = np.zeros(len(rows), np.int64)
                np.add.at(links, i, members[rows[j]])
                np.add.at(links, j, members[rows[i]])
                some = np.flatnonzero(links)
                tree = _forest(len(rows), i, j)
                none = [None] * len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[k[rows[some]], k[rows[i[tree]]]]),
                    pa.array(none + k[rows[j[tree]]].tolist(), pa.int64()),
                    pa.array(links[some].tolist() + [None] * len(tree), pa.int64())], ["k", "to", "links"])

    found = written(dealt.mapInArrow(compare, "k bigint, to bigint, links bigint"), "polytope-links")
    parts = connected_components(found.where("to IS NOT NULL"), "k", "to")
    sums = found.where("to IS NULL").groupBy("k").agg(F.sum("links").alias("links"))
    named = classes.select("k", "members", "least").join(parts.withColumnRenamed("node", "k"), "k", "left") \
        .withColumn("component", F.coalesce("component", "k"))
    low = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(low, "component").join(sums, "k", "left").select(
        "k", "component_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    rows = base.where("k IS NOT NULL").select("id", "k").join(named, "k").select(
        F.col("id").alias("vec_id"), "n_links", "component_id")
    rows = rows.union(base.where("k IS NULL").select("id", F.lit(0).cast(T.LongType()), "id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
