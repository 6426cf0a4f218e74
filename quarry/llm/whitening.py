"""Embedding whitening from the exact characteristic polynomial.

Entries become the integers z = floor(64 c) (a constant added to all of them
changes no covariance).  Counts, sums and the products z z' are added up
exactly, so M = n * sum(z z') - S S' is the integer scatter, n squared times
the covariance.

1. The characteristic polynomial of M modulo many primes, by reduction to
   Hessenberg form, a prime a row of a Spark job; Chinese remaindering gives
   its integer coefficients.
2. All its roots are real, so the sign changes of p(x + a) count exactly the
   roots beyond a (Descartes).  Per component, a row of a second job: bisection
   by that count until its root is alone, then by the sign of p, to
   ``ROOT_BITS`` relative bits.  Roots that stay together within
   ``CLUSTER_BITS`` count as one root of that multiplicity.
3. The null space of M - root, by elimination with complete pivoting in
   fixed-point numbers of some hundred bits and one step of inverse iteration,
   gives the component (an orthonormal basis for a multiple root).

Only sums (of the dimension squared) and components reach the driver; the work
of 1 to 3 depends on the dimension alone and is spread over tasks.

Rows whose vector is null or empty, holds null or non-finite entries, or has
another than the commonest length (the longest of several) are dropped.
Entries beyond 2**62 / 64 count as that.  Components of eigenvalue 0 are not
returned: equal vectors, a single vector and an empty table give no rows.  A
deviation beyond a long is null.  Null ids and repeated rows are rows of their
own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import serve, ship_package

SCALE = 64
COMPONENTS = 32
LARGEST = 1 << 62
ROOT_BITS, CLUSTER_BITS = 110, 100
CHUNK = 4096
_LIMB = 40


# ------------------------------------------------------------------ exact sums
def vectors(batch: pa.RecordBatch, column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix of doubles) of the usable rows of a batch."""
    lists = batch.column(column)
    lens = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)       # null entries become NaN
    rows = np.flatnonzero(lens == dim)
    x = flat[(np.cumsum(lens) - lens)[rows][:, None] + np.arange(dim)]
    fine = np.isfinite(x).all(1)
    return rows[fine], x[fine]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(64 c) as int64, held within +-``LARGEST``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64)


def products(z: np.ndarray) -> np.ndarray:
    """z' z of int64 rows, exact (Python integers where they are needed)."""
    top = int(np.abs(z).max(initial=0))
    if top * top * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    out = np.zeros((z.shape[1],) * 2, object)
    for at in range(0, len(z), CHUNK):              # digits of 20 bits: sums stay below 2**53
        part = z[at:at + CHUNK]
        digits = [((part >> (20 * k)) & 0xFFFFF if k < 3 else part >> 60).astype(np.float64) for k in range(4)]
        for a, b in itertools.product(range(4), repeat=2):
            out += (digits[a].T @ digits[b]).astype(np.int64).astype(object) << (20 * (a + b))
    return out


def limbs(values: list[int]) -> pa.RecordBatch:
    """(k, a, b, c): value k = a * 2**80 + b * 2**40 + c."""
    low = (1 << _LIMB) - 1
    return pa.RecordBatch.from_arrays([
        pa.array(range(len(values)), pa.int32()), pa.array([v >> (2 * _LIMB) for v in values], pa.int64()),
        pa.array([(v >> _LIMB) & low for v in values], pa.int64()), pa.array([v & low for v in values], pa.int64())],
        ["k", "a", "b", "c"])


def summed(parts: DataFrame, n: int) -> list[int]:
    """The ``n`` exact totals of ``limbs`` rows."""
    out = [0] * n
    for r in parts.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).toLocalIterator():
        out[r["k"]] = (r["a"] << (2 * _LIMB)) + (r["b"] << _LIMB) + r["c"]
    return out


def scatter(rows: DataFrame, column: str, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, M) of the usable rows, all exact."""
    upper = np.triu_indices(dim)

    def run(batches):
        serve("whitening")
        n, sums, prods = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            z = integers(vectors(batch, column, dim)[1])
            n += len(z)
            sums += z.astype(object).sum(0) if np.abs(z).max(initial=0) > 1 << 40 else z.sum(0).astype(object)
            prods += products(z)
        yield limbs([n, *sums.tolist(), *prods[upper].tolist()])

    got = summed(rows.mapInArrow(run, "k int, a bigint, b bigint, c bigint"), 1 + dim + len(upper[0]))
    n, s = got[0], got[1:dim + 1]
    m = np.zeros((dim, dim), object)
    m[upper] = got[dim + 1:]
    m = m + m.T - np.diag(np.diag(m))
    return n, s, n * m - np.outer(np.array(s, object), np.array(s, object))


# ------------------------------------------------------------------ polynomial
def is_prime(n: int) -> bool:
    """Miller-Rabin, certain below 3,215,031,751."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: float) -> list[int]:
    """Largest primes below 2**31 whose product has more than ``bits`` bits."""
    out, have, at = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if is_prime(at):
            out.append(at)
            have += math.log2(at)
        at -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x - m) modulo ``p`` < 2**31."""
    h = (m % p).astype(np.int64)
    n = len(h)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    falls = np.empty(0, np.int64)                   # products of the subdiagonal, nearest first
    for k in range(1, n + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] -= h[k - 1, k - 1] * polys[k - 1] % p
        if k > 1:
            falls = np.r_[np.int64(1), falls] * h[k - 1, k - 2] % p
            w = h[k - 2::-1, k - 1] * falls % p
            polys[k] -= (w[:, None] * polys[k - 2::-1] % p).sum(0) % p
        polys[k] %= p
    return polys[n]


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> list[int]:
    """Integers of least size with the given residues (Chinese remainders)."""
    whole = math.prod(moduli)
    weights = [whole // p * pow(whole // p % p, -1, p) for p in moduli]
    out = []
    for k in range(len(residues[0])):
        x = sum(int(r[k]) * w for r, w in zip(residues, weights)) % whole
        out.append(x - whole if 2 * x > whole else x)
    return out


def characteristic_polynomial(spark, m: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - m), constant first; m is positive
    semidefinite, so no coefficient exceeds (1 + trace / d) ** d."""
    dim, trace = len(m), int(np.trace(m))
    side = (trace // dim + 2)
    moduli = primes(dim * (side.bit_length()) + 2)
    sent = spark.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([polynomial_mod(sent.value, moduli[k]).tolist()],
                                                                                      pa.list_(pa.int64()))], ["k", "residues"])

    tasks = min(len(moduli), max(1, spark.sparkContext.defaultParallelism))
    got = {r["k"]: r["residues"] for r in spark.range(0, len(moduli), 1, tasks).mapInArrow(run, "k bigint, residues array<bigint>").collect()}
    return remaindered([got[k] for k in range(len(moduli))], moduli)


# ------------------------------------------------------------------ roots
def roots_beyond(p: list[int], m: int, s: int) -> int:
    """How many roots (with multiplicity) of the real-rooted ``p`` lie beyond
    m / 2**s: the sign changes of p shifted there."""
    d = len(p) - 1
    c = [x << (s * (d - k)) for k, x in enumerate(p)][::-1]         # leading first
    signs = []
    for k in range(d + 1):
        c = list(itertools.accumulate(c, lambda acc, x: acc * m + x))
        last = c.pop()
        if last:
            signs.append(last > 0)
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(p: list[int], m: int, s: int) -> int:
    value, d = 0, len(p) - 1
    for k, x in enumerate(reversed(p)):
        value = value * m + (x << (s * k))
    return (value > 0) - (value < 0)


def root(p: list[int], k: int) -> tuple[int, int, int, int] | None:
    """(m, s, first, many): the k-th largest root (from 1) lies just above
    m / 2**s; it and ``many`` - 1 others, from the ``first`` largest on, are
    one.  None where it is 0."""
    d = len(p) - 1
    if k > d - next(i for i, x in enumerate(p) if x):
        return None
    s, low, high = 0, 0, 1 << (abs(p[-2]).bit_length() + 1)         # no root beyond the trace
    above, beyond = 0, d                                            # roots beyond high, beyond low
    while beyond - above > 1 and high - low > high >> CLUSTER_BITS:
        if (low + high) & 1:
            s, low, high = s + 1, low * 2, high * 2
        mid = (low + high) >> 1
        n = roots_beyond(p, mid, s)
        if n >= k:
            low, beyond = mid, n
        else:
            high, above = mid, n
    if beyond - above > 1:
        return low, s, above + 1, beyond - above
    right = sign_at(p, high, s) or sign_at(p, 2 * high + 1, s + 1)  # sign beyond the root
    if sign_at(p, high, s) == 0:
        return high, s, above + 1, 1
    while low == 0 or high - low > low >> ROOT_BITS:
        if high - low == 1:
            s, low, high = s + 1, low * 2, high * 2
        mid = (low + high) >> 1
        at = sign_at(p, mid, s)
        if at == 0:
            return mid, s, above + 1, 1
        low, high = (low, mid) if at == right else (mid, high)
    return low, s, above + 1, 1


def null_space(m: np.ndarray, value: int, s: int, many: int) -> np.ndarray:
    """Orthonormal rows spanning the space of ``m`` at the eigenvalue
    value / 2**s of multiplicity ``many``, as doubles."""
    d = len(m)
    bits = 300 + s + 2 * d.bit_length()
    one = 1 << bits
    a = np.array([[int(x) << bits for x in row] for row in m], object)
    for i in range(d):
        a[i, i] -= (value << bits) >> s
    rows, cols = list(range(d)), list(range(d))
    for k in range(d - many):
        size = np.abs(a[k:, k:])
        i, j = divmod(int(size.argmax()), d - k)
        a[[k, k + i]] = a[[k + i, k]]
        a[:, [k, k + j]] = a[:, [k + j, k]]
        rows[k], rows[k + i] = rows[k + i], rows[k]
        cols[k], cols[k + j] = cols[k + j], cols[k]
        if not a[k, k]:
            a[k, k] = 1
        f = (a[k + 1:, k] << bits) // a[k, k]
        a[k + 1:, k + 1:] -= (f[:, None] * a[k, k + 1:]) >> bits
        a[k + 1:, k] = f                                            # the lower factor
    r = d - many

    def upper(x: np.ndarray) -> np.ndarray:
        for i in range(r - 1, -1, -1):
            x[i] = ((x[i] - ((a[i, i + 1:] * x[i + 1:]).sum() >> bits)) << bits) // a[i, i]
        return x

    basis = []
    for free in range(many):
        x = np.zeros(d, object)
        x[r + free] = one
        x = upper(x)
        if many == 1:                                               # one step of inverse iteration
            y = _units(_unpermuted(x, cols)[rows], bits)
            for i in range(1, d):
                y[i] -= int((a[i, :min(i, r)] * y[:min(i, r)]).sum()) >> bits
            y[d - 1] = (y[d - 1] << bits) // (int(a[d - 1, d - 1]) or 1)
            x = _units(upper(y), bits)
        for q in basis:
            x = x - ((q * int((x * q).sum() >> bits)) >> bits)
        basis.append(_units(x, bits))
    return np.array([[float(v >> (bits - 100)) / 2.0 ** 100 for v in _unpermuted(x, cols)] for x in basis])


def _unpermuted(x: np.ndarray, cols: list[int]) -> np.ndarray:
    out = np.empty(len(x), object)
    out[cols] = x
    return out


def _units(x: np.ndarray, bits: int) -> np.ndarray:
    """The vector at length 1 (``bits`` fractional bits)."""
    return (x << bits) // (math.isqrt(int((x * x).sum())) or 1)


def components(spark, m: np.ndarray, p: list[int], most: int) -> list[tuple[float, np.ndarray]]:
    """[(eigenvalue of m, unit vector)], the largest first, without zeros."""
    rank = len(m) - next(i for i, x in enumerate(p) if x)
    most = min(most, rank)
    if not most:
        return []
    sent = spark.sparkContext.broadcast((m, p))

    def run(batches):
        matrix, poly = sent.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                value, s, first, many = root(poly, k)
                u = null_space(matrix, value, s, many)[k - first]
                exact = value * (1 << 80) >> s
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([math.ldexp(float(exact), -80)]),
                                                  pa.array([u.tolist()], pa.list_(pa.float64()))], ["k", "e", "u"])

    tasks = min(most, max(1, spark.sparkContext.defaultParallelism))
    got = spark.range(1, most + 1, 1, tasks).mapInArrow(run, "k bigint, e double, u array<double>").collect()
    return [(r["e"], np.array(r["u"])) for r in sorted(got, key=lambda r: r["k"])]


# ------------------------------------------------------------------ rows
def centred(z: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * z - S: int64 where that holds it, else Python integers."""
    top = n * int(np.abs(z).max(initial=0)) + max(map(abs, s))
    if top < 1 << 62:
        return z * n - np.array(s, np.int64)
    return z.astype(object) * n - np.array(s, object)


def deviations(x: np.ndarray) -> list[int | None]:
    """Sums of squares; None beyond a long."""
    if x.dtype != object and x.shape[1] * int(np.abs(x).max(initial=0)) ** 2 < 1 << 63:
        return (x * x).sum(1).tolist()
    sums = [int(v) for v in (x.astype(object) ** 2).sum(1)]
    return [v if v < 1 << 63 else None for v in sums]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)
    of every usable row and each of its first ``most`` components."""
    spark = rows.sparkSession
    ship_package(spark)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    common = base.where((F.size("v") > 0) & usable).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")) \
        .orderBy(F.desc("c"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]
    n, s, m = scatter(base.select("v"), "v", dim)
    found = components(spark, m, characteristic_polynomial(spark, m), most)
    if not found:
        return spark.createDataFrame([], schema)
    # eigenvalues of the covariance are those of the scatter over n squared
    axes = np.stack([u for _, u in found], 1) / np.sqrt([e for e, _ in found])
    trace = int(np.trace(m))
    shares = [e / trace for e, _ in found]
    sent = spark.sparkContext.broadcast((axes, s))
    many = len(found)
    upper = np.triu_indices(many)

    def projected(z):
        # (z - S/n) / n ** -1 and the eigenvalue's n ** 2 cancel: n z - S over the root of M's eigenvalue
        x = centred(z, n, sent.value[1])
        return x, x.astype(np.float64) @ sent.value[0]

    def moments(batches):
        total, sums, prods = 0, np.zeros(many), np.zeros((many, many))
        for batch in batches:
            _, w = projected(integers(vectors(batch, "v", dim)[1]))
            if not len(w):
                continue
            mean = w.mean(0)
            total += len(w)
            sums += mean * len(w)
            prods += (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
        yield limbs([total, *(int(v * 2.0 ** 60) for v in np.r_[sums, prods[upper]])])

    got = summed(base.select("v").mapInArrow(moments, "k int, a bigint, b bigint, c bigint"), 1 + many + len(upper[0]))
    mean = np.array([v / (n << 60) for v in got[1:many + 1]])
    cov = np.zeros((many, many))
    cov[upper] = [v / (n << 60) for v in got[many + 1:]]
    cov = cov + cov.T - np.diag(np.diag(cov)) - np.outer(mean, mean)
    error = float(np.abs(cov - np.eye(many)).max())

    def run(batches):
        for batch in batches:
            at, v = vectors(batch, "v", dim)
            x, w = projected(integers(v))
            ids = batch.column("id").take(pa.array(np.repeat(at, many)))
            size = len(at) * many
            deviation = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), many)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, many + 1), len(at)), pa.int32()), pa.array(np.full(size, n), pa.int64()),
                deviation, pa.array(w.ravel(), pa.float64()), pa.array(np.tile(shares, len(at)), pa.float64()),
                pa.array(np.full(size, error), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.mapInArrow(run, schema)
