"""Whitening against numpy's symmetric eigensolver and exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import whitening as wh


def covariance(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    return x, n, s, n * x - s


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, n string, component int")


def check(got, kept, most=32):
    x, n, s, dev = covariance([v for _, v in kept])
    m = (dev.T @ dev).astype(float)                       # n * n * n V
    values, axes = np.linalg.eigh(m / m.max())
    values, axes = values[::-1] * m.max() / n ** 3, axes[:, ::-1]
    rank = int((values > values[0] * 1e-12).sum())
    many = min(most, rank)
    assert len(got) == many * len(kept)
    assert {r["n"] for r in got} == {n}
    assert {r["component"] for r in got} == set(range(1, many + 1))
    trace = values.sum()
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    want = dev.astype(float) / n @ axes[:, :many] / np.sqrt(values[:many])
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert abs(r["explained"] - values[r["component"] - 1] / trace) <= 1e-9
    alone = [k for k in range(many) if min(abs(values[k] - values[j]) for j in range(len(values)) if j != k) > 1e-6 * values[0]] if len(values) > 1 else [0]
    for k in alone:
        mine = sorted((str(i), round(abs(w), 6)) for (i, c), rs in by.items() if c == k + 1 for w in [r["whitened"] for r in rs])
        assert mine == sorted((str(i), round(abs(w), 6)) for (i, _), w in zip(kept, want[:, k]))
    deviation = {(str(i), int(sum(v * v for v in d))) for (i, _), d in zip(kept, dev)}
    assert {(str(r["vec_id"]), r["deviation"]) for r in got} == deviation


def test_random_vectors_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=40) * rng.uniform(.01, .3, 40)]) for i in range(300)]
    check(wh.whitened(frame(spark, rows)).collect(), rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    good = [(i, [float(np.float32(rng.gauss(0, .2))) for _ in range(5)]) for i in range(30)]
    good += [(None, good[0][1]), (3, good[3][1]), (3, good[4][1]), (77, [0.0] * 5)]
    bad = [(100, None), (101, [0.1, None, 0.1, 0.1, 0.1]), (102, [float("nan")] * 5), (103, [float("inf"), 0., 0., 0., 0.]),
           (104, []), (105, [0.5] * 4)]
    check(wh.whitened(frame(spark, good + bad)).collect(), good)


def test_repeated_roots_and_lost_rank(spark):
    rows = [(k, [float(a), float(b), float(c), float(a)]) for k, (a, b, c) in enumerate((a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1))]
    got = wh.whitened(frame(spark, rows)).collect()
    check(got, rows)
    assert sorted({(r["component"], r["explained"]) for r in got}) == [(1, 0.5), (2, 0.25), (3, 0.25)]


def test_no_rows_without_variance(spark):
    one = frame(spark, [(1, [0.1, 0.2]), (2, [0.1, 0.2])])
    assert wh.whitened(one).collect() == wh.whitened(one.limit(0)).collect() == []
    assert wh.whitened(frame(spark, [(1, None), (2, [])])).collect() == []


def test_huge_entries_stay_exact(spark):
    rows = [(k, [c * 1e9, c]) for k, c in enumerate([1.0, -2.0, 0.5, 3.0])]
    got = wh.whitened(frame(spark, rows)).collect()
    x, n, s, dev = covariance(rows_v := [v for _, v in rows])
    exact = [int(sum(v * v for v in d)) for d in dev]
    assert {r["vec_id"]: r["deviation"] for r in got} == {k: v if v < 1 << 63 else None for k, v in enumerate(exact)}
    assert got[0]["identity_error"] < 1e-6 and len(rows_v) == n


@pytest.mark.parametrize("dim", [1, 2, 5, 9])
def test_polynomial_is_exact(dim):
    rng = np.random.default_rng(dim)
    a = rng.integers(-50, 50, (dim + 2, dim)).astype(object)
    m = a.T @ a
    moduli = wh.primes(dim * (int(np.trace(m)) // dim + 2).bit_length() + 2)
    got = wh.remaindered([wh.polynomial_mod(m, p) for p in moduli], moduli)
    work, want = np.identity(dim, dtype=object), [Fraction(1)]           # Faddeev and LeVerrier
    for k in range(1, dim + 1):
        c = -Fraction(int(np.trace(m @ work)), k)
        want.append(c)
        work = m @ work + int(c) * np.identity(dim, dtype=object)
    assert got == [int(c) for c in want[::-1]]


def test_products_of_large_integers():
    z = np.array([[1 << 61, -(1 << 62), 3], [-(1 << 50) + 1, 7, 1 << 40]], np.int64)
    assert (wh.products(z) == z.astype(object).T @ z.astype(object)).all()
