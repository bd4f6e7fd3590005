"""Operator 11 against exact fractions and a plain decomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from claimloom.llm import queries, whitening


def plain(rows):
    """n, S and the covariance as fractions of the distinct rows."""
    fit = sorted(set(map(tuple, rows)))
    n, width = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(width)]
    cov = [[sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in fit) / n for j in range(width)] for i in range(width)]
    return n, sums, cov, fit


def check(got, vectors):
    """Every column of the operator's rows against the plain version; ``vectors`` holds (id, entries)."""
    rows = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors]
    n, sums, cov, fit = plain([x for _, x in rows])
    values, axes = np.linalg.eigh(np.array(cov, float))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(4, len(sums))
    white = {c: (np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)] for _, x in rows]) @ axes[:, c]) / math.sqrt(values[c]) for c in range(k)}
    of_fit = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)] for x in fit]) @ axes[:, :k] / np.sqrt(values[:k])
    error = np.abs(np.cov(of_fit.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for at, (i, x) in enumerate(rows):
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        for c in range(k):
            assert any(r.deviation == deviation and abs(abs(r.whitened) - abs(white[c][at])) < 1e-7 * (1 + abs(r.whitened)) for r in by[i, c + 1])
            assert all(r.n == n and abs(r.explained - values[c] / values.sum()) < 1e-9 and r.identity_error <= max(1e-9, 2 * error) for r in by[i, c + 1])
    for c in range(k):  # the same sign for all rows
        signs = {np.sign(r.whitened * white[c][at]) for at, (i, _) in enumerate(rows) for r in by[i, c + 1] if len(by[i, c + 1]) == 1 and abs(white[c][at]) > 1e-6}
        assert len(signs) <= 1


def run(spark, vectors, shape="vec_id long, embedding array<double>"):
    return whitening.whiten(spark.createDataFrame(vectors, shape).repartition(3)).collect()


def test_rows_copies_and_ids(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(3 * j, 1 + j) for j in range(6)]) for i in range(80)]
    copies = vectors + [(100 + i, vectors[7][1]) for i in range(60)] + [(5, vectors[9][1])]
    check(run(spark, copies), copies)
    assert {r.n for r in run(spark, copies)} == {80}


def test_far_from_zero_and_very_large_entries(spark):
    rng = random.Random(2)
    far = [(i, [1e6 + rng.random(), -1e6 + 2 * rng.random(), rng.random()]) for i in range(50)]
    check(run(spark, far), far)
    large = [(i, [rng.uniform(-1, 1) * 1e12, rng.uniform(-1, 1) * 1e3]) for i in range(40)]
    got = run(spark, large)
    n, sums, cov, _ = plain([[math.floor(256 * c) for c in v] for _, v in large])
    assert abs(got[0].explained - 1) < 1e-4 and got[0].identity_error < 1e-4 and {r.deviation for r in got} == {None} and n == 40


@pytest.mark.parametrize("top", [10, 1 << 25, 1 << 45, (1 << 63) - 1])
def test_sums_are_exact_at_any_size(top, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = random.Random(top)
    rows = [[rng.randint(-top, top) for _ in range(3)] for _ in range(40)]
    shift = [rng.randint(-top // 3, top // 3) for _ in range(3)]
    sums, products = whitening.exact_sums(np.array(rows, np.int64), np.array(shift, np.int64))
    less = [[v - s for v, s in zip(r, shift, strict=True)] for r in rows]
    assert sums.tolist() == [sum(r[i] for r in less) for i in range(3)]
    assert products.tolist() == [[sum(r[i] * r[j] for r in less) for j in range(3)] for i in range(3)]
    for v in [*sums, *products.ravel()]:
        assert sum(p << whitening.PART * k for k, p in enumerate(whitening._parts(int(v)))) == v


def test_scatter_over_partitions(spark):
    rng = random.Random(3)
    rows = [[rng.randint(-(1 << 40), 1 << 40) for _ in range(4)] for _ in range(200)]
    frame = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(5)
    n, sums, products = whitening.scatter(frame, 4, np.array([5, -7, 1 << 30, 0]))
    less = [[v - s for v, s in zip(r, (5, -7, 1 << 30, 0), strict=True)] for r in rows]
    assert n == 200 and sums == [sum(c) for c in zip(*less, strict=True)] and products[1][2] == sum(r[1] * r[2] for r in less)


def test_unusable_short_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    good = [(i, [rng.random(), rng.random()]) for i in range(9)] + [(None, [0.25, -0.0])]
    bad = [(20, None), (21, [nan, 1.0]), (22, [1.0, inf]), (23, [None, 1.0]), (24, [-inf, 0.0])]
    got = run(spark, good + bad)
    check(got, good)
    short = run(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [4.0, 0.5]), (4, [])])
    check(short, [(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, [4.0, 0.5]), (4, [0.0, 0.0])])
    assert run(spark, bad) == [] and run(spark, []) == [] and run(spark, [(1, [])]) == []
    same = run(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = run(spark, [(1, [2.0, 3.0]), (2, [3.0, 3.0]), (3, [4.0, 3.0])])
    assert {r.whitened for r in line if r.component == 2} == {None} and {r.explained for r in line if r.component == 1} == {1.0}


def test_extra_columns_and_floats(spark):
    rng = random.Random(5)
    vectors = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(5)]) for i in range(40)]
    frame = spark.createDataFrame([(i, v, [1], "a", 3) for i, v in vectors], "vec_id int, embedding array<float>, x array<int>, component string, w0 int")
    check(whitening.whiten(frame).collect(), vectors)


def test_query_at_sf(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = queries.op11_embedding_whitening(spark, folder).collect()
    check(got, [(r.vec_id, r.embedding) for r in rows if r.embedding is not None])
