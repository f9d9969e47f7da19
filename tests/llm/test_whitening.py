import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import whitening

SF = "/root/testdata/sf0.01"
TYPE = "vec_id long, embedding array<float>, label int"


def polynomial(matrix):
    """Characteristic polynomial of an integer matrix by traces of powers (Faddeev and LeVerrier), exactly, lowest first."""
    d, m, out = len(matrix), np.array(matrix, object), [1]
    b = np.zeros((d, d), object)
    for k in range(1, d + 1):
        b = m @ (b + out[-1] * np.eye(d, dtype=int).astype(object))
        out.append(-int(sum(b[i, i] for i in range(d))) // k)
    return out[::-1]


def checked(rows, vectors, most=4):
    """Holds rows against exact sums and numpy's eigenvalues; vectors are those of all rows that remain."""
    kept = {i: [math.floor(Fraction(float(np.float32(c))) * 256) for c in v] for i, v in vectors.items()}
    fit = sorted({tuple(v) for v in kept.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float)
    cov = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == rank * len(kept)
    whitened = defaultdict(dict)
    for r in rows:
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(kept[r.vec_id], sums, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
        whitened[r.vec_id][r.component] = r.whitened
    w = np.array([[whitened[i][c] for c in range(1, rank + 1)] for i in kept])
    per = np.array([w[list(kept.values()).index(list(v))] for v in fit])
    assert np.abs(per.T @ per / n - np.eye(rank)).max() < 1e-9 and np.abs(per.mean(axis=0)).max() < 1e-9
    back = np.linalg.lstsq((x - x.mean(axis=0)), per * np.sqrt(values[:rank]), rcond=None)[0]
    for c in range(rank):  # where the variance is single, the component is numpy's up to its sign
        if min((abs(values[c] - v) for i, v in enumerate(values) if i != c), default=values[0]) > 1e-6 * values[0]:
            assert np.abs((x - x.mean(axis=0)) @ (back[:, c] - np.sign(back[:, c] @ axes[:, c]) * axes[:, c])).max() < 1e-6 * np.sqrt(values[0])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7).flatmap(lambda d: st.lists(st.lists(st.integers(-9, 9), min_size=d, max_size=d), min_size=d, max_size=d)))
def test_polynomial_and_roots(rows):
    m = np.array(rows, object)
    m = m @ m.T
    want = polynomial(m)
    p = (1 << 31) - 1
    assert whitening.polynomial_modulo(m, p) == [c % p for c in want]
    assert whitening.polynomial_modulo(m, 7) == [c % 7 for c in want]
    values = np.linalg.eigvalsh(m.astype(float))[::-1]
    roots = [r for low, _, count in whitening.largest_roots(want, len(m)) for r in [low / 2**whitening.ROOT_BITS] * count]
    rank = int((values > 1e-7).sum())
    assert len(roots) == rank and np.allclose(roots, values[:rank], rtol=1e-9, atol=1e-7)


def test_multiple_roots_are_counted():
    poly = np.array([1], object)
    for r in (5, 5, 5, 3, 3, 0):
        poly = np.convolve(poly, np.array([-r, 1], object))
    found = whitening.largest_roots(poly.tolist(), 4)
    assert [(round(low / 2**whitening.ROOT_BITS), first, count) for low, first, count in found] == [(5, 0, 3), (3, 3, 2)]


def test_sums_of_any_size():
    rng = np.random.default_rng(3)
    for most in (100, 1 << 19, 1 << 21, 1 << 40, (1 << 63) - 1):
        x = rng.integers(-most, most, (50, 3), dtype=np.int64)
        x[0], x[1] = most, -most
        rows = [[1, *map(int, r)] for r in x]
        want = [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]
        assert whitening.products(x).tolist() == want


def test_polynomial_is_put_together(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-(10**6), 10**6, (9, 9)).astype(object)
    m = a @ a.T
    assert whitening.characteristic_polynomial(spark, m) == polynomial(m)


def test_query_equals_brute_force(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    checked(whitening.op11_embedding_whitening(spark, SF).collect(), vectors)


def test_equal_variances_and_few_dimensions(spark):
    axes = [[4.0 * s * (i == j) for j in range(5)] for i in range(5) for s in (1, -1)]
    flat = [[float(i % 7), float(i % 7) * 2, 1.0] for i in range(40)]
    for some in (axes, flat, [[1.0], [2.0], [5.0]], [[0.5, -0.25], [0.25, 0.5]]):
        rows = [(i, v, 0) for i, v in enumerate(some)]
        checked(whitening.whiten(spark.createDataFrame(rows, TYPE)).collect(), {i: v for i, v, _ in rows})


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i), float(i * i % 5), 1.5 * (i % 3)], 0) for i in range(8)]
    hot = [(100 + i, good[3][1], 0) for i in range(50)] + [(3, good[3][1], 0)]
    bad = [(200, None, 0), (201, [1.0, None, 2.0], 0), (202, [nan, 1.0, 1.0], 0), (203, [inf, 1.0, 1.0], 0), (204, [], 0), (205, [1.0, 2.0], 0)]
    docs = spark.createDataFrame(good + hot + bad, TYPE).withColumn("x", F.lit("clash")).withColumn("key", F.lit(1))
    rows = whitening.whiten(docs).collect()
    assert sum(r.vec_id == 3 for r in rows) == 2 * 3 and len({(r.component, r.whitened) for r in rows if r.vec_id == 3 or r.vec_id >= 100}) == 3
    checked(list({(r.vec_id, r.component): r for r in rows}.values()), {i: v for i, v, _ in good + hot})
    assert whitening.whiten(docs.limit(0)).count() == 0 and whitening.whiten(docs.where("vec_id >= 100")).count() == 0
    assert whitening.whiten(docs.limit(0)).columns == whitening.whiten(docs).columns
    huge = spark.createDataFrame([(1, [1e38, 0.0], 0), (2, [-1e38, 0.0], 0), (3, [0.0, 1.0], 0)], TYPE)
    found = {(r.vec_id, r.component): r for r in whitening.whiten(huge).collect()}
    assert found[1, 1].deviation is None and abs(found[1, 1].whitened) == pytest.approx(math.sqrt(1.5)) and found[1, 1].identity_error < 1e-9
