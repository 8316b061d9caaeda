"""Whitening against numpy on the whole matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import whitening


def check(rows, got, most=32):
    """rows: (id, whole vector) in the fit list; got: result rows."""
    x = np.floor(np.array([v for _, v in rows], float) * 64).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    far = {}
    for (i, _), row in zip(rows, x.tolist(), strict=True):
        far.setdefault(i, set()).add(sum((n * a - b) ** 2 for a, b in zip(row, s.tolist(), strict=True)))
    for j, part in by.items():
        z = np.sort([r.whitened for r in part])
        w = np.sort(c @ u[:, j - 1] / np.sqrt(e[j - 1]))
        assert min(np.abs(z - w).max(), np.abs(z + w[::-1]).max()) < 1e-8
        for r in part:
            assert r.n == n and int(r.deviation) in far[r.vec_id]
            assert math.isclose(r.explained, e[j - 1] / np.trace(v), rel_tol=1e-8)
            assert r.identity_error < 1e-9


@pytest.mark.parametrize("parts", [1, 40])
def test_whole_matrix(spark, parts):
    draw = np.random.default_rng(5)
    a = draw.normal(size=(900, 40)) @ draw.normal(size=(40, 40)) + draw.normal(size=40) * 5
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    check(rows, whitening.transform(df).collect())


def test_odd(spark):
    draw = np.random.default_rng(6)
    good = [(i if i % 7 else None, v.tolist()) for i, v in enumerate(draw.normal(size=(60, 5)))]
    good += [good[3], good[3]]
    bad = [(900, None), (901, []), (902, [1.0, 2.0, None, 1.0, 1.0]), (903, [1.0, float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf")] * 5), (905, [1.0, 2.0]), (None, None)]
    df = spark.createDataFrame([(i, v, i) for i, v in good + bad], "vec_id long, embedding array<double>, component long").withColumns({"__key": F.lit(1), "__v": F.lit("x"), "n": F.lit(2)})
    out = whitening.transform(df)
    check(good, out.collect())
    assert whitening.transform(df.limit(0)).collect() == []
    assert whitening.transform(df.where("vec_id >= 900")).select("vec_id").distinct().count() <= 1
    assert whitening.transform(df.where("vec_id = 1")).collect() == []  # one row: no component has a deviation
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 7.0]) for i in range(50)]  # rank 1, and one constant dimension
    got = whitening.transform(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and all(math.isclose(r.explained, 1.0) for r in got)


def test_any_size():
    centre = whitening.Centre(10**12, [10**24, -(10**20)])
    x = np.array([[10**12 + 5, 7]])
    assert centre.deviation(x) == [(10**12 * (10**12 + 5) - 10**24) ** 2 + (7 * 10**12 + 10**20) ** 2]
