"""Exact medians by counting, against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.operators.medians import exact_median


def test_medians_by_counting(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = np.random.default_rng(0)
    groups = {
        "normal": r.normal(size=3001), "even": r.normal(size=3000), "ties": np.repeat([1.0, 2.0, 3.0], 1000), "equal": np.full(2000, 7.0), "two": np.repeat([1.0, 5.0], 1000),
        "wide": np.concatenate([r.normal(size=2000), [1e300, -1e300]]), "tiny": 1 + r.integers(0, 50, 2000) * 2.0**-52, "one": np.array([4.0]), "few": np.array([1.0, 2.0]),
    }
    rows = [(None if g == "few" else g, float(x)) for g, values in groups.items() for x in values] + [("one", math.nan), ("one", math.inf), ("none", None)]
    d = spark.createDataFrame(rows, "g string, x double").repartition(5).persist()
    for direct, bins in ((100_000, 64), (50, 16), (5, 1024)):
        got = {r.g: (r.n, r["median"]) for r in exact_median(d, "x", ("g",), direct=direct, bins=bins).collect()}
        want = {None if g == "few" else g: (len(v), float(np.median(v))) for g, v in groups.items()}
        assert got.keys() == want.keys()
        for g, (n, m) in want.items():
            assert got[g][0] == n and got[g][1] == pytest.approx(m, rel=1e-15, abs=1e-300), (g, direct)
    assert exact_median(d.where("g = 'even'"), "x", direct=100).first()["median"] == pytest.approx(float(np.median(groups["even"])), rel=1e-15)
    assert tuple(exact_median(d.where(F.lit(False)), "x").first()) == (0, None)


def one_by_one(g, rounds=20, delta=0.1, tolerance=1e-9):
    """The robust fit of one batch, all in one place."""
    from mapweave.operators.alignment import solve

    s, t, w0 = (np.array([[r[c] for c in cols] for r in g]) for cols in (("sx", "sy", "sz"), ("tx", "ty", "tz"), ("w",)))
    w0 = np.maximum(w0[:, 0], 0)
    best, last = solve(s, t, w0 + 1e-300), np.inf
    for _ in range(rounds):
        r = np.linalg.norm(best[0] * s @ best[1].T + best[2] - t, axis=1)
        cost = float(w0 @ np.where(r <= delta, r * r / 2, delta * (r - delta / 2)))
        new = solve(s, t, w0 * np.where(r <= delta, 1.0, delta / np.maximum(r, 1e-12)) + 1e-300)
        if abs(last - cost) < tolerance * max(1.0, cost):
            break
        best, last = new, cost
    r = np.linalg.norm(best[0] * s @ best[1].T + best[2] - t, axis=1)
    return best, len(g), w0.mean(), r.mean(), np.median(r), r.max()


def test_robust_fit_is_that_of_each_batch_alone(spark, tmp_path):
    from mapweave.operators import alignment
    from mapweave.sources import fixtures

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = fixtures.correspondences(spark, "/root/testdata/sf0.01").where("batch % 40 = 0").persist()
    groups = {}
    for r in d.collect():
        groups.setdefault(r.batch, []).append(r)
    got = {r.batch: r for r in alignment.robust_fit(d).collect()}
    assert got.keys() == groups.keys() and len(got) > 3
    for b, g in groups.items():
        (scale, rot, shift), *stats = one_by_one(g)
        f = got[b]
        assert abs(f.scale - scale) < 1e-9 and np.allclose(np.reshape(f.rotation, (3, 3)), rot, atol=1e-9) and np.allclose(f.translation, shift, atol=1e-7)
        assert np.allclose([f.n, f.mean_weight, f.mean_residual, f.median_residual, f.max_residual], stats, atol=1e-7)


def test_robust_fit_shuffles_rows_once(spark, tmp_path, monkeypatch):
    from mapweave.operators import alignment

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = np.random.default_rng(0)
    rows = [(b, *map(float, p), *map(float, 2 * p + 1 + 0.3 * r.normal(size=3) * (i % 4 == 0)), 1.0) for b in range(5) for i, p in enumerate(r.normal(size=(20 + b, 3)))]
    d = spark.createDataFrame(rows, "batch long, sx double, sy double, sz double, tx double, ty double, tz double, w double")
    large = sorted(alignment.robust_fit(d, together=1).collect())
    monkeypatch.setattr(alignment, "_solve_rows", None)  # no rounds over the cluster for small batches
    got = sorted(alignment.robust_fit(d).collect())
    assert len(got) == len(large) == 5
    for x, y in zip(got, large, strict=True):
        assert x.batch == y.batch and x.n == y.n and np.allclose(np.hstack([x[1], *x[2:4], *x[5:]]), np.hstack([y[1], *y[2:4], *y[5:]]), atol=1e-8)
