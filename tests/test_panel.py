"""Two-way fixed effects against dense dummies on panels that are hard for iteration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M

SCHEMA = "ticker string, date int, y double, a double, b double"


def dense(rows):
    """(slopes, clustered errors) by least squares on dummies."""
    firms, days = sorted({r[0] for r in rows}, key=repr), sorted({r[1] for r in rows}, key=repr)
    dummies = np.array([[*(r[0] == f for f in firms), *(r[1] == d for d in days)] for r in rows], float)
    v = np.array([r[2:] for r in rows], float)
    v = v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    x, y = v[:, 1:], v[:, 0]
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    scores = [sum(x[i] * (y[i] - x[i] @ beta) for i in range(len(rows)) if rows[i][0] == f) for f in firms]
    return beta, np.sqrt(np.diag(inverse @ sum(np.outer(s, s) for s in scores) @ inverse))


def panel(rng, cells):
    rows = []
    for firm, day in cells:
        a, b = (float(v) for v in rng.normal(size=2))
        rows.append((firm, day, 2 * a - 3 * b + hash(day) % 7 + len(firm) + float(rng.normal()), a + day * 0.1, b))
    return rows


CELLS = {
    "balanced": [(f"f{i}", t) for i in range(8) for t in range(10)],
    "disconnected": [(f"f{i}", t) for i in range(6) for t in range(8)] + [(f"g{i}", 100 + t) for i in range(5) for t in range(7)],
    # every firm holds three neighbouring dates only: iterated demeaning needs thousands of rounds here
    "chain": [(f"f{i}", t) for i in range(120) for t in (i, i + 1, i + 2)],
    "repeated cells": [(f"f{i}", t % 5) for i in range(6) for t in range(13)],
    "one firm with most rows": [("hot", t % 30) for t in range(900)] + [(f"f{i}", t) for i in range(9) for t in range(0, 30, 4)],
}


@pytest.mark.parametrize("name", CELLS)
def test_equals_dense_dummies(spark, name):
    rows = panel(np.random.default_rng(3), CELLS[name])
    got = M.panel_fit(spark.createDataFrame(rows, SCHEMA).repartition(5), "y", ["a", "b"])
    slopes, errors = dense(rows)
    assert np.allclose(got["slopes"], slopes, rtol=1e-9, atol=1e-11) and np.allclose(got["errors"], errors, rtol=1e-7)
    assert got["n_obs"] == len(rows) and got["n_entities"] == len({r[0] for r in rows}) and got["rank"] == 2


def test_large_levels_and_scales(spark):
    rows = [(f, d, y * 1e-5 + 1e3, a * 1e-4 + 1e2, b * 1e4 - 1e7)
            for f, d, y, a, b in panel(np.random.default_rng(9), CELLS["balanced"])]
    got = M.panel_fit(spark.createDataFrame(rows, SCHEMA), "y", ["a", "b"])
    assert np.allclose(got["slopes"], dense(rows)[0], rtol=1e-5)


def test_collinear_regressors_null_levels_and_null_rows(spark):
    rows = panel(np.random.default_rng(1), CELLS["balanced"])
    df = spark.createDataFrame(rows, SCHEMA)
    assert M.panel_fit(df.withColumn("c", F.col("a") * 2 + F.col("b")), "y", ["a", "b", "c"])["rank"] == 2
    assert M.panel_fit(df.withColumn("c", F.col("date").cast("double")), "y", ["a", "c"])["rank"] == 1
    spent = spark.createDataFrame(panel(np.random.default_rng(2), [(f"f{i}", t) for i in range(9) for t in (i, i + 1)]), SCHEMA)
    assert M.panel_fit(spent, "y", ["a", "b"])["rank"] == 0           # the levels explain everything
    lost = [(None if f == "f3" else f, None if d == 4 else d, *v) for f, d, *v in rows]
    with_nulls = spark.createDataFrame([*lost, ("f1", 2, None, 1.0, 1.0), ("f9", 2, 1.0, None, 1.0)], SCHEMA)
    got = M.panel_fit(with_nulls, "y", ["a", "b"])
    assert np.allclose(got["slopes"], dense(rows)[0], rtol=1e-9) and got["n_obs"] == len(rows)


def test_granger_of_a_series_far_from_zero_equals_qr(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = 1e6 + 0.5 * np.concatenate([[0.0], x[:-1]]) + rng.normal(size=400) * 1e-3
    df = spark.createDataFrame([(i, float(a), float(b) - 1e6) for i, (a, b) in enumerate(zip(y, x))], "date int, y double, x double")
    got = {r.lag: r for r in M.granger_causality(df, "y", "x", None, "date", 3).collect()}
    for p in (1, 2, 3):
        t = np.arange(p, 400)
        own = np.column_stack([np.ones(len(t)), *[y[t - i] - 1e6 for i in range(1, p + 1)]])
        both = np.column_stack([own, *[x[t - i] for i in range(1, p + 1)]])

        def ssr(z):
            q, _ = np.linalg.qr(z)
            v = y[t] - 1e6
            return float(np.sum((v - q @ (q.T @ v)) ** 2))
        assert np.isclose(got[p].ssr_restricted, ssr(own), rtol=1e-6) and np.isclose(got[p].ssr_unrestricted, ssr(both), rtol=1e-5)
        assert got[p].rank == 2 * p + 1
    flat = M.granger_causality(df.withColumn("x", F.lit(3.0)), "y", "x", None, "date", 2).collect()
    assert {(r.lag, r.rank) for r in flat} == {(1, 2), (2, 3)}


def test_moments_make_their_rows_once(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 2.0 * i + i * i % 7) for i in range(50)], "a double, b double, y double")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch
    model = M.fit_ols(df.mapInPandas(counted, df.schema), ["a", "b"], "y")
    assert np.allclose(model.coefficients, [0.0, 2.0, 1.0], atol=1e-9) and model.n == 50 and made.value == 50


def test_out_of_sample_keeps_its_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(d, float(x), float(2 * x + e)) for d in range(40) for x, e in rng.normal(size=(5, 2))]
    folds = [(f, d, "train" if d < 20 + 5 * f else "test") for f in range(4) for d in range(25 + 5 * f)] + [(4, d, "train") for d in range(40)]
    kept, whole = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: kept.append(df.count()) or whole(df))
    df = spark.createDataFrame(rows, "date int, x double, y double")
    placed = spark.createDataFrame(folds, "fold int, date int, role string")
    got = {r.fold: r for r in M.out_of_sample(df, ["x"], "y", placed).collect()}
    assert max(kept) == max(len(rows), len(folds)) and len(kept) == 2
    for f in range(4):
        b, a = np.polyfit(*np.array([(x, y) for d, x, y in rows if d < 20 + 5 * f]).T, 1)
        x, y = np.array([(x, y) for d, x, y in rows if 20 + 5 * f <= d < 25 + 5 * f]).T
        assert (got[f].n_train, got[f].n_test) == (100 + 25 * f, 25)
        assert abs(got[f].mse - np.mean((y - a - b * x) ** 2)) < 1e-9 and abs(got[f].mae - np.mean(abs(y - a - b * x))) < 1e-9
        assert abs(got[f].hit_rate - np.mean(np.sign(y) == np.sign(a + b * x))) < 1e-9
    assert tuple(got[4])[1:] == (200, 0, None, None, None)
    with pytest.raises(ValueError):
        M.out_of_sample(df, ["x"], "y", placed.filter("role = 'test'"))
