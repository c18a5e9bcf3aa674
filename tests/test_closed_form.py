"""Vector moments, the closed-form classifier and the mixture threshold against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwarden.operators import discriminant as GB
from netwarden.operators import features as FT
from netwarden.operators import models as MD
from netwarden.operators.metrics import mean_of
from netwarden.plans import q_features, views
from conftest import SF_SMALL


def test_moments_equal_numpy_with_and_without_gaps(spark):
    r = np.random.default_rng(4)
    x = r.normal(1e6, 1.0, (300, 5))  # squares would cancel
    y = r.integers(0, 3, 300)
    rows = [(int(k), v.tolist()) for k, v in zip(y, x)]
    df = spark.createDataFrame(rows + [(9, None)], "y int, features array<double>").repartition(5)
    got = {m["y"]: m for m in FT.moments(df, group_by=["y"])}
    assert set(got) == {0, 1, 2}
    for k, m in got.items():
        v = x[y == k]
        for name, f in (("mn", np.min), ("mx", np.max), ("mean", np.mean), ("var", np.var)):
            np.testing.assert_allclose(m[name], f(v, axis=0), rtol=1e-9)
        assert m["n"] == [len(v)] * 5
    gaps = spark.createDataFrame([([1.0, None, 3.0],), ([2.0, 5.0, float("nan")],), ([4.0, 7.0, 5.0],)], "features array<double>")
    m = FT.moments(gaps)[0]
    assert m["n"] == [3, 2, 2] and m["mn"] == [1.0, 5.0, 3.0] and m["mean"] == [7 / 3, 6.0, 4.0] and m["var"][1] == 1.0
    assert FT.moments(gaps.limit(0)) == [] and FT.fit_stats(gaps.limit(0)).d == 0
    assert FT.anova_f_scores(spark.createDataFrame([], "y int, features array<double>")).count() == 0


def test_statistics_without_a_row_per_position(spark, monkeypatch):
    """Neither the scaler nor the F scores unroll vectors to get their statistics."""
    seen = []
    monkeypatch.setattr(FT, "_moments_with_gaps", lambda *a: seen.append(a))
    v = views.vectors(spark, SF_SMALL)
    st = FT.fit_stats(v)
    FT.anova_f_scores(v)
    assert not seen
    plan = v.select(FT.minmax_transform(F.col("features"), st))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_gaussian_bayes_equals_the_densities(spark):
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(0, 1, (80, 4)), r.normal(0.8, 2, (60, 4))])
    x[:, 3] = 7.0  # a constant feature
    y = np.repeat([0, 1], [80, 60])
    df = spark.createDataFrame([("a", i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x))]
                               + [("b", 500, 1, [1.0] * 4)], "s string, row_id long, y int, features array<double>")
    models = GB.fit_gaussian_bayes(df, ["s"])
    assert set(models) == {("a",)}  # "b" has one class only
    got = {q["row_id"]: q["z"] for q in df.where("s = 'a'").select("row_id", models[("a",)].log_odds(F.col("features")).alias("z")).collect()}
    m, v = [x[y == k].mean(0) for k in (0, 1)], [np.maximum(x[y == k].var(0), GB.MIN_VAR) for k in (0, 1)]
    for i, row in enumerate(x):
        ll = [(-0.5 * np.log(2 * math.pi * v[k]) - (row - m[k]) ** 2 / (2 * v[k])).sum() for k in (0, 1)]
        assert abs(got[i] - (ll[1] - ll[0])) < 1e-4
    cells = GB.predict_all(df.where("s = 'a'"), {"m": models[("a",)], "n": models[("a",)]}).collect()
    assert len(cells) == 280 and all(c["yhat"] == int(got[c["row_id"]] > 0) for c in cells)


def test_mixture_threshold_equals_a_plain_loop(spark):
    r = np.random.default_rng(6)
    x = np.round(np.concatenate([r.normal(0.1, 0.02, 500), r.normal(0.6, 0.1, 200)]), 3)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "err double").repartition(3)
    w, m, v = 0.5, np.array([x.min(), x.max()]), np.array([x.var()] * 2)
    for _ in range(MD.MIXTURE_ROUNDS):
        dens = np.array([1 - w, w])[:, None] * np.exp(-(x - m[:, None]) ** 2 / (2 * v[:, None])) / np.sqrt(v[:, None])
        g = dens / dens.sum(0)
        n = g.sum(1)
        w, m = n[1] / n.sum(), (g * x).sum(1) / n
        v = (g * (x - m[:, None]) ** 2).sum(1) / n
    assert abs(MD.adaptive_threshold(df) - m.min()) < 1e-9
    assert abs(m.min() - 0.1) < 0.01
    assert MD.adaptive_threshold(spark.createDataFrame([(0.25,)] * 4, "err double")) == 0.25
    assert MD.adaptive_threshold(df.limit(0)) is None


def test_mean_of_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 4.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(mean_of(F.col("a"), F.col("b"))).collect()] == [2.0, 4.0, None]
