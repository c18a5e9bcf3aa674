"""Closed-form Gaussian Bayes classifier.

A class is described by the count, means and variances of its rows: sufficient
statistics that one aggregate gives for every training scenario at once.
The log odds of two such classes are a quadratic in every feature, so a model
is 2 d + 1 numbers and scoring is one expression per row, for all scenarios in
the same pass.  No iteration and no random start: the same rows give the same
model everywhere, which makes every number built on it checkable in SQL.
Priors are equal (balanced classes); a constant feature gets ``MIN_VAR``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.operators.features import moments

MIN_VAR = 1e-9


@dataclass
class GaussianBayes:
    """log p(x | 1) - log p(x | 0) = bias + sum(a x^2 + b x)."""
    bias: float
    linear: list[float]
    square: list[float]

    def log_odds(self, features: Column) -> Column:
        a, b = (F.array(*[F.lit(float(v)) for v in t]) for t in (self.square, self.linear))
        terms = F.zip_with(F.zip_with(a, features, lambda k, x: k * x), F.zip_with(b, features, lambda k, x: F.struct(k.alias("k"), x.alias("x"))),
                           lambda ax, t: (ax + t["k"]) * t["x"])
        return F.lit(self.bias) + F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    def predict(self, features: Column) -> Column:
        return (self.log_odds(features) > 0).cast("int")


def fit_gaussian_bayes(df: DataFrame, scenario: Sequence[str] = (), label: str = "y", features: str = "features") -> dict:
    """One model per scenario (key: tuple of the scenario columns), all from one
    aggregate; a scenario without rows of both classes has no model."""
    by: dict[tuple, dict] = {}
    for r in moments(df, features, [*scenario, label]):
        by.setdefault(tuple(r[c] for c in scenario), {})[int(r[label])] = r
    out = {}
    for key, c in by.items():
        if set(c) != {0, 1}:
            continue
        m0, m1 = c[0]["mean"], c[1]["mean"]
        v0, v1 = ([max(v, MIN_VAR) for v in c[k]["var"]] for k in (0, 1))
        bias = sum(a * a / (2 * p) - b * b / (2 * q) + 0.5 * math.log(p / q) for a, b, p, q in zip(m0, m1, v0, v1))
        out[key] = GaussianBayes(bias, [b / q - a / p for a, b, p, q in zip(m0, m1, v0, v1)], [1 / (2 * p) - 1 / (2 * q) for p, q in zip(v0, v1)])
    return out


def predict_all(df: DataFrame, models: dict[str, GaussianBayes], name: str = "train_scenario", features: str = "features",
                out: str = "yhat") -> DataFrame:
    """Every row scored by every model: one (scenario, prediction) pair each, in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias(name), m.predict(F.col(features)).alias(out)) for k, m in sorted(models.items())])
    kept = [c for c in df.columns if c != features]
    return df.select(*kept, F.explode(cells).alias("_c")).select(*kept, "_c.*")
