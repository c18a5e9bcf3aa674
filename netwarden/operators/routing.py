"""Detector gates and routes.

All are row-wise ``when`` chains over a scored table; no model object is
needed to evaluate a route once the error and the stack predictions are
columns.  Note the comparison operators: the two-stage gate blocks on
``err > thr`` while the three-way route blocks on ``err >= high``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds shipped with the deployed router (P75 / P99 of
# the clean-test reconstruction error) and the clip range of gate scores.
DEPLOYED_LOW_THR = 0.000983636
DEPLOYED_HIGH_THR = 0.013118411
GATE_CLIP = (0.8, 1.0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_anomalies(df: DataFrame, err: str = "err", threshold: float | Column = 0.0,
                   out: str = "is_anomaly") -> DataFrame:
    """``err > threshold`` (threshold given or calibrated, F19)."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn(out, (F.col(err) > thr).cast("int"))


def two_stage_gate(df: DataFrame, err: str = "err", threshold: float = 0.0, model_pred="yhat",
                   out: str = "pred") -> DataFrame:
    """Detector first (``err > thr`` -> malicious, stage 1), else the model."""
    blocked = F.col(err) > F.lit(float(threshold))
    return df.withColumns({
        "stage1": blocked.cast("int"),
        out: F.when(blocked, 1).otherwise(_c(model_pred)).cast("int"),
    })


def three_way_route(df: DataFrame, err: str = "err", low: float = DEPLOYED_LOW_THR,
                    high: float = DEPLOYED_HIGH_THR, model_pred=None, tuned_pred=None,
                    standard_pred=None) -> DataFrame:
    """``err >= high`` -> block; ``low <= err < high`` -> tuned stack;
    else standard stack.  Adds ``route``, ``ml_stage`` and ``ml_pred``."""
    e = F.col(err)
    tuned = _c(tuned_pred if tuned_pred is not None else model_pred)
    std = _c(standard_pred if standard_pred is not None else model_pred)
    route = F.when(e >= high, "block").when(e >= low, "tuned").otherwise("standard")
    return df.withColumns({
        "route": route,
        "ml_stage": F.when(e >= high, "dede_blocked").when(e >= low, "ganopt_stacking")
                     .otherwise("standard_stacking"),
        "ml_pred": F.when(e >= high, 1).when(e >= low, tuned).otherwise(std).cast("int"),
    })


def gate_probability(df: DataFrame, err: str = "err", threshold: float = 0.0, p: str = "p",
                     max_err: float | None = None, out: str = "p_final") -> DataFrame:
    """Blocked rows score ``clip(err / max_err, 0.8, 1)``, others keep ``p``.

    ``max_err`` defaults to the batch maximum (one global aggregate joined as
    a one-row broadcast)."""
    df, m = _max_err(df, err, max_err)
    blocked = F.col(err) > F.lit(float(threshold))
    clipped = F.least(F.greatest(F.col(err) / m, F.lit(GATE_CLIP[0])), F.lit(GATE_CLIP[1]))
    return df.withColumn(out, F.when(blocked, clipped).otherwise(F.col(p))).drop("_max_err")


def route_probability(df: DataFrame, err: str = "err", low: float = DEPLOYED_LOW_THR,
                      high: float = DEPLOYED_HIGH_THR, p_tuned: str = "p", p_standard: str = "p",
                      max_err: float | None = None, out: str = "p_final") -> DataFrame:
    """As K17 with three routes."""
    df, m = _max_err(df, err, max_err)
    e = F.col(err)
    clipped = F.least(F.greatest(e / m, F.lit(GATE_CLIP[0])), F.lit(GATE_CLIP[1]))
    return df.withColumn(out, F.when(e >= high, clipped).when(e >= low, F.col(p_tuned))
                         .otherwise(F.col(p_standard))).drop("_max_err")


def _max_err(df: DataFrame, err: str, max_err):
    if max_err is not None:
        return df, F.lit(float(max_err))
    from netwarden.functions.scalars import attach_scalars
    return attach_scalars(df, df.agg(F.max(err).alias("_max_err"))), F.col("_max_err")


def rule_or_model_score(df: DataFrame, stage: str = "stage", p: str = "p_model", out: str = "score") -> DataFrame:
    """A rule-stage row counts as p = 1."""
    return df.withColumn(out, F.when(F.col(stage) == "rule", 1.0).otherwise(F.col(p)))


def decision_output(df: DataFrame, pred: str = "pred", stage: str = "ml_stage", err: str = "err",
                    p: str = "p") -> DataFrame:
    """Prediction, label, stage, error, confidence (1.0 when blocked,
    else the probability of the predicted class)."""
    conf = F.when(F.col(stage) == "dede_blocked", 1.0) \
            .when(F.col(pred) == 1, F.col(p)).otherwise(1 - F.col(p))
    return df.select("*", F.when(F.col(pred) == 1, "malicious").otherwise("benign").alias("label"),
                     conf.alias("confidence"))
