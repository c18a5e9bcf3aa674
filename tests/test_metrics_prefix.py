"""Metrics goldens, rank metrics vs brute force, bucketed prefix sums under skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netwarden.operators import metrics as M
from netwarden.operators.prefix import exact_percentiles, prefix_sums, rank_within


def _confusion_df(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "y int, yhat int")


def test_binary_metrics_golden_report(spark):
    # stored report of the reference's RF run: confusion 4928/72/8/4992
    df = _confusion_df(spark, 4928, 72, 8, 4992)
    r = M.binary_metrics(df).first()
    assert r["accuracy"] == pytest.approx(0.992)
    assert r["precision"] == pytest.approx(0.98578, abs=1e-5)
    assert r["recall"] == pytest.approx(0.9984)
    assert r["f1"] == pytest.approx(0.99205, abs=1e-5)


def test_zero_division_is_zero(spark):
    r = M.binary_metrics(spark.createDataFrame([(0, 0), (0, 0)], "y int, yhat int")).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _brute_ap(y, s):
    order = np.argsort(-s, kind="mergesort")
    ap, prev_r, P = 0.0, 0.0, y.sum()
    for thr in np.unique(s)[::-1]:
        sel = s >= thr
        tp = (y[sel] == 1).sum()
        prec, rec = tp / sel.sum(), tp / P
        ap += (rec - prev_r) * prec
        prev_r = rec
    return ap


def test_auc_and_ap_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 2000)
    s = np.round(rng.random(2000) * 0.5 + y * 0.3, 2)   # many ties
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(int), "p": s.astype(float)}))
    auc = M.roc_auc(df, "p", "y").first()[0]
    ap = M.average_precision(df, "p", "y").first()[0]
    assert auc == pytest.approx(_brute_auc(y, s), abs=1e-12)
    assert ap == pytest.approx(_brute_ap(y, s), abs=1e-12)
    flipped = M.roc_auc(df.withColumn("p", 1 - F.col("p")), "p", "y").first()[0]
    assert flipped == pytest.approx(1 - auc, abs=1e-12)


def test_prefix_sums_with_a_hot_group(spark):
    # one group holds ~1/3 of the rows; results must equal a pandas cumsum
    rng = np.random.default_rng(7)
    n = 6000
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d", "e"], n))
    pdf = pd.DataFrame({"g": g, "k": np.arange(n), "w": rng.integers(0, 5, n)})
    df = spark.createDataFrame(pdf)
    got = prefix_sums(df, ["k"], ["w"], ["g"], num_partitions=16).toPandas().sort_values("k")
    exp = pdf.sort_values("k").assign(cum_w=lambda d: d.groupby("g")["w"].cumsum())
    assert got["cum_w"].tolist() == exp["cum_w"].tolist()
    # bucket count bounds the per-task share of the hot group
    ranked = rank_within(df, ["g"], ["k"], "r", num_partitions=16).toPandas()
    assert (ranked.groupby("g")["r"].max() == pdf.groupby("g").size()).all()


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=3001), 3)
    g = rng.integers(0, 3, 3001)
    df = spark.createDataFrame(pd.DataFrame({"g": g.astype(int), "v": v}))
    got = exact_percentiles(df, "v", [0.0, 0.25, 0.5, 0.95, 1.0], ["g"]).toPandas()
    for _, r in got.iterrows():
        assert r["value"] == pytest.approx(np.percentile(v[g == r["g"]], r["p"] * 100), abs=1e-12)


def test_threshold_sweep_one_pass(spark):
    df = spark.createDataFrame([(0.1, 0), (0.93, 1), (0.95, 0), (0.99, 1), (1.0, 1)], "s double, y int")
    rows = {r["tau"]: r for r in M.threshold_sweep(df, "s", "y", [0.9, 0.95, 0.99]).collect()}
    assert (rows[0.9]["tp"], rows[0.9]["fp"]) == (3, 1)
    assert (rows[0.95]["tp"], rows[0.95]["fp"]) == (2, 0)     # strict '>'
    assert rows[0.99]["tp"] == 1
