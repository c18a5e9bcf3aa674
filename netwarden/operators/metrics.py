"""Evaluation metrics and error statistics.

Every metric is a single aggregation over a scored table
``(row_id, y, p | yhat, err, ...)`` with optional ``group_by`` keys
(train scenario, test set, model...), so a whole evaluation matrix is ONE
groupBy with partial aggregation, not one job per cell.  Rank metrics
(ROC AUC, average precision, CDF) and order statistics use the
range-partitioned prefix sums of :mod:`netwarden.operators.prefix`.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.operators.prefix import exact_percentiles, prefix_sums


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def _div0(a: Column, b: Column) -> Column:
    """a / b with zero division -> 0 (sklearn ``zero_division=0``)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


# --- counts ------------------------------------------------------------------

def confusion_matrix(df: DataFrame, y: str = "y", yhat: str = "yhat", group_by: Sequence[str] = ()) -> DataFrame:
    """counts by (actual, predicted)."""
    return df.groupBy(*group_by, F.col(y).alias("actual"), F.col(yhat).alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("n"))


def binary_counts(df: DataFrame, y="y", yhat="yhat", group_by: Sequence[str] = ()) -> DataFrame:
    yy, pp = _c(y), _c(yhat)
    return df.groupBy(*group_by).agg(
        _cnt((yy == 1) & (pp == 1)).alias("tp"), _cnt((yy == 0) & (pp == 1)).alias("fp"),
        _cnt((yy == 1) & (pp == 0)).alias("fn"), _cnt((yy == 0) & (pp == 0)).alias("tn"))


def with_binary_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 (zero division -> 0) from counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return counts.select(
        "*", _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def binary_metrics(df: DataFrame, y="y", yhat="yhat", group_by: Sequence[str] = ()) -> DataFrame:
    return with_binary_metrics(binary_counts(df, y, yhat, group_by))


def mcc(counts: DataFrame) -> DataFrame:
    """Matthews correlation (products in double: bigint would overflow)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select("*", F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den).alias("mcc"))


def tpr_fpr(counts: DataFrame, guard: str = "max1") -> DataFrame:
    """rates with the ``max(1, n)`` guard (threshold sweep) or the
    ``+1e-12`` guard (training report)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    if guard == "max1":
        return counts.select("*", (tp / F.greatest(F.lit(1.0), tp + fn)).alias("tpr"),
                             (fp / F.greatest(F.lit(1.0), fp + tn)).alias("fpr"))
    return counts.select("*", (tp / (tp + fn + 1e-12)).alias("tpr"), (fp / (fp + tn + 1e-12)).alias("fpr"))


def threshold_sweep(df: DataFrame, score: str, y: str, taus: Sequence[float], group_by: Sequence[str] = ()) -> DataFrame:
    """TP/FP/FN/TN/TPR/FPR at every ``tau`` (predict ``score > tau``)
    from ONE pass: ``4 x len(taus)`` conditional counts, then unpivoted."""
    s, yy = _c(score), _c(y)
    aggs = []
    for i, t in enumerate(taus):
        pred = s > F.lit(float(t))
        aggs += [_cnt(pred & (yy == 1)).alias(f"tp{i}"), _cnt(pred & (yy == 0)).alias(f"fp{i}"),
                 _cnt(~pred & (yy == 1)).alias(f"fn{i}"), _cnt(~pred & (yy == 0)).alias(f"tn{i}")]
    wide = df.groupBy(*group_by).agg(*aggs)
    rows = ", ".join(f"CAST({float(t)!r} AS DOUBLE), tp{i}, fp{i}, fn{i}, tn{i}" for i, t in enumerate(taus))
    long = wide.select(*group_by, F.expr(f"stack({len(taus)}, {rows}) AS (tau, tp, fp, fn, tn)"))
    return tpr_fpr(long)


def macro_f1(df: DataFrame, y: str = "y", yhat: str = "yhat", group_by: Sequence[str] = ()) -> DataFrame:
    """unweighted mean F1 over classes seen in truth or prediction."""
    per = per_class_counts(df, y, yhat, group_by)
    f1 = _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per.groupBy(*group_by).agg(F.avg(f1).alias("macro_f1"))


def per_class_counts(df: DataFrame, y: str, yhat: str, group_by: Sequence[str] = ()) -> DataFrame:
    """tp / fp / fn / support per class over the union of true and predicted
    classes (one explode of two entries per row, partial aggregation)."""
    yy, pp = _c(y), _c(yhat)
    roles = F.array(F.struct(yy.alias("cls"), F.lit(1).alias("is_true"), (yy == pp).cast("int").alias("hit")),
                    F.struct(pp.alias("cls"), F.lit(0).alias("is_true"), (yy == pp).cast("int").alias("hit")))
    ex = df.select(*group_by, F.explode(roles).alias("r")).select(*group_by, "r.*")
    return ex.groupBy(*group_by, "cls").agg(
        F.sum(F.col("is_true") * F.col("hit")).alias("tp"),
        F.sum((1 - F.col("is_true")) * (1 - F.col("hit"))).alias("fp"),
        F.sum(F.col("is_true") * (1 - F.col("hit"))).alias("fn"),
        F.sum("is_true").alias("support"))


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """per class precision, recall, F1, support, plus accuracy, macro
    avg and weighted avg rows (label column ``cls`` as text)."""
    per = per_class_counts(df, y, yhat)
    tp, fp, fn, sup = (F.col(c) for c in ("tp", "fp", "fn", "support"))
    rows = per.select(F.col("cls").cast("string").alias("cls"), _div0(tp, tp + fp).alias("precision"),
                      _div0(tp, tp + fn).alias("recall"), _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
                      sup.cast("double").alias("support"), tp.alias("_tp"))
    tot = rows.agg(F.sum("support").alias("_n"), F.sum("_tp").alias("_tp"),
                   F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                   F.sum(F.col("precision") * F.col("support")).alias("wp"),
                   F.sum(F.col("recall") * F.col("support")).alias("wr"),
                   F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = _div0(F.col("_tp"), F.col("_n"))
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("cls"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 F.col("_n").alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("_n").alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), _div0(F.col("wp"), F.col("_n")).alias("precision"),
                 _div0(F.col("wr"), F.col("_n")).alias("recall"), _div0(F.col("wf"), F.col("_n")).alias("f1"),
                 F.col("_n").alias("support")))).alias("r")).select("r.*")
    return rows.drop("_tp").unionByName(summary)


# --- rank metrics ------------------------------------------------------------

def score_counts(df: DataFrame, score: str, y: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Positives / negatives per distinct score (map-side combined)."""
    return df.groupBy(*group_by, F.col(score).alias("s")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def _desc_cum(df: DataFrame, score: str, y: str, group_by: Sequence[str]) -> DataFrame:
    sc = score_counts(df, score, y, group_by)
    return prefix_sums(sc, [F.col("s")], ["pos", "neg"], group_by, descending=True)


def roc_auc(df: DataFrame, score: str = "p", y: str = "y", group_by: Sequence[str] = ()) -> DataFrame:
    """exact ROC AUC (ties count one half) as a rank statistic:
    ``sum_s neg_s * (pos_above_s + pos_s / 2) / (P * N)``."""
    c = _desc_cum(df, score, y, group_by)
    return c.groupBy(*group_by).agg(
        (F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)) /
         (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("roc_auc"))


def roc_points(df: DataFrame, score: str = "p", y: str = "y", group_by: Sequence[str] = ()) -> DataFrame:
    """ROC curve points (fpr, tpr) at every distinct threshold."""
    c = _desc_cum(df, score, y, group_by)
    tot = c.groupBy(*group_by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    j = c.join(tot, list(group_by)) if group_by else _attach(c, tot)
    return j.select(*group_by, F.col("s").alias("threshold"),
                    _div0(F.col("cum_neg"), F.col("_N")).alias("fpr"), _div0(F.col("cum_pos"), F.col("_P")).alias("tpr"))


def _attach(df, one):
    from netwarden.functions.scalars import attach_scalars
    return attach_scalars(df, one)


def average_precision(df: DataFrame, score: str = "p", y: str = "y", group_by: Sequence[str] = ()) -> DataFrame:
    """step-wise ``sum_n (R_n - R_{n-1}) P_n`` over distinct thresholds
    (not the trapezoid area Spark's ``areaUnderPR`` reports)."""
    c = _desc_cum(df, score, y, group_by)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return c.groupBy(*group_by).agg(
        (F.sum(F.col("pos") * prec) / F.sum("pos").cast("double")).alias("average_precision"))


def empirical_cdf(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """``(value, cdf)`` per distinct value, cdf = rows <= value / n."""
    vc = df.where(F.col(value).isNotNull()).groupBy(*group_by, value).agg(F.count(F.lit(1)).alias("c"))
    cum = prefix_sums(vc, [F.col(value)], ["c"], group_by)
    tot = cum.groupBy(*group_by).agg(F.max("cum_c").alias("_n"))
    j = cum.join(tot, list(group_by)) if group_by else _attach(cum, tot)
    return j.select(*group_by, value, (F.col("cum_c") / F.col("_n")).alias("cdf"))


# --- error statistics ---------------------------------------------------------

def error_stats(df: DataFrame, err: str = "err", group_by: Sequence[str] = ()) -> DataFrame:
    """mean, population std, median, min, max, q25, q75 per group."""
    base = df.groupBy(*group_by).agg(F.avg(err).alias("mean"), F.stddev_pop(err).alias("std"),
                                     F.min(err).alias("min"), F.max(err).alias("max"),
                                     F.count(err).alias("n"))
    q = exact_percentiles(df, err, [0.25, 0.5, 0.75], group_by)
    wide = q.groupBy(*group_by).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.toDF(*group_by, "q25", "median", "q75")
    return base.join(wide, list(group_by)) if group_by else _attach(base, wide)


def error_shift(df: DataFrame, err: str, group: str, base_value, other_value) -> DataFrame:
    """F16: absolute and relative increase of mean error from group
    ``base_value`` to ``other_value``."""
    m = df.groupBy().agg(F.avg(F.when(F.col(group) == base_value, F.col(err))).alias("mean_base"),
                         F.avg(F.when(F.col(group) == other_value, F.col(err))).alias("mean_other"))
    return m.select("*", (F.col("mean_other") - F.col("mean_base")).alias("abs_increase"),
                    _div0(F.col("mean_other") - F.col("mean_base"), F.col("mean_base")).alias("rel_increase"))


def error_histogram(df: DataFrame, err: str = "err", group_by: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """equal-width bins over min..max (last bin closed), count and
    numpy-style density per group."""
    rng = df.groupBy(*group_by).agg(F.min(err).alias("_lo"), F.max(err).alias("_hi"), F.count(err).alias("_n"))
    j = df.join(rng, list(group_by)) if group_by else _attach(df, rng)
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(err) - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    h = j.where(F.col(err).isNotNull()).groupBy(*group_by, b.alias("bin"), "_lo", "_hi", "_n") \
         .agg(F.count(F.lit(1)).alias("count"))
    wd = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return h.select(*group_by, "bin", (F.col("_lo") + F.col("bin") * wd).alias("left"), "count",
                    _div0(F.col("count"), F.col("_n") * wd).alias("density"))


def calibrate_threshold(df: DataFrame, err: str = "err", probs: Sequence[float] = (0.75, 0.95, 0.99),
                        where: Column | None = None) -> DataFrame:
    """exact percentiles of (clean) errors, numpy-linear interpolation."""
    src = df.where(where) if where is not None else df
    return exact_percentiles(src, err, probs)


# --- attack / defence rates ----------------------------------------------------

def attack_success_rates(df: DataFrame, y: str = "y", pred: str = "pred", passed: str = "passed",
                         triggered: str = "triggered", group_by: Sequence[str] = ()) -> DataFrame:
    """three definitions, in percent:

    * ``asr_model``  -- triggered malicious rows predicted benign
    * ``asr_gated``  -- among triggered malicious rows that pass the gate,
      share predicted benign (0 when none pass)
    * ``asr_bypass`` -- share of triggered malicious rows that pass the gate
    """
    mal = (F.col(triggered) == 1) & (F.col(y) == 1)
    return df.groupBy(*group_by).agg(
        (_div0(_cnt(mal & (F.col(pred) == 0)), _cnt(mal)) * 100).alias("asr_model"),
        (_div0(_cnt(mal & (F.col(passed) == 1) & (F.col(pred) == 0)), _cnt(mal & (F.col(passed) == 1))) * 100)
        .alias("asr_gated"),
        (_div0(_cnt(mal & (F.col(passed) == 1)), _cnt(mal)) * 100).alias("asr_bypass"))


def false_positive_rate(df: DataFrame, y: str = "y", flagged: str = "flagged",
                        group_by: Sequence[str] = ()) -> DataFrame:
    """F32: share (percent) of clean benign rows flagged."""
    ben = F.col(y) == 0
    return df.groupBy(*group_by).agg((_div0(_cnt(ben & (F.col(flagged) == 1)), _cnt(ben)) * 100)
                                     .alias("false_positive_rate"))


def route_shares(df: DataFrame, route: str = "route", group_by: Sequence[str] = ()) -> DataFrame:
    """percent routed to block / tuned / standard."""
    n = F.count(F.lit(1))
    return df.groupBy(*group_by).agg(*[(_cnt(F.col(route) == r) * 100.0 / n).alias(f"route_{r}")
                                       for r in ("block", "tuned", "standard")])


def stage_shares(df: DataFrame, stage1: str = "stage1", group_by: Sequence[str] = ()) -> DataFrame:
    """percent stopped at stage 1 and passed to stage 2."""
    n = F.count(F.lit(1))
    return df.groupBy(*group_by).agg((_cnt(F.col(stage1) == 1) * 100.0 / n).alias("stage1_pct"),
                                     (_cnt(F.col(stage1) == 0) * 100.0 / n).alias("stage2_pct"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """per class ``n / (k * count)`` (balanced), ``total/count``
    normalised to mean 1, and the binary ``pos_weight = neg / pos``."""
    counts = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"),
                     F.sum(F.lit(1.0) / F.col("count")).alias("_inv"),
                     F.sum(F.when(F.col("cls") == 0, F.col("count"))).alias("_neg"),
                     F.sum(F.when(F.col("cls") == 1, F.col("count"))).alias("_pos"))
    j = _attach(counts, tot)
    return j.select("cls", "count",
                    (F.col("_n") / (F.col("_k") * F.col("count"))).alias("balanced"),
                    ((F.lit(1.0) / F.col("count")) / (F.col("_inv") / F.col("_k"))).alias("normalised"),
                    _div0(F.col("_neg"), F.col("_pos")).alias("pos_weight"))


def mean_of(*errors: Column) -> Column:
    """mean of a row's detector errors, leaving out nulls (null without any)."""
    some = F.filter(F.array(*errors), lambda e: e.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda acc, e: acc + e) / F.size(some))
