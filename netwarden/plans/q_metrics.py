"""Registered queries: evaluation metrics, error statistics, evaluation
matrix (F15-F42, K21, E03, E04, G09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.functions.clean import attack_family, probability_band
from netwarden.operators import metrics as M
from netwarden.operators.dashboard import count_top_k
from netwarden.operators.routing import three_way_route, two_stage_gate
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.q_clean import family_sql
from netwarden.plans.registry import register
from netwarden.plans.store import event_store

R = 6
GATE_THR = views.FIXTURE_ROUTE_HIGH
TAUS = [0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99]


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), R) for c in cols})


TIE = 1e-12


def _rt(df: DataFrame, *cols: str) -> DataFrame:
    """Round averages of decimal-grid values: the exact mean can sit on a
    6th-decimal tie and the engines' last bits differ, so both nudge by 1e-12
    before rounding (SQL twin: ``round(x + 1e-12, 6)``)."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(TIE), R) for c in cols})


def scored_long(spark, sf_dir) -> DataFrame:
    s = views.scored(spark, sf_dir)
    m = F.explode(F.array(F.struct(F.lit("p").alias("model"), F.col("p").alias("score")),
                          F.struct(F.lit("p2").alias("model"), F.col("p2").alias("score"))))
    return s.select("row_id", "y", m.alias("m")).select("row_id", "y", "m.*")


def eval_long(spark, sf_dir) -> DataFrame:
    """Every scored row in every (train scenario x defence) cell -- a fixed
    4x fan-out evaluated map side, then one groupBy for all cells."""
    s = views.scored(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("train_scenario"), F.lit(d).alias("defence"))
                                for t in ("clean", "poison_50") for d in ("none", "gate")]))
    x = s.select("row_id", "y", "err", "p", "p2", cells.alias("c")).select("*", "c.*").drop("c")
    model = F.when(F.col("train_scenario") == "clean", (F.col("p") >= 0.5).cast("int")) \
             .otherwise((F.col("p2") >= 0.5).cast("int"))
    gated = (F.col("defence") == "gate") & (F.col("err") > GATE_THR)
    return x.select("row_id", "y", "err", "train_scenario", "defence",
                    F.when(gated, 1).otherwise(model).alias("pred"), gated.cast("int").alias("stage1"))


def eval_matrix(spark, sf_dir) -> DataFrame:
    """All cells, all metrics, ONE groupBy."""
    el = eval_long(spark, sf_dir)
    g = ["train_scenario", "defence"]
    counts = el.groupBy(*g).agg(
        F.count(F.when((F.col("y") == 1) & (F.col("pred") == 1), 1)).alias("tp"),
        F.count(F.when((F.col("y") == 0) & (F.col("pred") == 1), 1)).alias("fp"),
        F.count(F.when((F.col("y") == 1) & (F.col("pred") == 0), 1)).alias("fn"),
        F.count(F.when((F.col("y") == 0) & (F.col("pred") == 0), 1)).alias("tn"),
        (F.count(F.when(F.col("stage1") == 1, 1)) * 100.0 / F.count(F.lit(1))).alias("stage1_pct"))
    m = M.with_binary_metrics(counts).withColumnRenamed("f1", "f1_score")
    return _r(m.select(*g, "accuracy", "precision", "recall", "f1_score", "stage1_pct"),
              "accuracy", "precision", "recall", "f1_score", "stage1_pct")


@register("confusion_matrix", sql("SELECT y AS actual, yhat AS predicted, count(*) AS n FROM scored GROUP BY 1, 2",
                                  "scored"))
def confusion_matrix(spark, sf_dir):
    """counts by (actual, predicted)."""
    return M.confusion_matrix(views.scored(spark, sf_dir))


BIN_SQL = """
SELECT tp, fp, fn, tn,
  round(CASE WHEN tp+fp+fn+tn = 0 THEN 0.0 ELSE (tp+tn) / (tp+fp+fn+tn) END, 6) AS accuracy,
  round(CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp / (tp+fp) END, 6) AS precision,
  round(CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp / (tp+fn) END, 6) AS recall,
  round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2*tp / (2*tp+fp+fn) END, 6) AS f1
FROM (SELECT count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn
      FROM scored) c"""


@register("binary_metrics", sql(BIN_SQL, "scored"))
def binary_metrics(spark, sf_dir):
    """accuracy / precision / recall / F1, zero division -> 0."""
    return _r(M.binary_metrics(views.scored(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


@register("macro_f1", sql("""
WITH per AS (
  SELECT cls, sum(is_true * hit) AS tp, sum((1 - is_true) * (1 - hit)) AS fp, sum(is_true * (1 - hit)) AS fn
  FROM (SELECT y AS cls, 1 AS is_true, CAST(y = yhat AS INT) AS hit FROM scored
        UNION ALL SELECT yhat, 0, CAST(y = yhat AS INT) FROM scored) r GROUP BY cls)
SELECT round(avg(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2*tp / (2*tp+fp+fn) END), 6) AS macro_f1 FROM per""",
                          "scored"))
def macro_f1(spark, sf_dir):
    """unweighted mean F1 over classes in truth or prediction."""
    return _r(M.macro_f1(views.scored(spark, sf_dir)), "macro_f1")


RANK_SQL = """
, sc AS (SELECT model, score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scored_long GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
             sum(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cum_neg FROM sc)
"""


def _rank_sql(select: str) -> str:
    base = sql("SELECT 1", "scored_long")
    return base[:-len("SELECT 1")].rstrip() + RANK_SQL + select


@register("roc_auc", _rank_sql("""SELECT model,
  round(sum(neg * (cum_pos - pos + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc
FROM c GROUP BY model"""))
def roc_auc(spark, sf_dir):
    """exact ROC AUC per model via distributed prefix sums."""
    return _r(M.roc_auc(scored_long(spark, sf_dir), "score", "y", ["model"]), "roc_auc")


@register("average_precision", _rank_sql("""SELECT model,
  round(sum(pos * cum_pos / (cum_pos + cum_neg)) / CAST(sum(pos) AS DOUBLE), 6) AS average_precision
FROM c GROUP BY model"""))
def average_precision(spark, sf_dir):
    """step-wise average precision per model."""
    return _r(M.average_precision(scored_long(spark, sf_dir), "score", "y", ["model"]), "average_precision")


@register("roc_points", _rank_sql("""SELECT model, s AS threshold,
  round(cum_neg / CAST(sum(neg) OVER (PARTITION BY model) AS DOUBLE), 6) AS fpr,
  round(cum_pos / CAST(sum(pos) OVER (PARTITION BY model) AS DOUBLE), 6) AS tpr FROM c"""))
def roc_points(spark, sf_dir):
    """ROC points at every distinct threshold."""
    return _r(M.roc_points(scored_long(spark, sf_dir), "score", "y", ["model"]), "fpr", "tpr")


@register("mcc", sql("""
SELECT round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 THEN 0.0
  ELSE (tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) END, 6) AS mcc
FROM (SELECT CAST(count(*) FILTER (WHERE y = 1 AND yhat = 1) AS DOUBLE) AS tp,
             CAST(count(*) FILTER (WHERE y = 0 AND yhat = 1) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (WHERE y = 1 AND yhat = 0) AS DOUBLE) AS fn,
             CAST(count(*) FILTER (WHERE y = 0 AND yhat = 0) AS DOUBLE) AS tn FROM scored) c""", "scored"))
def mcc(spark, sf_dir):
    """Matthews correlation from the four counts."""
    return _r(M.mcc(M.binary_counts(views.scored(spark, sf_dir))).select("mcc"), "mcc")


@register("tpr_fpr", sql("""
SELECT round(tp / (tp + fn + 1e-12), 6) AS tpr, round(fp / (fp + tn + 1e-12), 6) AS fpr
FROM (SELECT CAST(count(*) FILTER (WHERE y = 1 AND yhat = 1) AS DOUBLE) AS tp,
             CAST(count(*) FILTER (WHERE y = 0 AND yhat = 1) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (WHERE y = 1 AND yhat = 0) AS DOUBLE) AS fn,
             CAST(count(*) FILTER (WHERE y = 0 AND yhat = 0) AS DOUBLE) AS tn FROM scored) c""", "scored"))
def tpr_fpr(spark, sf_dir):
    """rates with the 1e-12 guard."""
    return _r(M.tpr_fpr(M.binary_counts(views.scored(spark, sf_dir)), guard="eps").select("tpr", "fpr"), "tpr", "fpr")


_TAU_VALUES = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in TAUS)


@register("threshold_sweep", sql(f"""
SELECT tau, tp, fp, fn, tn, round(tp / greatest(1, tp + fn), 6) AS tpr, round(fp / greatest(1, fp + tn), 6) AS fpr
FROM (SELECT t.tau,
        count(*) FILTER (WHERE s > t.tau AND gt_label = 1) AS tp, count(*) FILTER (WHERE s > t.tau AND gt_label = 0) AS fp,
        count(*) FILTER (WHERE NOT s > t.tau AND gt_label = 1) AS fn,
        count(*) FILTER (WHERE NOT s > t.tau AND gt_label = 0) AS tn
      FROM (SELECT gt_label, CASE WHEN stage = 'rule' THEN 1.0 ELSE p_model END AS s FROM events_scored) e,
           (VALUES {_TAU_VALUES}) t(tau) GROUP BY t.tau) c""", "events_scored"))
def threshold_sweep(spark, sf_dir):
    """F29 + K25: score once (rule stage counts as p = 1), sweep 8 taus in one pass."""
    from netwarden.operators.routing import rule_or_model_score
    ev = rule_or_model_score(event_store(spark, sf_dir), "stage", "p_model", "s")
    return _r(M.threshold_sweep(ev, "s", "gt_label", TAUS), "tpr", "fpr")


@register("classification_report", sql("""
WITH per AS (
  SELECT cls, sum(is_true * hit) AS tp, sum((1 - is_true) * (1 - hit)) AS fp, sum(is_true * (1 - hit)) AS fn,
         sum(is_true) AS support
  FROM (SELECT y AS cls, 1 AS is_true, CAST(y = yhat AS INT) AS hit FROM scored
        UNION ALL SELECT yhat, 0, CAST(y = yhat AS INT) FROM scored) r GROUP BY cls),
rows AS (
  SELECT CAST(cls AS VARCHAR) AS cls, CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp / (tp+fp) END AS precision,
         CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp / (tp+fn) END AS recall,
         CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2*tp / (2*tp+fp+fn) END AS f1, CAST(support AS DOUBLE) AS support, tp
  FROM per),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM rows)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rows
UNION ALL SELECT 'accuracy', round(tp / n, 6), round(tp / n, 6), round(tp / n, 6), n FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM tot
UNION ALL SELECT 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), n FROM tot""", "scored"))
def classification_report(spark, sf_dir):
    """per class rows + accuracy, macro and weighted averages."""
    return _r(M.classification_report(views.scored(spark, sf_dir)), "precision", "recall", "f1")


@register("error_stats", sql("""
SELECT y, round(avg(err) + 1e-12, 6) AS mean, round(stddev_pop(err), 6) AS std, min(err) AS min, max(err) AS max,
       count(err) AS n, round(quantile_cont(err, 0.25), 6) AS q25, round(quantile_cont(err, 0.5), 6) AS median,
       round(quantile_cont(err, 0.75), 6) AS q75
FROM scored GROUP BY y""", "scored"))
def error_stats(spark, sf_dir):
    """mean, population std, median, min, max, q25, q75 per class."""
    return _rt(_r(M.error_stats(views.scored(spark, sf_dir), "err", ["y"]), "std", "q25", "median", "q75"), "mean")


@register("error_shift", sql("""
SELECT round(mean_base + 1e-12, 6) AS mean_base, round(mean_other + 1e-12, 6) AS mean_other,
       round(mean_other - mean_base + 1e-12, 6) AS abs_increase,
       round(CASE WHEN mean_base = 0 THEN 0.0 ELSE (mean_other - mean_base) / mean_base END, 6) AS rel_increase
FROM (SELECT avg(err) FILTER (WHERE y = 0) AS mean_base, avg(err) FILTER (WHERE y = 1) AS mean_other FROM scored) m""",
                             "scored"))
def error_shift(spark, sf_dir):
    """F16: increase of mean error from clean (y=0) to attack (y=1) rows."""
    return _rt(_r(M.error_shift(views.scored(spark, sf_dir), "err", "y", 0, 1), "rel_increase"),
               "mean_base", "mean_other", "abs_increase")


@register("error_histogram", sql("""
WITH r AS (SELECT y, min(err) AS lo, max(err) AS hi, count(err) AS n FROM scored GROUP BY y),
h AS (SELECT s.y, CAST(CASE WHEN (r.hi - r.lo) / 50.0 = 0 THEN 0
             ELSE least(floor((s.err - r.lo) / ((r.hi - r.lo) / 50.0)), 49) END AS INT) AS bin, r.lo, r.hi, r.n,
             count(*) AS count
      FROM scored s JOIN r ON s.y = r.y WHERE s.err IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
SELECT y, bin, round(lo + bin * ((hi - lo) / 50.0), 6) AS "left", count,
       round(CASE WHEN n * ((hi - lo) / 50.0) = 0 THEN 0.0 ELSE count / (n * ((hi - lo) / 50.0)) END, 6) AS density
FROM h""", "scored"))
def error_histogram(spark, sf_dir):
    """50 equal-width bins per class, count and density."""
    return _r(M.error_histogram(views.scored(spark, sf_dir), "err", ["y"]), "left", "density")


@register("error_cdf", sql("""
WITH vc AS (SELECT y, err, count(*) AS c FROM scored WHERE err IS NOT NULL GROUP BY 1, 2)
SELECT y, err, round(sum(c) OVER (PARTITION BY y ORDER BY err ROWS UNBOUNDED PRECEDING)
                     / CAST(sum(c) OVER (PARTITION BY y) AS DOUBLE), 6) AS cdf FROM vc""", "scored"))
def error_cdf(spark, sf_dir):
    """empirical CDF per class (range-partitioned prefix sums)."""
    return _r(M.empirical_cdf(views.scored(spark, sf_dir), "err", ["y"]), "cdf")


@register("calibrate_threshold", sql("""
SELECT p, round(v, 6) AS value FROM (
  SELECT CAST(0.75 AS DOUBLE) AS p, quantile_cont(err, 0.75) AS v FROM scored WHERE y = 0
  UNION ALL SELECT CAST(0.95 AS DOUBLE), quantile_cont(err, 0.95) FROM scored WHERE y = 0
  UNION ALL SELECT CAST(0.99 AS DOUBLE), quantile_cont(err, 0.99) FROM scored WHERE y = 0) t""", "scored"))
def calibrate_threshold(spark, sf_dir):
    """P75 / P95 / P99 of clean errors (exact, distributed)."""
    s = views.scored(spark, sf_dir)
    return _r(M.calibrate_threshold(s, "err", [0.75, 0.95, 0.99], F.col("y") == 0), "value")


@register("band_counts", sql("""
SELECT count(*) FILTER (WHERE p < 0.2) AS low, count(*) FILTER (WHERE p >= 0.2 AND p <= 0.95) AS mid,
       count(*) FILTER (WHERE p > 0.95) AS high, min(p) AS p_min, round(avg(p) + 1e-12, 6) AS p_mean, max(p) AS p_max
FROM scored""", "scored"))
def band_counts(spark, sf_dir):
    """rows per probability band; min, mean, max p."""
    s = views.scored(spark, sf_dir)
    b = probability_band("p")
    return _rt(s.agg(F.count(F.when(b == "low", 1)).alias("low"), F.count(F.when(b == "mid", 1)).alias("mid"),
                     F.count(F.when(b == "high", 1)).alias("high"), F.min("p").alias("p_min"),
                     F.avg("p").alias("p_mean"), F.max("p").alias("p_max")), "p_mean")


@register("top_predicted_families", sql(f"""
SELECT {family_sql('Attack')} AS family, count(*) AS n FROM scored WHERE p > 0.95
GROUP BY 1 ORDER BY n DESC, family LIMIT 10""", "scored"))
def top_predicted_families(spark, sf_dir):
    """Family counts among rows above tau_high, top 10."""
    s = views.scored(spark, sf_dir)
    return count_top_k(s, attack_family("Attack"), 10, F.col("p") > 0.95, "family")


@register("attack_success_rate", sql(f"""
SELECT round(CASE WHEN count(*) FILTER (WHERE y = 1) = 0 THEN 0.0 ELSE
         count(*) FILTER (WHERE y = 1 AND yhat = 0) / count(*) FILTER (WHERE y = 1) END * 100, 6) AS asr_model,
       round(CASE WHEN count(*) FILTER (WHERE y = 1 AND err <= {GATE_THR}) = 0 THEN 0.0 ELSE
         count(*) FILTER (WHERE y = 1 AND err <= {GATE_THR} AND yhat = 0)
         / count(*) FILTER (WHERE y = 1 AND err <= {GATE_THR}) END * 100, 6) AS asr_gated,
       round(CASE WHEN count(*) FILTER (WHERE y = 1) = 0 THEN 0.0 ELSE
         count(*) FILTER (WHERE y = 1 AND err <= {GATE_THR}) / count(*) FILTER (WHERE y = 1) END * 100, 6) AS asr_bypass
FROM scored""", "scored"))
def attack_success_rate(spark, sf_dir):
    """the three ASR definitions, kept apart by name."""
    s = views.scored(spark, sf_dir).select(
        "y", F.lit(1).alias("triggered"), F.col("yhat").alias("pred"),
        (F.col("err") <= GATE_THR).cast("int").alias("passed"))
    return _r(M.attack_success_rates(s), "asr_model", "asr_gated", "asr_bypass")


@register("false_positive_rate", sql(f"""
SELECT round(count(*) FILTER (WHERE y = 0 AND err > {GATE_THR}) * 100.0 / count(*) FILTER (WHERE y = 0), 6)
       AS false_positive_rate FROM scored""", "scored"))
def false_positive_rate(spark, sf_dir):
    """F32: clean benign rows above the gate, percent."""
    s = views.scored(spark, sf_dir).withColumn("flagged", (F.col("err") > GATE_THR).cast("int"))
    return _r(M.false_positive_rate(s), "false_positive_rate")


@register("route_shares", sql(f"""
SELECT round(count(*) FILTER (WHERE err >= {views.FIXTURE_ROUTE_HIGH}) * 100.0 / count(*), 6) AS route_block,
  round(count(*) FILTER (WHERE err >= {views.FIXTURE_ROUTE_LOW} AND err < {views.FIXTURE_ROUTE_HIGH}) * 100.0
        / count(*), 6) AS route_tuned,
  round(count(*) FILTER (WHERE err < {views.FIXTURE_ROUTE_LOW}) * 100.0 / count(*), 6) AS route_standard
FROM scored""", "scored"))
def route_shares(spark, sf_dir):
    """F33 + K16: percent per route of the three-way router."""
    s = three_way_route(views.scored(spark, sf_dir), "err", views.FIXTURE_ROUTE_LOW, views.FIXTURE_ROUTE_HIGH,
                        model_pred="yhat")
    return _r(M.route_shares(s), "route_block", "route_tuned", "route_standard")


@register("stage_shares", sql(f"""
SELECT round(count(*) FILTER (WHERE err > {GATE_THR}) * 100.0 / count(*), 6) AS stage1_pct,
       round(count(*) FILTER (WHERE NOT err > {GATE_THR}) * 100.0 / count(*), 6) AS stage2_pct FROM scored""",
                              "scored"))
def stage_shares(spark, sf_dir):
    """F34 + K15: share stopped at stage 1 / passed to stage 2."""
    s = two_stage_gate(views.scored(spark, sf_dir), "err", GATE_THR, "yhat")
    return _r(M.stage_shares(s), "stage1_pct", "stage2_pct")


@register("class_weights", sql("""
WITH c AS (SELECT family AS cls, count(*) AS count FROM vectors GROUP BY 1),
t AS (SELECT sum(count) AS n, count(*) AS k, sum(1.0 / count) AS inv, sum(count) FILTER (WHERE cls = 0) AS neg,
             sum(count) FILTER (WHERE cls = 1) AS pos FROM c)
SELECT cls, count, round(n / (k * count), 6) AS balanced, round((1.0 / count) / (inv / k), 6) AS normalised,
       round(CASE WHEN pos = 0 THEN 0.0 ELSE neg / pos END, 6) AS pos_weight FROM c, t""", "vectors"))
def class_weights(spark, sf_dir):
    """balanced, mean-normalised and pos_weight class weights."""
    v = views.vectors(spark, sf_dir).select(F.col("family").alias("y"))
    return _r(M.class_weights(v), "balanced", "normalised", "pos_weight")


@register("meta_feature_stats", sql("""
SELECT model, round(avg(score) + 1e-12, 6) AS mean, round(stddev_pop(score), 6) AS std FROM scored_long
GROUP BY model""",
                                    "scored_long"))
def meta_feature_stats(spark, sf_dir):
    """mean and std of every base model's score (unpivoted)."""
    g = scored_long(spark, sf_dir).groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return _rt(_r(g, "std"), "mean")


@register("evaluation_matrix", sql("SELECT * FROM eval_matrix", "eval_matrix"))
def evaluation_matrix(spark, sf_dir):
    """Train scenario x defence, all metrics in one groupBy."""
    return eval_matrix(spark, sf_dir)


@register("result_matrix", sql("""
SELECT train_scenario, max(f1_score) FILTER (WHERE defence = 'none') AS none,
       max(f1_score) FILTER (WHERE defence = 'gate') AS gate FROM eval_matrix GROUP BY 1""", "eval_matrix"))
def result_matrix(spark, sf_dir):
    """pivot long results to a train x defence F1 grid."""
    return eval_matrix(spark, sf_dir).groupBy("train_scenario").pivot("defence", ["none", "gate"]) \
        .agg(F.first("f1_score"))


@register("delta_f1", sql("""
SELECT train_scenario, defence, round(f1_score - (SELECT f1_score FROM eval_matrix
       WHERE train_scenario = 'clean' AND defence = 'none'), 6) AS delta_f1 FROM eval_matrix""", "eval_matrix"))
def delta_f1(spark, sf_dir):
    """F1 minus the clean reference cell."""
    from netwarden.functions.scalars import attach_scalars
    m = eval_matrix(spark, sf_dir)
    ref = m.where((F.col("train_scenario") == "clean") & (F.col("defence") == "none")).select(
        F.col("f1_score").alias("_ref"))
    return attach_scalars(m, ref).select("train_scenario", "defence",
                                         F.round(F.col("f1_score") - F.col("_ref"), R).alias("delta_f1"))


@register("compare_runs", sql("""
SELECT a.train_scenario, a.f1_score AS f1_none, b.f1_score AS f1_gate, round(b.f1_score - a.f1_score, 6) AS delta,
  CASE WHEN b.f1_score - a.f1_score > 0.003 THEN 'better' WHEN b.f1_score - a.f1_score < -0.003 THEN 'worse'
       ELSE 'equal' END AS tag
FROM eval_matrix a JOIN eval_matrix b ON a.train_scenario = b.train_scenario
WHERE a.defence = 'none' AND b.defence = 'gate'""", "eval_matrix"))
def compare_runs(spark, sf_dir):
    """Match two experiments' rows by key, delta, tag at +-0.003."""
    m = eval_matrix(spark, sf_dir)
    a = m.where(F.col("defence") == "none").select("train_scenario", F.col("f1_score").alias("f1_none"))
    b = m.where(F.col("defence") == "gate").select("train_scenario", F.col("f1_score").alias("f1_gate"))
    d = F.col("f1_gate") - F.col("f1_none")
    return a.join(b, "train_scenario").select(
        "train_scenario", "f1_none", "f1_gate", F.round(d, R).alias("delta"),
        F.when(d > 0.003, "better").when(d < -0.003, "worse").otherwise("equal").alias("tag"))


@register("baseline_vs_attack", sql("""
SELECT train_scenario AS model, max(accuracy) FILTER (WHERE defence = 'none') AS baseline_accuracy,
  max(accuracy) FILTER (WHERE defence = 'gate') AS attack_accuracy,
  round(max(accuracy) FILTER (WHERE defence = 'none') - max(accuracy) FILTER (WHERE defence = 'gate'), 6) AS accuracy_drop,
  max(f1_score) FILTER (WHERE defence = 'none') AS baseline_f1, max(f1_score) FILTER (WHERE defence = 'gate') AS attack_f1,
  round(max(f1_score) FILTER (WHERE defence = 'none') - max(f1_score) FILTER (WHERE defence = 'gate'), 6) AS f1_drop
FROM eval_matrix GROUP BY 1""", "eval_matrix"))
def baseline_vs_attack(spark, sf_dir):
    """Per model baseline vs second-condition accuracy / F1 and drops."""
    m = eval_matrix(spark, sf_dir)
    g = m.groupBy(F.col("train_scenario").alias("model")).agg(
        F.max(F.when(F.col("defence") == "none", F.col("accuracy"))).alias("baseline_accuracy"),
        F.max(F.when(F.col("defence") == "gate", F.col("accuracy"))).alias("attack_accuracy"),
        F.max(F.when(F.col("defence") == "none", F.col("f1_score"))).alias("baseline_f1"),
        F.max(F.when(F.col("defence") == "gate", F.col("f1_score"))).alias("attack_f1"))
    return g.select("model", "baseline_accuracy", "attack_accuracy",
                    F.round(F.col("baseline_accuracy") - F.col("attack_accuracy"), R).alias("accuracy_drop"),
                    "baseline_f1", "attack_f1", F.round(F.col("baseline_f1") - F.col("attack_f1"), R).alias("f1_drop"))


@register("rank_models", sql("""
SELECT train_scenario, defence, f1_score FROM eval_matrix ORDER BY f1_score DESC, train_scenario, defence""",
                             "eval_matrix"))
def rank_models(spark, sf_dir):
    """Result rows sorted by F1 descending (a handful of rows)."""
    return eval_matrix(spark, sf_dir).select("train_scenario", "defence", "f1_score") \
        .orderBy(F.col("f1_score").desc(), "train_scenario", "defence")


@register("checkpoint_profile", sql(f"""
SELECT {family_sql('Attack')} AS grp, round(avg(p) + 1e-12, 6) AS mean_p, round(stddev_pop(p), 6) AS std_p,
       round(avg(err) + 1e-12, 6) AS mean_err,
       round(count(*) FILTER (WHERE p < 0.5) * 1.0 / count(*) + 1e-12, 6) AS share_below
FROM scored GROUP BY 1""", "scored"))
def checkpoint_profile(spark, sf_dir):
    """per group mean / std of score, mean error, share below the
    decision threshold (grouped by attack family here)."""
    s = views.scored(spark, sf_dir)
    g = s.groupBy(attack_family("Attack").alias("grp")).agg(
        F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.avg("err").alias("mean_err"),
        (F.count(F.when(F.col("p") < 0.5, 1)) / F.count(F.lit(1))).alias("share_below"))
    return _rt(_r(g, "std_p"), "mean_p", "mean_err", "share_below")


@register("mean_error_ensemble", sql("""
SELECT row_id, round(avg(e) + 1e-12, 6) AS mean_err FROM (
  SELECT row_id, err AS e FROM scored UNION ALL SELECT row_id, abs(p - yhat) AS e FROM scored) d GROUP BY row_id""",
                                     "scored"))
def mean_error_ensemble(spark, sf_dir):
    """average error over several detectors (a row-wise expression)."""
    s = views.scored(spark, sf_dir)
    return _rt(s.select("row_id", M.mean_of(F.col("err"), F.abs(F.col("p") - F.col("yhat"))).alias("mean_err")), "mean_err")
