"""Registered queries: detectors, gates, routes, votes, k-NN and model fits
(K01-K25, E05-E08, J10, F43)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.functions.scalars import attach_scalars
from netwarden.operators import discriminant as GB
from netwarden.operators import knn as KNN
from netwarden.operators import models as MD
from netwarden.operators import routing as RT
from netwarden.operators import tamper as TM
from netwarden.operators.metrics import calibrate_threshold
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.q_metrics import scored_long
from netwarden.plans.q_sampling import POISON_SQL, POS_SQL, POSITIONS, _grid
from netwarden.plans.registry import register
from netwarden.plans.store import event_store

R = 6
LOW, HIGH = views.FIXTURE_ROUTE_LOW, views.FIXTURE_ROUTE_HIGH
K_NEIGHBORS = 5


@register("flag_anomalies", sql("""
SELECT row_id, CAST(err > (SELECT quantile_cont(err, 0.95) FROM scored WHERE y = 0) AS INT) AS is_anomaly
FROM scored""", "scored"))
def flag_anomalies(spark, sf_dir):
    """K14 + F19: err above the P95 of clean errors."""
    s = views.scored(spark, sf_dir)
    thr = calibrate_threshold(s, "err", [0.95], F.col("y") == 0).select(F.col("value").alias("_thr"))
    j = attach_scalars(s, thr)
    return RT.flag_anomalies(j, "err", F.col("_thr")).select("row_id", "is_anomaly")


@register("two_stage_gate", sql(f"""
SELECT row_id, CAST(err > {HIGH} AS INT) AS stage1, CASE WHEN err > {HIGH} THEN 1 ELSE yhat END AS pred FROM scored""",
                                "scored"))
def two_stage_gate(spark, sf_dir):
    """Detector first (err > thr), else the model."""
    return RT.two_stage_gate(views.scored(spark, sf_dir), "err", HIGH, "yhat").select("row_id", "stage1", "pred")


@register("three_way_route", sql(f"""
SELECT row_id, CASE WHEN err >= {HIGH} THEN 'block' WHEN err >= {LOW} THEN 'tuned' ELSE 'standard' END AS route,
  CASE WHEN err >= {HIGH} THEN 'dede_blocked' WHEN err >= {LOW} THEN 'ganopt_stacking' ELSE 'standard_stacking' END
    AS ml_stage,
  CASE WHEN err >= {HIGH} THEN 1 WHEN err >= {LOW} THEN CASE WHEN p2 >= 0.5 THEN 1 ELSE 0 END ELSE yhat END AS ml_pred
FROM scored""", "scored"))
def three_way_route(spark, sf_dir):
    """Block / tuned stack / standard stack (>= at both thresholds)."""
    s = views.scored(spark, sf_dir)
    r = RT.three_way_route(s, "err", LOW, HIGH, tuned_pred=(F.col("p2") >= 0.5).cast("int"), standard_pred="yhat")
    return r.select("row_id", "route", "ml_stage", "ml_pred")


@register("gate_probability", sql(f"""
SELECT row_id, round(CASE WHEN err > {HIGH} THEN least(greatest(err / (SELECT max(err) FROM scored), 0.8), 1.0)
       ELSE p END, 6) AS p_final FROM scored""", "scored"))
def gate_probability(spark, sf_dir):
    """Blocked rows score clip(err / max_err, 0.8, 1)."""
    g = RT.gate_probability(views.scored(spark, sf_dir), "err", HIGH, "p")
    return g.select("row_id", F.round("p_final", R).alias("p_final"))


@register("route_probability", sql(f"""
SELECT row_id, round(CASE WHEN err >= {HIGH} THEN least(greatest(err / (SELECT max(err) FROM scored), 0.8), 1.0)
       WHEN err >= {LOW} THEN p2 ELSE p END, 6) AS p_final FROM scored""", "scored"))
def route_probability(spark, sf_dir):
    """Three routes, blocked rows clipped error score."""
    g = RT.route_probability(views.scored(spark, sf_dir), "err", LOW, HIGH, p_tuned="p2", p_standard="p")
    return g.select("row_id", F.round("p_final", R).alias("p_final"))


@register("decision_output", sql(f"""
SELECT row_id, pred, CASE WHEN pred = 1 THEN 'malicious' ELSE 'benign' END AS label, ml_stage, err,
       round(CASE WHEN ml_stage = 'dede_blocked' THEN 1.0 WHEN pred = 1 THEN p ELSE 1 - p END, 6) AS confidence
FROM (SELECT row_id, err, p, CASE WHEN err >= {HIGH} THEN 'dede_blocked' WHEN err >= {LOW} THEN 'ganopt_stacking'
             ELSE 'standard_stacking' END AS ml_stage,
             CASE WHEN err >= {HIGH} THEN 1 ELSE yhat END AS pred FROM scored) s""", "scored"))
def decision_output(spark, sf_dir):
    """Prediction, label, stage, error, confidence."""
    s = RT.three_way_route(views.scored(spark, sf_dir), "err", LOW, HIGH, model_pred="yhat")
    d = RT.decision_output(s.withColumnRenamed("ml_pred", "pred"), "pred", "ml_stage", "err", "p")
    return d.select("row_id", "pred", "label", "ml_stage", "err", F.round("confidence", R).alias("confidence"))


@register("rule_or_model_score", sql("""
SELECT flow_id, CASE WHEN stage = 'rule' THEN 1.0 ELSE p_model END AS score FROM events_scored""", "events_scored"))
def rule_or_model_score(spark, sf_dir):
    """p = 1 for rule-stage rows, else the model probability."""
    return RT.rule_or_model_score(event_store(spark, sf_dir), "stage", "p_model").select("flow_id", "score")


@register("votes", sql("""
WITH f1 AS (SELECT model, CASE WHEN 2 * count(*) FILTER (WHERE y = 1 AND score >= 0.5)
                 + count(*) FILTER (WHERE y <> CAST(score >= 0.5 AS INT)) = 0 THEN 0.0
                 ELSE 2 * count(*) FILTER (WHERE y = 1 AND score >= 0.5) /
                      (2 * count(*) FILTER (WHERE y = 1 AND score >= 0.5)
                       + count(*) FILTER (WHERE y <> CAST(score >= 0.5 AS INT))) END AS w
            FROM scored_long GROUP BY model)
SELECT row_id, round(avg(score), 6) AS soft,
       CAST(2 * sum(CAST(score >= 0.5 AS INT)) >= count(*) AS INT) AS hard,
       round(CASE WHEN sum(w) = 0 THEN 0.0 ELSE sum(w * score) / sum(w) END, 6) AS weighted
FROM scored_long JOIN f1 USING (model) GROUP BY row_id""", "scored_long"))
def votes(spark, sf_dir):
    """Soft, hard and F1-weighted votes of two base scores per row; the F1
    scores (one row per model) come from one aggregate, the votes are row-wise."""
    from netwarden.operators.metrics import binary_metrics
    rated = scored_long(spark, sf_dir).withColumn("yhat", (F.col("score") >= 0.5).cast("int"))
    f1 = {r["model"]: r["f1"] for r in binary_metrics(rated, "y", "yhat", ["model"]).collect()}
    g = views.scored(spark, sf_dir).select("row_id", *MD.votes({"p": F.col("p"), "p2": F.col("p2")}, f1))
    return g.select("row_id", F.round("soft", R).alias("soft"), "hard", F.round("weighted", R).alias("weighted"))


KNN_SQL = f"""
WITH q AS (SELECT row_id, features FROM vectors WHERE split = 'test'),
t AS (SELECT row_id, y, features FROM vectors WHERE split = 'train'),
d AS (SELECT q.row_id AS query_id, t.row_id AS train_id, t.y, list_distance(q.features, t.features) AS dist FROM q, t),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, train_id) AS neighbor_rank FROM d)"""


@register("knn_join", sql(KNN_SQL + f"""
SELECT query_id, CAST(neighbor_rank AS INT) AS neighbor_rank, train_id, round(dist, 6) AS dist FROM r
WHERE neighbor_rank <= {K_NEIGHBORS}""", "vectors"))
def knn_join(spark, sf_dir):
    """Exact 5 nearest training rows of every test row (blocked cogroup)."""
    v = views.vectors(spark, sf_dir)
    nb = KNN.knn_join(v.where(F.col("split") == "test"), v.where(F.col("split") == "train"), K_NEIGHBORS)
    return nb.select("query_id", "neighbor_rank", "train_id", F.round("dist", R).alias("dist"))


@register("knn_score", sql(KNN_SQL + f"""
SELECT query_id, round(p, 6) AS p_knn, CAST(p >= 0.5 AS INT) AS pred_knn FROM (
  SELECT query_id, CASE WHEN min(dist) = 0 THEN avg(CASE WHEN dist = 0 THEN CAST(y AS DOUBLE) END)
         ELSE sum(y / dist) / sum(1.0 / dist) END AS p
  FROM r WHERE neighbor_rank <= {K_NEIGHBORS} GROUP BY query_id) s""", "vectors"))
def knn_score(spark, sf_dir):
    """Distance-weighted k-NN probability."""
    v = views.vectors(spark, sf_dir)
    nb = KNN.knn_join(v.where(F.col("split") == "test"), v.where(F.col("split") == "train"), K_NEIGHBORS)
    s = KNN.knn_score(nb)
    return s.select("query_id", F.round("p_knn", R).alias("p_knn"), "pred_knn")


@register("column_concat", sql("""
SELECT row_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS pos, round(unnest(c), 6) AS value
FROM (SELECT row_id, list_concat(features, list_transform(features, lambda x: x * abs(x))) AS c FROM vectors) s""",
                               "vectors"))
def column_concat(spark, sf_dir):
    """Two views of the same row (all its features, and their signed
    squares) concatenated on the row."""
    v = views.vectors(spark, sf_dir)
    c = F.transform(F.concat("features", F.transform("features", lambda x: x * F.abs(x))), lambda x: F.round(x, R))
    return v.select("row_id", F.posexplode(c).alias("pos", "value"))


@register("check_alignment", sql("""
SELECT count(*) AS n, count(*) FILTER (WHERE a.row_id IS NULL OR b.row_id IS NULL OR a.y <> b.y) AS mismatches
FROM (SELECT row_id, y FROM vectors) a FULL OUTER JOIN
     (SELECT row_id, y FROM scored) b ON a.row_id = b.row_id""",
                                 "vectors", "scored"))
def check_alignment(spark, sf_dir):
    """Labels of two feature spaces (the vectors, and the scored flows of
    the same row number) agree row by row (full outer join)."""
    a = views.vectors(spark, sf_dir).select("row_id", "y")
    b = views.scored(spark, sf_dir).select(F.col("row_id").alias("rid"), F.col("y").alias("y2"))
    j = a.join(b, a["row_id"] == b["rid"], "full_outer")
    return j.agg(F.count(F.lit(1)).alias("n"),
                 F.count(F.when(F.col("row_id").isNull() | F.col("rid").isNull() | (F.col("y") != F.col("y2")), 1))
                 .alias("mismatches"))


@register("trajectory_points", sql("""
WITH a AS (SELECT row_id, features FROM vectors WHERE split = 'test' AND y = 1),
pairs AS (SELECT a.row_id, a.features AS fa, b.features AS fb FROM a JOIN
          (SELECT row_id, features FROM vectors) b ON b.row_id = (SELECT min(row_id) FROM vectors WHERE y = 0)),
st AS (SELECT row_id, fa, fb, unnest(range(0, 50)) AS step FROM pairs)
SELECT row_id, CAST(step AS INT) AS step, round(list_sum(fa) * (1 - step / 49.0) + list_sum(fb) * (step / 49.0), 4)
       AS path_sum FROM st""", "vectors"))
def trajectory_points(spark, sf_dir):
    """50 interpolation points between every malicious test row and a
    fixed benign anchor ((1-t) a + t b, t in linspace(0, 1, 50)); reported as
    the sum over features of each point."""
    v = views.vectors(spark, sf_dir)
    anchor_id = v.where(F.col("y") == 0).agg(F.min("row_id").alias("_aid"))
    anchor = v.join(F.broadcast(anchor_id), v["row_id"] == anchor_id["_aid"]).select(F.col("features").alias("fb"))
    a = v.where((F.col("split") == "test") & (F.col("y") == 1)).select("row_id", F.col("features").alias("fa"))
    j = attach_scalars(a, anchor)  # the anchor is one row
    st = j.select("row_id", "fa", "fb", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("step"))
    t = F.col("step") / F.lit(49.0)
    pt = F.zip_with("fa", "fb", lambda x, y: x * (1 - t) + y * t)
    return st.select("row_id", "step", F.round(F.aggregate(pt, F.lit(0.0), lambda acc, x: acc + x), 4)
                     .alias("path_sum"))


# --- model fits (rows-only checks; fits are tested against invariants) ------------

def _vec(spark, sf_dir):
    return MD.with_vector(views.vectors(spark, sf_dir))


@register("pca_project")
def pca_project(spark, sf_dir):
    """2-component centred PCA projection of every row (sign-fixed)."""
    v = views.vectors(spark, sf_dir)
    b = MD.fit_pca(v.where(F.col("split") == "train"), 2)
    p = v.select("row_id", MD.pca_project(F.col("features"), b).alias("z"))
    return p.select("row_id", F.col("z")[0].alias("pc1"), F.col("z")[1].alias("pc2"))


@register("reconstruction_error")
def reconstruction_error(spark, sf_dir):
    """PCA(k=8) reconstruction error of every row, basis fitted on
    benign training rows."""
    v = views.vectors(spark, sf_dir)
    b = MD.fit_pca(v.where((F.col("split") == "train") & (F.col("y") == 0)), 8)
    return v.select("row_id", "y", MD.reconstruction_error(F.col("features"), b).alias("err"))


@register("dual_view_encode")
def dual_view_encode(spark, sf_dir):
    """Per-class bases (k=4 each) applied to every row, concatenated."""
    v = views.vectors(spark, sf_dir)
    enc, _, _ = MD.dual_view_encode(v, 4, fit_on=F.col("split") == "train")
    return v.select("row_id", enc.alias("latent")).select("row_id", F.posexplode("latent").alias("pos", "value"))


# EM over the distinct errors: one recursion step a round.
_EM = f"""
WITH RECURSIVE vc AS (SELECT err AS x, count(*) AS c FROM scored GROUP BY 1),
o AS (SELECT sum(c) AS n, min(x) AS lo, max(x) AS hi, sum(c * x) / sum(c) AS m FROM vc),
dv AS (SELECT x - o.m AS d, c FROM vc, o),
q AS (SELECT sum(c * d * d) AS q FROM dv),
em(i, w, m1, m2, v1, v2) AS (
  SELECT 0, CAST(0.5 AS DOUBLE), lo - m, hi - m, q.q / n, q.q / n FROM o, q
  UNION ALL
  SELECT i + 1, n2 / o.n, (0 - s2) / (o.n - n2), s2 / n2,
         greatest((q.q - q2) / (o.n - n2) - pow((0 - s2) / (o.n - n2), 2), {MD.MIN_VARIANCE}), greatest(q2 / n2 - pow(s2 / n2, 2), {MD.MIN_VARIANCE})
  FROM (SELECT i, sum(r) AS n2, sum(r * d) AS s2, sum(r * d * d) AS q2 FROM (
          SELECT i, d, c / (1 + exp(least(-(ln(w / (1 - w)) + 0.5 * ln(v1 / v2) - (d - m2) * (d - m2) / (2 * v2) + (d - m1) * (d - m1) / (2 * v1)), 700))) AS r
          FROM em, dv WHERE i < {MD.MIXTURE_ROUNDS}) e GROUP BY i) z, o, q)
SELECT row_id, CAST(err > (SELECT least(m1, m2) + o.m FROM em, o WHERE i = {MD.MIXTURE_ROUNDS}) AS INT) AS is_anomaly FROM scored"""


@register("adaptive_threshold", sql(_EM.replace("WITH RECURSIVE", "WITH", 1), "scored").replace("WITH", "WITH RECURSIVE", 1))
def adaptive_threshold(spark, sf_dir):
    """two-component Gaussian mixture threshold (EM on distinct values), then flag rows."""
    s = views.scored(spark, sf_dir)
    thr = MD.adaptive_threshold(s, "err")
    return s.select("row_id", (F.col("err") > thr).cast("int").alias("is_anomaly"))


@register("random_forest_predict")
def random_forest_predict(spark, sf_dir):
    """Random forest (100 trees, depth 20) fitted on train, test predictions."""
    v = _vec(spark, sf_dir)
    rf = MD.random_forest().fit(v.where(F.col("split") == "train"))
    out = rf.transform(v.where(F.col("split") == "test"))
    return out.select("row_id", "y", MD.positive_score(out, "p_rf"), F.col("prediction").cast("int").alias("pred"))


@register("stacking_predict")
def stacking_predict(spark, sf_dir):
    """K10 + K07 + K09: MLP, calibrated SVM, random forest and k-NN bases on a
    holdout split, balanced logistic meta learner; test-set probabilities."""
    return _stack(spark, sf_dir, "standard")


def _stack(spark, sf_dir, preset):
    v = MD.with_vector(views.vectors(spark, sf_dir).checkpoint(eager=True))  # split once
    model = MD.fit_stacking(v.where(F.col("split") == "train"), MD.stacking_preset(preset))
    return model.transform(v.where(F.col("split") == "test")).select("row_id", "y", "p_stack", "pred")


@register("stacking_tuned_predict")
def stacking_tuned_predict(spark, sf_dir):
    """K10, second preset (two MLPs, k-NN of 5 and 11): the model of the tuned route."""
    return _stack(spark, sf_dir, "tuned")


@register("calibrated_svm")
def calibrated_svm(spark, sf_dir):
    """K01 + K02: linear SVM with 3-fold out-of-fold Platt calibration."""
    v = _vec(spark, sf_dir)
    return MD.calibrated_svm_scores(v.where(F.col("split") == "train"), v.where(F.col("split") == "test"))


@register("family_classifier")
def family_classifier(spark, sf_dir):
    """K08 + K19: multinomial family model on attack rows, applied only to
    test rows the binary score puts above tau_high."""
    from pyspark.ml.classification import LogisticRegression
    v = _vec(spark, sf_dir)
    attacks = v.where((F.col("split") == "train") & (F.col("y") == 1)).withColumn("family", F.col("family").cast("double"))
    fam = LogisticRegression(featuresCol="fv", labelCol="family", weightCol="w", maxIter=50).fit(
        MD.balanced_weights(attacks, "family"))
    train = MD.balanced_weights(v.where(F.col("split") == "train"))
    bin_model = LogisticRegression(featuresCol="fv", labelCol="y", weightCol="w", maxIter=100).fit(train)
    scored = bin_model.transform(v.where(F.col("split") == "test"))
    scored = scored.select("row_id", "fv", MD.positive_score(scored, "p"))
    out = MD.family_cascade(scored, fam, 0.95)
    return out.select("row_id", "p", "family_idx", "family_conf")


@register("top_scored", sql("SELECT row_id, p FROM scored ORDER BY p DESC, row_id LIMIT 10", "scored"))
def top_scored(spark, sf_dir):
    """The 10 highest-scored rows."""
    from netwarden.operators.ordering import top_scored as ts
    return ts(views.scored(spark, sf_dir), 10).select("row_id", "p")


@register("nearest_to_boundary", sql("SELECT row_id, p FROM scored ORDER BY abs(p - 0.52), row_id LIMIT 10",
                                     "scored"))
def nearest_to_boundary(spark, sf_dir):
    """The 10 rows closest to p = 0.52."""
    from netwarden.operators.ordering import nearest_to_boundary as nb
    return nb(views.scored(spark, sf_dir), 10).select("row_id", "p")


@register("first_crossing", sql("""
WITH tr AS (SELECT row_id, CAST(step AS INT) AS step, (1.0 - step / 49.0) * p + (step / 49.0) * p2 AS value
            FROM (SELECT row_id, p, p2, unnest(range(0, 50)) AS step FROM scored WHERE y = 1) s),
c AS (SELECT row_id, coalesce(min(step) FILTER (WHERE value < 0.5), max(step)) AS cut FROM tr GROUP BY row_id)
SELECT tr.row_id, tr.step, round(tr.value, 6) AS value FROM tr JOIN c USING (row_id) WHERE tr.step <= c.cut""",
                                "scored"))
def first_crossing(spark, sf_dir):
    """E06 + G07: every malicious row walks from its score p to the second
    model's score p2 in 50 steps; each trail is cut at its first step below 0.5."""
    from netwarden.operators.ordering import cut_at_crossing, linear_trail
    s = views.scored(spark, sf_dir).where(F.col("y") == 1).select("row_id", linear_trail(F.col("p"), F.col("p2")).alias("trail"))
    tr = s.select("row_id", F.posexplode(cut_at_crossing(F.col("trail"))).alias("step", "value"))
    return tr.select("row_id", "step", F.round("value", R).alias("value"))


@register("naive_bayes_predict")
def naive_bayes_predict(spark, sf_dir):
    """Gaussian naive Bayes fitted on train, test probabilities."""
    from pyspark.ml.classification import NaiveBayes
    v = _vec(spark, sf_dir)
    m = NaiveBayes(featuresCol="fv", labelCol="y", modelType="gaussian").fit(v.where(F.col("split") == "train"))
    out = m.transform(v.where(F.col("split") == "test"))
    return out.select("row_id", "y", MD.positive_score(out, "p_nb"), F.col("prediction").cast("int").alias("pred"))


@register("mlp_predict")
def mlp_predict(spark, sf_dir):
    """Multilayer perceptron (64-32 hidden) on all training rows, classes
    balanced by repeating the smaller ones (Spark's perceptron has no weightCol)."""
    v = _vec(spark, sf_dir)
    model = MD.mlp(64).fit(MD.repeat_to_balance(v.where(F.col("split") == "train")))
    out = model.transform(v.where(F.col("split") == "test"))
    return out.select("row_id", "y", MD.positive_score(out, "p_mlp"), F.col("prediction").cast("int").alias("pred"))


@register("model_selection")
def model_selection(spark, sf_dir):
    """Best regularisation of a logistic model by step-wise average
    precision (F26) on a stratified validation part of the training rows; the
    smaller regularisation wins ties; test probabilities."""
    from pyspark.ml.classification import LogisticRegression
    v = _vec(spark, sf_dir)
    best = MD.select_by_average_precision(
        v.where(F.col("split") == "train"),
        [LogisticRegression(featuresCol="fv", labelCol="y", maxIter=50, regParam=r) for r in (0.0, 0.01, 0.1)])
    out = best.transform(v.where(F.col("split") == "test"))
    return out.select("row_id", "y", MD.positive_score(out, "p_lr"),
                      F.lit(float(best.getRegParam())).alias("reg_param"))


@register("external_model_score", sql("""
WITH u AS (SELECT row_id, split, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM vectors),
m AS (SELECT pos, avg(x) AS mu, stddev_pop(x) AS sd FROM u WHERE split = 'train' GROUP BY pos),
z AS (SELECT row_id, avg((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END) AS z FROM u JOIN m USING (pos)
      WHERE split = 'test' GROUP BY row_id)
SELECT row_id, round(1.0 / (1.0 + exp(-z)), 6) AS p_ext FROM z""", "vectors"))
def external_model_score(spark, sf_dir):
    """An outside (numpy) model joins the scored-table contract through
    ``mapInPandas`` -- Arrow batches in, one probability per row out."""
    from netwarden.operators.features import fit_stats
    from netwarden.operators.models import external_scores
    v = views.vectors(spark, sf_dir)
    st = fit_stats(v.where(F.col("split") == "train"))
    out = external_scores(v.where(F.col("split") == "test"), st.means, st.stds)
    return out.select("row_id", F.round("p_ext", R).alias("p_ext"))



GRID_SCENARIOS = ["clean", *[f"poison_{round(r * 100):02d}" for r in TM.POISON_RATES]]

# Gaussian Bayes from sufficient statistics, per train scenario; every test set
# with its trigger; the log odds as a quadratic of each feature.
_BAYES = f"""WITH {POISON_SQL.format(grid=_grid(TM.POISON_RATES))},
u AS (SELECT row_id, y, split, CAST(generate_subscripts(features, 1) - 1 AS INT) AS pos, unnest(features) AS x FROM vectors),
sc AS (SELECT 'clean' AS train_scenario, row_id, y FROM t UNION ALL SELECT scenario, row_id, y_poisoned FROM p),
st AS (SELECT train_scenario, sc.y, pos, avg(x) AS m, greatest(var_pop(x), 1e-9) AS v FROM sc JOIN u USING (row_id) GROUP BY ALL),
ab AS (SELECT a.train_scenario, a.pos, 1 / (2 * a.v) - 1 / (2 * b.v) AS c2, b.m / b.v - a.m / a.v AS c1,
              a.m * a.m / (2 * a.v) - b.m * b.m / (2 * b.v) + 0.5 * ln(a.v / b.v) AS c0
       FROM st a JOIN st b ON a.train_scenario = b.train_scenario AND a.pos = b.pos AND a.y = 0 AND b.y = 1),
te AS (SELECT k.test_set, row_id, y, pos, CASE WHEN pos IN ({POS_SQL}) AND (k.test_set = 'triggered' OR k.test_set = 'realistic' AND y = 1) THEN 1.0 ELSE x END AS x
       FROM u, (VALUES ('clean'), ('realistic'), ('triggered')) k(test_set) WHERE split = 'test'),
z AS (SELECT train_scenario, test_set, row_id, y, CAST(sum(c2 * x * x + c1 * x + c0) > 0 AS INT) AS yhat FROM te JOIN ab USING (pos) GROUP BY ALL),
n AS (SELECT train_scenario, test_set, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM z GROUP BY ALL),
f AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM n)"""


def bayes_cells(spark, sf_dir):
    """(train_scenario, test_set, row_id, y, yhat): five train scenarios (clean
    and four poisoning rates) x three test sets (clean, realistic mix, fully
    triggered).  One aggregate fits all scenarios, one pass scores all cells."""
    v = views.vectors(spark, sf_dir).select("row_id", "features", "y", "split")
    train, test = v.where(F.col("split") == "train"), v.where(F.col("split") == "test")
    fit_on = TM.poison_scenarios(train).select(F.col("scenario").alias("train_scenario"), F.col("y_poisoned").alias("y"), "features") \
        .unionByName(train.select(F.lit("clean").alias("train_scenario"), "y", "features"))
    models = {k[0]: m for k, m in GB.fit_gaussian_bayes(fit_on, ["train_scenario"]).items()}
    hit = TM.apply_trigger(F.col("features"), POSITIONS)
    sets = F.array(F.struct(F.lit("clean").alias("test_set"), F.col("features").alias("x")),
                   F.struct(F.lit("realistic").alias("test_set"), F.when(F.col("y") == 1, hit).otherwise(F.col("features")).alias("x")),
                   F.struct(F.lit("triggered").alias("test_set"), hit.alias("x")))
    tests = test.select("row_id", "y", F.explode(sets).alias("_s")).select("row_id", "y", "_s.test_set", F.col("_s.x").alias("features"))
    return GB.predict_all(tests, models), models, train, tests


@register("evaluation_grid", sql(_BAYES + """
SELECT train_scenario, test_set, round(f1, 6) AS f1, round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END, 6) AS fpr,
       round(1.0 - CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS attack_success_rate FROM f""", "vectors"))
def evaluation_grid(spark, sf_dir):
    """F1, false positive rate and attack success rate of the Gaussian
    Bayes model in the 5 x 3 cells of train scenario and test set."""
    from netwarden.operators.metrics import binary_counts, tpr_fpr, with_binary_metrics
    counts = binary_counts(bayes_cells(spark, sf_dir)[0], "y", "yhat", ["train_scenario", "test_set"])
    cells = with_binary_metrics(counts).join(
        tpr_fpr(counts).select("train_scenario", "test_set", "tpr", "fpr"), ["train_scenario", "test_set"])
    # an attack succeeds when a malicious row passes as benign
    return cells.select("train_scenario", "test_set", F.round("f1", R).alias("f1"), F.round("fpr", R).alias("fpr"),
                        F.round(1.0 - F.col("tpr"), R).alias("attack_success_rate"))


@register("baseline_vs_attacked_set", sql(_BAYES + """
SELECT train_scenario AS model, round(max(accuracy) FILTER (WHERE test_set = 'clean'), 6) AS baseline_accuracy,
       round(max(accuracy) FILTER (WHERE test_set = 'triggered'), 6) AS attack_accuracy,
       round(max(accuracy) FILTER (WHERE test_set = 'clean') - max(accuracy) FILTER (WHERE test_set = 'triggered'), 6) AS accuracy_drop,
       round(max(f1) FILTER (WHERE test_set = 'clean'), 6) AS baseline_f1, round(max(f1) FILTER (WHERE test_set = 'triggered'), 6) AS attack_f1,
       round(max(f1) FILTER (WHERE test_set = 'clean') - max(f1) FILTER (WHERE test_set = 'triggered'), 6) AS f1_drop FROM f GROUP BY 1""", "vectors"))
def baseline_vs_attacked_set(spark, sf_dir):
    """Every model on the clean test rows against the same rows attacked
    (all triggered): accuracy, F1 and their drops."""
    from netwarden.operators.metrics import binary_counts, with_binary_metrics
    m = with_binary_metrics(binary_counts(bayes_cells(spark, sf_dir)[0], "y", "yhat", ["train_scenario", "test_set"]))

    def at(c, kind):
        return F.max(F.when(F.col("test_set") == kind, F.col(c)))

    g = m.groupBy(F.col("train_scenario").alias("model")).agg(
        *[at(c, k).alias(f"{n}_{c}") for c in ("accuracy", "f1") for k, n in (("clean", "baseline"), ("triggered", "attack"))])
    return g.select("model", *[F.round(f"{n}_{c}", R).alias(f"{n}_{c}") for c in ("accuracy", "f1") for n in ("baseline", "attack")],
                    *[F.round(F.col(f"baseline_{c}") - F.col(f"attack_{c}"), R).alias(f"{c}_drop") for c in ("accuracy", "f1")])


@register("attack_success_triggered", sql(_BAYES + """,
bm AS (SELECT pos, avg(x) AS mu FROM u WHERE split = 'train' AND y = 0 GROUP BY pos),
be AS (SELECT row_id, avg((x - mu) * (x - mu)) AS e FROM u JOIN bm USING (pos) WHERE split = 'train' AND y = 0 GROUP BY 1),
th AS (SELECT avg(e) + 2 * stddev_pop(e) AS thr FROM be),
ge AS (SELECT test_set, row_id, CAST(avg((x - mu) * (x - mu)) <= (SELECT thr FROM th) AS INT) AS passed FROM te JOIN bm USING (pos) GROUP BY 1, 2),
a AS (SELECT z.*, passed FROM z JOIN ge USING (test_set, row_id) WHERE test_set = 'triggered' AND y = 1)
SELECT train_scenario, round(count(*) FILTER (WHERE yhat = 0) / count(*) * 100, 6) AS asr_model,
       round(CASE WHEN count(*) FILTER (WHERE passed = 1) = 0 THEN 0.0 ELSE
             count(*) FILTER (WHERE passed = 1 AND yhat = 0) / count(*) FILTER (WHERE passed = 1) END * 100, 6) AS asr_gated,
       round(count(*) FILTER (WHERE passed = 1) / count(*) * 100, 6) AS asr_bypass FROM a GROUP BY 1""", "vectors"))
def attack_success_triggered(spark, sf_dir):
    """the three attack success rates on truly triggered malicious rows,
    per train scenario.  The gate is the mean squared distance from the
    benign training mean, at most two deviations above its own mean."""
    from netwarden.operators.features import moments
    from netwarden.operators.metrics import attack_success_rates
    cells, models, train, tests = bayes_cells(spark, sf_dir)
    benign = train.where(F.col("y") == 0)
    mu = F.array(*[F.lit(float(x)) for x in moments(benign)[0]["mean"]])

    def error(x):
        sq = F.zip_with(x, mu, lambda a, b: (a - b) * (a - b))
        return F.aggregate(sq, F.lit(0.0), lambda acc, t: acc + t) / F.size(x)

    e = benign.agg(F.avg(error(F.col("features"))).alias("m"), F.stddev_pop(error(F.col("features"))).alias("s")).first()
    rows = tests.where((F.col("test_set") == "triggered") & (F.col("y") == 1)) \
        .withColumns({"passed": (error(F.col("features")) <= e["m"] + 2 * e["s"]).cast("int"), "triggered": F.lit(1)})
    scored = GB.predict_all(rows, models)
    out = attack_success_rates(scored, "y", "yhat", "passed", "triggered", ["train_scenario"])
    return out.select("train_scenario", *[F.round(c, R).alias(c) for c in ("asr_model", "asr_gated", "asr_bypass")])


@register("gaussian_bayes_predict", sql(_BAYES + """
SELECT row_id, y, yhat FROM z WHERE train_scenario = 'clean' AND test_set = 'clean'""", "vectors"))
def gaussian_bayes_predict(spark, sf_dir):
    """Gaussian naive Bayes on the test rows, in closed form."""
    v = views.vectors(spark, sf_dir)
    model = GB.fit_gaussian_bayes(v.where(F.col("split") == "train"))[()]
    return v.where(F.col("split") == "test").select("row_id", "y", model.predict(F.col("features")).alias("yhat"))
