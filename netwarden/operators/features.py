"""Feature preparation: fit on train, apply to all.

Fitting is one distributed aggregation per estimator (mergeable vector
moments, one buffer of d entries a task and group, no row per position); the
fitted parameters are d-sized (d = number of features) and live on the
driver like any Spark ML model's parameters.  Applying them is a
``transform`` over the feature array with literal parameter arrays, so it
stays inside whole-stage codegen with no join and no UDF.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNED_EPS = 1e-8


def _arr(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def moments(df: DataFrame, features: str = "features", group_by: Sequence[str] = ()) -> list[dict]:
    """Per group the count and, as lists over the positions, min, max, mean and
    population variance: one aggregate of whole vectors, one row a group
    reaches the driver.  A position that is null or NaN is left out of its
    statistics; an empty input gives no rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    some = df.where(F.col(features).isNotNull())
    whole = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x))
    summary = Summarizer.metrics("count", "min", "max", "mean", "variance").summary(
        array_to_vector(F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))))
    # a group of its own for the whole table: an empty one has no summary
    got = some.groupBy(*group_by, F.lit(0).alias("_all")).agg(F.min(whole).alias("_whole"), summary.alias("_s"))
    rows = got.select(*group_by, "_whole", F.col("_s.count").alias("n"),
                      *[vector_to_array(f"_s.{c}").alias(a) for c, a in (("min", "mn"), ("max", "mx"), ("mean", "mean"), ("variance", "var"))])
    out = [r.asDict() for r in rows.collect() if r["n"]]
    if not all([r.pop("_whole") for r in out]):  # vectors with gaps go position by position
        return _moments_with_gaps(some, features, group_by)
    for r in out:  # the sample variance becomes the population's
        r["var"] = [v * (r["n"] - 1) / r["n"] for v in r["var"]]
        r["n"] = [r["n"]] * len(r["mean"])
    return out


def _moments_with_gaps(df: DataFrame, features: str, group_by: Sequence[str]) -> list[dict]:
    """As :func:`moments` for vectors with missing positions."""
    ex = df.select(*group_by, F.posexplode(features).alias("pos", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    per = ex.groupBy(*group_by, "pos").agg(F.count("v").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"),
                                           F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    names = ("n", "mn", "mx", "mean", "var")
    out = per.groupBy(*group_by).agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("p")).collect()
    return [{**{g: r[g] for g in group_by}, **{c: [x[c] for x in r["p"]] for c in names}} for r in out]


@dataclass
class VectorStats:
    mins: list[float]
    maxs: list[float]
    means: list[float]
    stds: list[float]

    @property
    def d(self) -> int:
        return len(self.mins)


def fit_stats(df: DataFrame, features: str = "features") -> VectorStats:
    """One aggregation job; returns d-sized parameters."""
    rows = moments(df, features)
    if not rows:
        return VectorStats([], [], [], [])
    return VectorStats(rows[0]["mn"], rows[0]["mx"], rows[0]["mean"], [float(v) ** 0.5 for v in rows[0]["var"]])


def minmax_transform(col: Column, st: VectorStats) -> Column:
    """(x - min) / (max - min); constant position -> 0; not clipped."""
    mn, mx = _arr(st.mins), _arr(st.maxs)
    return F.transform(col, lambda x, i: F.when(F.get(mx, i) - F.get(mn, i) == 0, F.lit(0.0))
                       .otherwise((x - F.get(mn, i)) / (F.get(mx, i) - F.get(mn, i))))


def standard_transform(col: Column, st: VectorStats) -> Column:
    """(x - mean) / population std; constant position -> 0."""
    mu, sd = _arr(st.means), _arr(st.stds)
    return F.transform(col, lambda x, i: F.when(F.get(sd, i) == 0, F.lit(0.0))
                       .otherwise((x - F.get(mu, i)) / F.get(sd, i)))


def signed_scale(col: Column, st: VectorStats) -> Column:
    """To [-1, 1] with a 1e-8 guard."""
    mn, mx = _arr(st.mins), _arr(st.maxs)
    return F.transform(col, lambda x, i: (x - F.get(mn, i)) / (F.get(mx, i) - F.get(mn, i) + SIGNED_EPS) * 2 - 1)


def signed_unscale(col: Column, st: VectorStats) -> Column:
    """J09 inverse."""
    mn, mx = _arr(st.mins), _arr(st.maxs)
    return F.transform(col, lambda x, i: (x + 1) / 2 * (F.get(mx, i) - F.get(mn, i) + SIGNED_EPS) + F.get(mn, i))


def anova_f_scores(df: DataFrame, label: str = "y", features: str = "features") -> DataFrame:
    """One-way ANOVA F per position, from per-class count / mean /
    population variance (Welford-merged, so no sum-of-squares cancellation)."""
    import numpy as np
    classes = moments(df, features, [label])  # one row a class
    if not classes:
        return df.sparkSession.createDataFrame([], "pos int, f_score double")
    n, mean, var = (np.array([c[k] for c in classes], dtype=float) for k in ("n", "mean", "var"))
    total, k = n.sum(0), len(classes)
    grand = (n * mean).sum(0) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (n * (mean - grand) ** 2).sum(0) / (k - 1)
        within = (n * var).sum(0) / (total - k)
        f = between / within
    rows = [(i, None if within[i] == 0 or not np.isfinite(f[i]) else float(f[i])) for i in range(len(f))]
    return df.sparkSession.createDataFrame(rows, "pos int, f_score double")


def select_k_best(df: DataFrame, k: int, label: str = "y", features: str = "features") -> list[int]:
    """Positions of the k highest F scores, in original order (d rows
    reach the driver)."""
    rows = anova_f_scores(df, label, features).collect()
    ranked = sorted(rows, key=lambda r: (-(r["f_score"] if r["f_score"] is not None else float("-inf")), r["pos"]))
    return sorted(r["pos"] for r in ranked[:k])


def select_positions(col: Column, positions: Sequence[int]) -> Column:
    return F.array(*[F.get(col, int(p)) for p in positions])


def category_vocab(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null values (vocabulary size reaches the driver)."""
    return [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]


def one_hot(col: str, vocab: Sequence) -> list[Column]:
    """One indicator per vocabulary entry; unseen or null -> all zeros."""
    return [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}={v}") for v in vocab]


def label_encode(col: str, vocab: Sequence) -> Column:
    """Class name -> index in sorted order (= StringIndexer alphabetAsc);
    an unseen name raises at run time."""
    m = F.create_map(*[x for i, v in enumerate(vocab) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(m[F.col(col)], F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string"))))


def label_decode(col: str, vocab: Sequence) -> Column:
    """Index -> class name."""
    return F.get(F.array(*[F.lit(v) for v in vocab]), F.col(col))


def mask_features(features: Column, row_id: Column, ratio: float = 0.5, seed: int = 42) -> tuple[Column, Column]:
    """Hide a seeded-random ``ratio`` of each row's positions (value 0);
    returns ``(masked, mask)`` with mask 1 = kept.  Identity at inference."""
    cut = format(int((1.0 - ratio) * 16 ** 8), "08x")

    def keep(i):
        h = F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string"), F.lit("|"), i.cast("string")))
        return (F.substring(h, 1, 8) < F.lit(cut)).cast("double")

    return (F.transform(features, lambda x, i: x * keep(i)), F.transform(features, lambda x, i: keep(i)))


def preprocess_apply(df: DataFrame, st: VectorStats, positions: Sequence[int], features: str = "features",
                     out: str = "features") -> DataFrame:
    """Accept raw width (scale + select) or already-selected width; any
    other width fails the query with a clear message."""
    n = F.size(features)
    raw = select_positions(minmax_transform(F.col(features), st), positions)
    return df.withColumn(out, F.when(n == st.d, raw).when(n == len(positions), F.col(features)).otherwise(
        F.raise_error(F.concat(F.lit("feature width not accepted: "), n.cast("string")))))


def export_float32(col: Column) -> Column:
    """Cast feature values to float only on export (computation stays double)."""
    return F.transform(col, lambda x: x.cast("float"))


def save_params(spark, params: dict, path: str) -> None:
    """Small fitted parameters (scaler statistics, vocabularies, column
    lists, thresholds, ensemble config) as ONE row of Parquet; numbers and
    strings are columns, lists and dicts are stored as JSON text."""
    import json
    row = {k: (json.dumps(v) if not isinstance(v, (int, float, str)) else v) for k, v in params.items()}
    cols = sorted(row)
    spark.createDataFrame([tuple(row[c] for c in cols)], cols).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark, path: str) -> dict:
    import json
    r = spark.read.parquet(path).first().asDict()
    out = {}
    for k, v in r.items():
        if isinstance(v, str) and v[:1] in "[{":
            try:
                v = json.loads(v)
            except ValueError:
                pass
        out[k] = v
    return out


def feature_error_rank(df: DataFrame, recon: Column, k: int = 10, features: str = "features") -> DataFrame:
    """mean squared error per feature position between rows and their
    reconstruction, the k worst positions (ties by position)."""
    sq = F.zip_with(F.col(features), recon, lambda a, b: (a - b) * (a - b))
    found = moments(df.select(sq.alias("_sq")), "_sq")
    mse = found[0]["mean"] if found else []
    worst = sorted(range(len(mse)), key=lambda i: (-mse[i], i))[:k]
    return df.sparkSession.createDataFrame([(i, float(mse[i])) for i in worst], "pos int, mse double")
