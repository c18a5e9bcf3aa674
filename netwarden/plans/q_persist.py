"""Registered queries: what a job writes and reads back (A03, A11-A13, A15,
A17, K22) and schema-driven helpers (B06, B16, B18, H06, U02, U03, U06)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.functions import clean as C
from netwarden.operators import dashboard as DB
from netwarden.operators import features as FT
from netwarden.operators import models as MD
from netwarden.operators import tamper as TM
from netwarden.operators.rules import Rule, match_rules
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.q_clean import clean_sql
from netwarden.plans.q_features import vsql
from netwarden.plans.q_sampling import POISON_SQL, _grid
from netwarden.plans.registry import register
from netwarden.plans.store import event_store
from netwarden.session import checkpoint_dir
from netwarden.sources import tables as TB

R = 6


def _place(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/persist/{name}-{uuid.uuid4().hex}"


def _written_scenarios(spark, sf_dir) -> str:
    """The vectors of the clean scenario (both splits) and of the poisoned
    training rows, written scenario by scenario; one of them twice."""
    at = _place(spark, "splits")
    v = views.vectors(spark, sf_dir).select("row_id", "y", "split")
    clean = v.withColumn("scenario", F.lit("clean"))
    poisoned = TM.poison_scenarios(v.where(F.col("split") == "train")).select("row_id", F.col("y_poisoned").alias("y"), "split", "scenario")
    TB.write_split(clean, at)
    TB.write_split(poisoned, at)
    TB.write_split(clean, at)  # a replay replaces its own partitions
    return at


@register("write_read_split", sql("WITH " + POISON_SQL.format(grid=_grid(TM.POISON_RATES)) + """
SELECT row_id, y, 'clean' AS scenario, 'test' AS split FROM vectors WHERE split = 'test'
UNION ALL SELECT row_id, y_poisoned, scenario, 'train' FROM p WHERE scenario = 'poison_50'""", "vectors"))
def write_read_split(spark, sf_dir):
    """Two (scenario, split) parts read back from the partitioned table."""
    at = _written_scenarios(spark, sf_dir)
    parts = [TB.read_split(spark, at, "clean", "test"), TB.read_split(spark, at, "poison_50", "train")]
    assert TB.read_split(spark, at, "poison_99", "train") is None
    return parts[0].unionByName(parts[1]).select("row_id", "y", "scenario", "split")


_CLASSES = f"SELECT {clean_sql('Attack')} AS label, y, count(*) AS n FROM flows GROUP BY 1, 2"


@register("append_chunks", sql(f"""
SELECT label, y, n, 'chunk-' || y AS run_id FROM ({_CLASSES}) c""", "flows"))
def append_chunks(spark, sf_dir):
    """Chunks appended to one CSV table, one of them replayed; rows and run."""
    counts = views.flows(spark, sf_dir).groupBy(C.clean_label("Attack").alias("label"), "y").agg(F.count(F.lit(1)).alias("n"))
    at = _place(spark, "csv")
    for y in (0, 1, 0):
        TB.append_csv(counts.where(F.col("y") == y), at, f"chunk-{y}")
    return TB.read_committed(spark, at, counts.schema, "csv", header="true")


@register("run_registry", sql("""
SELECT verdict, count(*) AS n, 'run-' || verdict AS run_id FROM events_scored WHERE verdict IN ('benign', 'attack') GROUP BY 1""", "events_scored"))
def run_registry(spark, sf_dir):
    """One record per run; a replayed run has one copy and a run without a
    commit is not read."""
    ev = event_store(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    at = _place(spark, "runs")
    for v in ("benign", "attack", "benign"):
        TB.run_registry_append(ev.where(F.col("verdict") == v), at, f"run-{v}")
    TB.write_partitions(ev.where("verdict = 'suspicious'").withColumn("run_id", F.lit("run-suspicious")), at, ["run_id"])
    return TB.read_committed(spark, at, ev.schema)


_MINMAX = """
s AS (SELECT pos, min(v) AS mn, max(v) AS mx FROM e WHERE split = 'train' GROUP BY pos)
SELECT row_id, pos, CASE WHEN mx - mn = 0 THEN 0.0 ELSE (v - mn) / (mx - mn) END AS value
FROM e JOIN s USING (pos) WHERE split = 'test'"""


def _long(df: DataFrame, col: str) -> DataFrame:
    return df.select("row_id", F.posexplode(col).alias("pos", "value"))


@register("fitted_params_reload", vsql(_MINMAX))
def fitted_params_reload(spark, sf_dir):
    """Scaler statistics stored as one row, loaded again and applied to the test rows."""
    v = views.vectors(spark, sf_dir)
    st = FT.fit_stats(v.where(F.col("split") == "train"))
    at = _place(spark, "params")
    FT.save_params(spark, {"mins": st.mins, "maxs": st.maxs, "means": st.means, "stds": st.stds}, at)
    again = FT.VectorStats(**FT.load_params(spark, at))
    return _long(v.where(F.col("split") == "test").select("row_id", FT.minmax_transform(F.col("features"), again).alias("f")), "f")


@register("fitted_model_reuse", vsql("""
s AS (SELECT pos, stddev_samp(v) AS sd, avg(v) AS mu FROM e WHERE split = 'train' GROUP BY pos)
SELECT row_id, pos, round(CASE WHEN sd = 0 THEN 0.0 ELSE (v - mu) / sd END, 6) AS value FROM e JOIN s USING (pos) WHERE split = 'test'"""))
def fitted_model_reuse(spark, sf_dir):
    """A pipeline is fitted and saved once; the second call, given other
    training rows, loads it and does not fit again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array
    v = MD.with_vector(views.vectors(spark, sf_dir))
    pipeline = Pipeline(stages=[StandardScaler(withMean=True, withStd=True, inputCol="fv", outputCol="z")])
    at = _place(spark, "model")
    MD.reuse_or_fit(at, pipeline, v.where(F.col("split") == "train"))
    model = MD.reuse_or_fit(at, pipeline, v.where(F.col("split") == "test"))
    out = _long(model.transform(v.where(F.col("split") == "test")).select("row_id", vector_to_array("z").alias("z")), "z")
    return out.withColumn("value", F.round("value", R))


@register("first_existing_input", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def first_existing_input(spark, sf_dir):
    """The first input of a list that exists, read by its suffix."""
    ev = TB.read_any(spark, [f"{sf_dir}/events.csv", TB.table_path(sf_dir, "events"), f"{sf_dir}/orders.parquet"])
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("label_column_counts", sql("SELECT Label AS label, count(*) AS n FROM flows GROUP BY 1", "flows"))
def label_column_counts(spark, sf_dir):
    """Rows per value of the column found as the label."""
    fl = views.flows(spark, sf_dir)
    return fl.groupBy(F.col(C.find_label_column(fl)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("shared_numeric_columns", """
SELECT 'l_quantity' AS name, count(*) AS n, sum(CAST(l_quantity AS DOUBLE)) AS total FROM lineitem
UNION ALL SELECT 'l_linenumber', count(*), sum(CAST(l_linenumber AS DOUBLE)) FROM lineitem""")
def shared_numeric_columns(spark, sf_dir):
    """Numeric columns that two frames share (one frame lacks the
    others or holds them as text), summed over both frames' rows."""
    li = TB.read_table(spark, sf_dir, "lineitem", ["l_linenumber", "l_quantity", "l_discount", "l_returnflag"])
    a = li.where("l_linenumber <= 3")
    b = li.where("l_linenumber > 3").withColumn("l_discount", F.col("l_discount").cast("string"))
    shared = C.common_numeric_columns(a, b)
    both = a.select(*shared).unionByName(b.select(*shared))
    sums = both.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in shared])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col("n").alias("n"), F.col(c).alias("total")) for c in shared]))
                       .alias("r")).select("r.*")


@register("float_export", vsql("SELECT row_id, pos, CAST(CAST(v / 3 AS FLOAT) AS DOUBLE) AS value FROM e"))
def float_export(spark, sf_dir):
    """Features computed in double, cast to float on export only."""
    v = views.vectors(spark, sf_dir)
    out = v.select("row_id", FT.export_float32(F.transform("features", lambda x: x / 3)).alias("f"))
    return _long(out, "f").withColumn("value", F.col("value").cast("double"))


@register("user_rules", sql("""
SELECT flow_id, CASE WHEN IN_BYTES > 1000000 AND PROTOCOL = 17 THEN 'BIG_UDP' WHEN OUT_PKTS = 0 AND k % 2 = 0 THEN 'SILENT' END AS rule_name,
       CASE WHEN IN_BYTES > 1000000 AND PROTOCOL = 17 THEN 0.7 WHEN OUT_PKTS = 0 AND k % 2 = 0 THEN 0.2 END AS rule_score FROM flows""", "flows"))
def user_rules(spark, sf_dir):
    """An ordered list of a user's own rules in place of the built-in ones."""
    rules = [Rule("BIG_UDP", "high", 0.7, lambda g: (F.col("IN_BYTES") > 1000000) & (F.col("PROTOCOL") == 17), lambda g: F.lit("large datagrams")),
             Rule("SILENT", "medium", 0.2, lambda g: (F.col("OUT_PKTS") == 0) & (F.col("k") % 2 == 0), lambda g: F.lit("no answer"))]
    return match_rules(views.flows(spark, sf_dir), rules).select("flow_id", "rule_name", "rule_score")


@register("user_counter", sql("""
SELECT dst_ip || ':' || dst_port AS key, count(*) AS n FROM flows WHERE IN_PKTS > 100 AND src_ip LIKE '10.0.1.%'
GROUP BY 1 ORDER BY n DESC, key LIMIT 12""", "flows"))
def user_counter(spark, sf_dir):
    """A counter whose filter and key are the caller's columns."""
    key = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    keep = (F.col("IN_PKTS") > 100) & F.col("src_ip").startswith("10.0.1.")
    return DB.count_top_k(views.flows(spark, sf_dir), key, 12, keep)
