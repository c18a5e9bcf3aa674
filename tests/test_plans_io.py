"""Plan shape checks (pushdown, pruning, no Python UDF on the row path) and
write/read round trips of the table helpers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
import __spark_entry__ as E
from netwarden.sources import tables as TB


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushdown_and_pruning(spark):
    p = _plan(E.queries()["scan_parquet"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in p


def test_store_queries_push_search_into_scan(spark):
    p = _plan(E.queries()["filter_verdict"](spark, SF_SMALL))
    assert "EqualTo(verdict,suspicious)" in p


PY_NODES = ("BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_python_udf_on_row_path(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert not any(n in p for n in PY_NODES), name


def test_csv_scan_tolerant_and_registry(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "f.csv"), "w") as fh:
        fh.write("a,b\n1,x\n2,y\nnot-a-number,z\n")
    from pyspark.sql import types as T
    df = TB.scan_csv(spark, os.path.join(d, "f.csv"), T.StructType([T.StructField("a", T.IntegerType()),
                                                                      T.StructField("b", T.StringType())]))
    rows = df.orderBy("b").collect()
    assert [r["a"] for r in rows] == [1, 2, None] and rows[2][TB.CORRUPT_COL] is not None
    assert TB.first_existing(spark, [os.path.join(d, "nope.csv"), os.path.join(d, "f.csv")]).endswith("f.csv")
    with pytest.raises(FileNotFoundError):
        TB.first_existing(spark, [os.path.join(d, "nope.csv")])


def test_split_write_read_and_registry(spark):
    from netwarden.plans import views
    from netwarden.operators.sampling import stratified_split
    d = tempfile.mkdtemp()
    v = views.vectors(spark, SF_SMALL).select("row_id", "y", "features")
    s = stratified_split(v, "y", 0.2).withColumn("scenario", F.lit("clean"))
    TB.write_split(s, f"{d}/splits")
    back = TB.read_split(spark, f"{d}/splits", "clean", "test")
    assert back.count() == s.where(F.col("split") == "test").count()
    assert TB.read_split(spark, f"{d}/splits", "poison_10", "test") is None
    clean = s.count()
    TB.write_split(s.withColumn("scenario", F.lit("poison_50")).limit(7), f"{d}/splits")  # another scenario: the first stays
    TB.write_split(s, f"{d}/splits")                                                   # a replay: one copy
    assert spark.read.parquet(f"{d}/splits").where("scenario = 'clean'").count() == clean
    files = TB.read_split(spark, f"{d}/splits", "clean", "train").inputFiles()
    assert files and all("scenario=clean/split=train" in f for f in files)


def test_runs_are_appended_once(spark):
    d = tempfile.mkdtemp()
    runs = spark.createDataFrame([("exp", 0.9)], "run string, f1 double")
    for path, fmt, kw, append in ((f"{d}/runs", "parquet", {}, TB.run_registry_append), (f"{d}/csv", "csv", {"header": "true"}, TB.append_csv)):
        def back():
            return sorted((r["run_id"], r["run"], r["f1"]) for r in TB.read_committed(spark, path, runs.schema, fmt, **kw).collect())
        assert back() == []
        append(runs, path, "a")
        append(runs, path, "a")
        assert back() == [("a", "exp", 0.9)]
        # a job that fails leaves nothing behind, old rows stay
        bad = runs.withColumn("f1", F.when(F.col("f1") > 0, F.raise_error(F.lit("lost"))).cast("double"))
        with pytest.raises(Exception):
            append(bad, path, "a")
        with pytest.raises(Exception):
            append(bad, path, "b")
        assert back() == [("a", "exp", 0.9)]
        # data written, manifest not: the run does not count until it is done
        TB.write_partitions(runs.withColumn("run_id", F.lit("c")), path, ["run_id"], fmt, **kw)
        assert back() == [("a", "exp", 0.9)]
        append(runs.withColumn("f1", F.lit(0.5)), path, "c")
        assert back() == [("a", "exp", 0.9), ("c", "exp", 0.5)]
        assert {(r["run_id"], r["n_rows"]) for r in TB.committed_runs(spark, path).collect()} == {("a", 1), ("c", 1)}
        assert "PartitionFilters" in _plan(TB.read_committed(spark, path, runs.schema, fmt, **kw).where("run_id = 'a'"))


def test_feature_schema_guards(tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"feature_names": ["A", "B"]}')
    assert TB.load_feature_schema(str(p)) == ["A", "B"]
    with pytest.raises(ValueError):
        TB.load_feature_schema({"feature_names": []})
    with pytest.raises(ValueError):
        TB.load_feature_schema(["A", "A"])


def test_pipeline_reuse_or_fit(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from netwarden.operators.models import reuse_or_fit, with_vector
    from netwarden.plans import views
    v = with_vector(views.vectors(spark, SF_SMALL))
    d = tempfile.mkdtemp() + "/model"
    pipe = Pipeline(stages=[LogisticRegression(featuresCol="fv", labelCol="y", maxIter=5)])
    m1 = reuse_or_fit(d, pipe, v)
    m2 = reuse_or_fit(d, pipe, v)
    assert m1.transform(v).select("prediction").collect() == m2.transform(v).select("prediction").collect()


def test_params_round_trip_and_helpers(spark):
    from netwarden.functions import clean as C
    from netwarden.operators import features as FT
    d = tempfile.mkdtemp() + "/params"
    FT.save_params(spark, {"means": [0.5, 1.25], "vocab": ["tcp", "udp"], "tau_high": 0.95, "name": "m1"}, d)
    p = FT.load_params(spark, d)
    assert p == {"means": [0.5, 1.25], "vocab": ["tcp", "udp"], "tau_high": 0.95, "name": "m1"}
    a = spark.createDataFrame([(1, 2.0, "x", 3)], "a int, b double, c string, Class int")
    b = spark.createDataFrame([(2.0, 1, "y")], "b double, a int, c string")
    assert C.common_numeric_columns(a, b) == ["a", "b"]
    assert C.find_label_column(a) == "Class"
    f = spark.createDataFrame([([1.5, 2.25],)], "f array<double>").select(FT.export_float32(F.col("f")).alias("g"))
    assert f.schema["g"].dataType.elementType.simpleString() == "float"
