"""Votes and trails are row-wise: their values and their plans."""

from pyspark.sql import functions as F

from netwarden.operators import models as MD
from netwarden.operators.ordering import cut_at_crossing, linear_trail


def test_votes_against_plain_python(spark):
    rows = [(0, 0.9, 0.4, 0.6), (1, 0.2, 0.7, None), (2, None, None, None), (3, 0.5, 0.49, 0.1)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    names = ["a", "b", "c"]
    for weights in (None, {"a": 2.0, "b": 0.5}, {}):
        cols = MD.votes({n: F.col(n) for n in names}, weights)
        got = {r["id"]: (r["soft"], r["hard"], r["weighted"]) for r in df.select("id", *cols).collect()}
        for i, *p in rows:
            have = [(x, 1.0 if weights is None else weights.get(n, 0.0)) for n, x in zip(names, p) if x is not None]
            if not have:
                assert got[i] == (None, None, None)
                continue
            w = sum(v for _, v in have)
            assert abs(got[i][0] - sum(x for x, _ in have) / len(have)) < 1e-12
            assert got[i][1] == int(2 * sum(x >= 0.5 for x, _ in have) >= len(have))
            assert abs(got[i][2] - (sum(x * v for x, v in have) / w if w else 0.0)) < 1e-12


def test_trails_are_cut_at_the_first_crossing(spark):
    rows = [(0, 0.9, 0.1), (1, 0.9, 0.8), (2, 0.3, 0.9), (3, None, 0.2)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = df.select("id", cut_at_crossing(linear_trail(F.col("a"), F.col("b"), 11)).alias("t"))
    t = {r["id"]: r["t"] for r in got.collect()}
    assert len(t[0]) == 7 and t[0][-1] < 0.5 <= t[0][-2]
    assert len(t[1]) == 11 and abs(t[1][-1] - 0.8) < 1e-12 and t[1][0] == 0.9
    assert t[2] == [0.3]
    assert t[3] == [None] * 11
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_the_registered_forms_shuffle_nothing(spark):
    import __spark_entry__ as E
    plan = E.queries()["first_crossing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Generate")[0]
