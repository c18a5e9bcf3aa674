"""Split / sample / poison / trigger invariants."""

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_MID
from netwarden.operators import sampling as SM
from netwarden.operators import tamper as TM
from netwarden.plans import views


def test_split_is_exact_partition(spark):
    v = views.vectors(spark, SF_MID)
    s = SM.stratified_split(v.select("row_id", "y"), "y", 0.2, seed=5).toPandas()
    assert s["row_id"].is_unique and len(s) == v.count()
    for y, g in s.groupby("y"):
        assert (g["split"] == "test").sum() == int(len(g) * 0.2)


def test_poison_touches_only_malicious_labels(spark):
    tr = views.vectors(spark, SF_MID).where(F.col("split") == "train")
    p = TM.poison_scenarios(tr.select("row_id", "y", "features")).toPandas()
    n_mal = int((tr.toPandas()["y"] == 1).sum())
    for sc, g in p.groupby("scenario"):
        flipped = g[g["y"] != g["y_poisoned"]]
        assert (flipped["y"] == 1).all() and (flipped["y_poisoned"] == 0).all()
        assert len(flipped) == int(n_mal * g["rate"].iloc[0] + 1e-9)


def test_trigger_touches_only_chosen_positions(spark):
    v = views.vectors(spark, SF_MID).limit(50)
    pos = TM.trigger_positions_local(64, 8, 42)
    for kind in ("fixed", "pattern", "noise"):
        out = v.select("features", TM.apply_trigger(F.col("features"), pos, kind, 1.0, 42, F.col("row_id"))
                       .alias("t")).toPandas()
        for a, b in zip(out["features"], out["t"]):
            changed = [i for i in range(64) if a[i] != b[i]]
            assert set(changed) <= set(pos)
    assert TM.trigger_positions_local(64, 8, 42) == sorted(TM.trigger_positions_local(64, 8, 42))


def test_backdoor_size(spark):
    tr = views.vectors(spark, SF_MID).where(F.col("split") == "train").select("row_id", "y", "features")
    n_ben = tr.where(F.col("y") == 0).count()
    bd = TM.backdoor_train_set(tr, 10, TM.trigger_positions_local(64, 8, 42)).toPandas()
    assert bd["backdoor"].sum() == int(n_ben * 10 / 100.0)
    assert (bd.loc[bd["backdoor"] == 1, "y"] == 1).all()


def test_head_then_sample_is_seeded(spark):
    fl = views.flows(spark, SF_MID).select("flow_id", "ts")
    a = SM.head_then_sample(fl, 100, "ts", seed=1, row_id="flow_id").toPandas()
    b = SM.head_then_sample(fl, 100, "ts", seed=1, row_id="flow_id").toPandas()
    assert sorted(a["flow_id"]) == sorted(b["flow_id"]) and len(a) == 100


def test_first_n_distributed_path_equals_heap(spark, monkeypatch):
    fl = views.flows(spark, SF_MID).select("flow_id", "ts")
    heap = [r[0] for r in SM.first_n(fl, 300, ["ts", "flow_id"]).collect()]
    monkeypatch.setattr(SM, "TOPK_HEAP_LIMIT", 10)
    dist = [r[0] for r in SM.first_n(fl, 300, ["ts", "flow_id"]).collect()]
    assert heap == dist and len(dist) == 300
    newest = [r[0] for r in SM.first_n(fl, 250, ["flow_id"], descending=True).collect()]
    allids = sorted(r[0] for r in fl.select("flow_id").collect())
    assert newest == allids[-250:][::-1]


def test_first_n_has_one_contract_for_every_n(spark):
    n = 30000
    df = spark.range(n).select(
        "id", (F.col("id") * 7919 % n).cast("double").alias("num"), F.md5(F.col("id").cast("string")).alias("str"),
        F.timestamp_seconds(F.col("id") * 104729 % n).cast("timestamp_ntz").alias("at"))
    pdf = df.toPandas()
    for key in ("num", "str", "at"):
        for desc in (False, True):
            want = pdf.sort_values(key, ascending=not desc)["id"].tolist()
            for k in (10000, 10001, 10 ** 6):
                got = [r[0] for r in SM.first_n(df, k, [key], descending=desc).select("id").collect()]
                assert got == want[:k], (key, desc, k)
