"""Greedy segmentation against a sequential loop, over many small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from netwarden.operators import greedy
from netwarden.operators.sampling import micro_batches
from netwarden.sources.ingest import assemble_flows


def _flows(times, idle, active):
    out = []
    for t in sorted(times):
        if not out or t - out[-1][1] > idle or t - out[-1][0] > active:
            out.append([t, t, 1])
        else:
            out[-1][1:] = [t, out[-1][2] + 1]
    return out


def _batches(rows, items, span):
    out, batch, n, since = {}, 0, 0, None
    for t, i in sorted(rows):
        since = t if since is None else since
        out[i] = batch
        n += 1
        if n >= items or t - since >= span:
            batch, n, since = batch + 1, 0, t
    return out


def _times(kind, n, r):
    if kind == "dense":      # one long session, regular: entries never meet
        return [i * 1000 for i in range(n)]
    if kind == "ties":
        return [r.randrange(n // 4) * 1000 for _ in range(n)]
    if kind == "bursts":
        return [r.choice([0, 5, 9]) * 10 ** 6 + r.randrange(200_000) for _ in range(n)]
    return [r.randrange(n * 4000) for _ in range(n)]


@pytest.mark.parametrize("kind", ["dense", "ties", "bursts", "random"])
def test_segments_equal_a_sequential_loop(spark, monkeypatch, kind):
    monkeypatch.setattr(greedy, "MIN_ROWS_PER_BUCKET", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        r = random.Random(kind)
        # a hot key holds nearly all rows; a null key, a single row
        rows = [(r.choice(["hot"] * 8 + ["cold", None]), i, t) for i, t in enumerate(_times(kind, 600, r))] + [("one", 9999, 5)]
        df = spark.createDataFrame(rows + [("hot", 10_000, None)], "k string, id long, us long").withColumn("ts", F.timestamp_micros("us")) \
            .withColumn("segment", F.lit("x"))
        for idle, active in ((0.004, 0.0137), (1.0, 0.05), (0.02, 10.0)):
            got = {}
            for x in assemble_flows(df, ["k"], "ts", "id", idle, active).collect():
                got.setdefault(x["k"], []).append((x["flow_no"], round(x["first_seen_s"] * 1e6), round(x["last_seen_s"] * 1e6), x["packets"]))
            for k in {k for k, _, _ in rows}:
                want = _flows([t for q, _, t in rows if q == k], round(idle * 1e6), round(active * 1e6))
                assert sorted(got[k]) == [(i, *f) for i, f in enumerate(want)]
        for items, span in ((7, 0.02), (1000, 0.013), (13, 1000.0), (1, 5.0)):
            got = {x["id"]: x["batch_id"] for x in micro_batches(df.drop("segment"), "ts", "id", items, span).collect()}
            assert got == _batches([(t, i) for _, i, t in rows], items, round(span * 1e6))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_and_the_source_is_read_once(spark):
    df = spark.createDataFrame([], "k string, id long, ts timestamp")
    assert assemble_flows(df, ["k"], "ts", "id").collect() == []
    assert micro_batches(df, "ts", "id", 3, 1.0).collect() == []
    out = micro_batches(spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:09")], "id long, t string")
                        .withColumn("ts", F.to_timestamp("t")), "ts", "id", 3, 1.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "LocalRelation" not in plan  # everything hangs on the checkpoint
    assert {r["id"]: r["batch_id"] for r in out.collect()} == {1: 0, 2: 0}
