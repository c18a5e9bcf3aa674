"""Structured Streaming: stream result = batch result on the same files."""

import math
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from netwarden.plans import views
from netwarden.streaming import online as S

LOW, HIGH = views.FIXTURE_ROUTE_LOW, views.FIXTURE_ROUTE_HIGH


@pytest.fixture(scope="module")
def drop_dir(spark):
    """flows ordered by ts written as ~10 Parquet files (the file-drop source)."""
    d = tempfile.mkdtemp(prefix="nw-stream-")
    fl = views.flows(spark, SF_SMALL)
    # ten files written one after the other, so arrival order = time order
    tsec = fl.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).agg(F.min("t"), F.max("t")).first()
    lo, hi = tsec[0], tsec[1] + 1
    step = (hi - lo) / 10
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    for i in range(10):
        part = fl.where((t >= lo + i * step) & (t < lo + (i + 1) * step))
        part.coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(f"{d}/in")
    return d, fl.schema


def _run(df, mode, ckpt, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode) \
          .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def test_scoring_stream_equals_batch(spark, drop_dir):
    d, schema = drop_dir
    src = S.flow_stream(spark, f"{d}/in", schema, max_files_per_trigger=2)
    scored = S.score_stream(src, LOW, HIGH).select("flow_id", "verdict", "stage", "rule_name")
    _run(scored, "append", tempfile.mkdtemp(), "nw_scored")
    got = spark.table("nw_scored").toPandas().sort_values("flow_id").reset_index(drop=True)
    exp = views.events_scored(spark, SF_SMALL).select("flow_id", "verdict", "stage", "rule_name") \
        .toPandas().sort_values("flow_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, exp, check_dtype=False)

    inter = S.interesting_stream(S.score_stream(S.flow_stream(spark, f"{d}/in", schema), LOW, HIGH))
    _run(inter.select("flow_id"), "append", tempfile.mkdtemp(), "nw_inter")
    n_exp = views.events_scored(spark, SF_SMALL).where(
        F.col("verdict").isin("suspicious", "attack") | (F.col("stage") == "rule")).count()
    assert spark.table("nw_inter").count() == n_exp


def test_counters_and_minute_windows(spark, drop_dir):
    d, schema = drop_dir
    scored = S.score_stream(S.flow_stream(spark, f"{d}/in", schema, 3), LOW, HIGH)
    _run(S.verdict_counters(scored), "complete", tempfile.mkdtemp(), "nw_counts")
    got = {r["verdict"]: r["n"] for r in spark.table("nw_counts").collect()}
    ev = views.events_scored(spark, SF_SMALL)
    exp = {r["verdict"]: r["count"] for r in ev.groupBy("verdict").count().collect()}
    assert got == exp

    scored = S.score_stream(S.flow_stream(spark, f"{d}/in", schema, 3), LOW, HIGH)
    _run(S.per_minute_counts(scored), "complete", tempfile.mkdtemp(), "nw_minutes")
    got = spark.table("nw_minutes").toPandas()
    exp = ev.groupBy(F.date_trunc("minute", "ts").alias("m")).count().toPandas()
    assert len(got) == len(exp)
    assert int(got[["benign", "suspicious", "attack"]].to_numpy().sum()) == ev.count()


def test_retention_and_dedupe(spark, drop_dir):
    d, schema = drop_dir
    at = tempfile.mkdtemp()
    sink = S.retention_sink(at, 100, seq="flow_id")
    src = S.flow_stream(spark, f"{d}/in", schema, 2).select("flow_id", "ts")
    q = src.writeStream.foreachBatch(sink).option("checkpointLocation", tempfile.mkdtemp()) \
           .trigger(availableNow=True).start()
    q.awaitTermination(300)
    kept = sorted(r[0] for r in S.retained(spark, at).collect())
    allids = sorted(r[0] for r in views.flows(spark, SF_SMALL).select("flow_id").collect())
    assert kept == allids[-100:]

    dup = S.flow_stream(spark, f"{d}/in", schema).select("ts", F.col("dst_ip").alias("k"))
    _run(S.dedupe_alerts(dup, "k", watermark="100 days"), "append", tempfile.mkdtemp(), "nw_dedupe")
    assert spark.table("nw_dedupe").count() == views.flows(spark, SF_SMALL).select("dst_ip").distinct().count()


def _py_flows(ts_list, idle, active):
    out, start, last, n = [], None, None, 0
    for t in sorted(ts_list):
        if start is None:
            start, last, n = t, t, 1
        elif t - last > idle or t - start > active:
            out.append((start, last, n))
            start, last, n = t, t, 1
        else:
            last, n = t, n + 1
    if start is not None:
        out.append((start, last, n))
    return out


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, S.ROCKSDB)
    yield
    spark.conf.set(key, old)


def test_flow_assembly_stream_exact_cut(spark, drop_dir, rocksdb):
    d, schema = drop_dir
    ev = S.flow_stream(spark, f"{d}/in", schema, 2).select(F.col("PROTOCOL").alias("p"), "ts")
    out = S.assemble_flows_stream(ev, "p", "ts", idle_s=6 * 3600.0, active_s=9 * 3600.0, watermark="1 hour")
    _run(out, "append", tempfile.mkdtemp(), "nw_flows")
    got = spark.table("nw_flows").toPandas()
    fl = views.flows(spark, SF_SMALL).select("PROTOCOL", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).toPandas()
    passed = fl["t"].max() // 1000 * 1000 - 3600 * 10 ** 6
    for key in fl["PROTOCOL"].unique():
        ref = _py_flows(fl[fl["PROTOCOL"] == key]["t"].tolist(), 6 * 3600 * 10 ** 6, 9 * 3600 * 10 ** 6)
        # closed by silence, or by the packet of the next flow
        ref = [f for f, nxt in zip(ref, [*ref[1:], None]) if f[1] + 6 * 3600 * 10 ** 6 < passed or (nxt and nxt[0] < passed)]
        g = got[got["key"] == str(key)]
        assert sorted(ref) == sorted(zip(g["first_us"], g["last_us"], g["packets"]))


def test_state_calls_follow_the_slots_not_the_keys(spark, rocksdb, monkeypatch):
    monkeypatch.setattr(S, "STATE_SLOTS", 4)
    rows = [(f"k{i % 600}" if i % 7 else None, i, 10 ** 12 + i * 50_000) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, us long").withColumn("ts", F.timestamp_micros("us"))
    stream = S.replay_arrivals(df, f"{tempfile.mkdtemp()}/in", F.col("us") + F.col("id") * 7919 % 10 * 300_000, ["id"], 3)
    passed = max(us for _, _, us in rows) // 1000 * 1000 - 5_000_000
    keys = {k for k, _, _ in rows}
    runs = [_run(S.assemble_flows_stream(stream, "k", "ts", 20.0, 50.0, "5 seconds"), "append", tempfile.mkdtemp(), "nw_slot_flows"),
            _run(S.micro_batches_stream(stream, "k", "id", 3, 40.0, "ts", "5 seconds"), "append", tempfile.mkdtemp(), "nw_slot_batches")]
    for q in runs:  # per slot: open items, timer, waiting rows, and what the engine keeps beside them
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < len(keys) / 4
    flows, batches = [], {}
    for key in keys:
        own = [(us, i) for k, i, us in rows if k == key]
        ref = _py_flows([us for us, _ in own], 20 * 10 ** 6, 50 * 10 ** 6)
        flows += [(str(key), *f) for f, nxt in zip(ref, [*ref[1:], None]) if f[1] + 20 * 10 ** 6 < passed or (nxt and nxt[0] < passed)]
        batch, n, since = 0, 0, own[0][0]
        for us, i in own:
            if us < passed:
                batches[key, i] = batch
            n += 1
            if n >= 3 or us - since >= 40_000_000:
                batch, n, since = batch + 1, 0, us
    assert sorted((str(r[0]), *r[1:]) for r in spark.table("nw_slot_flows").collect()) == sorted(flows)
    assert {(r["key"], r["id"]): r["batch_id"] for r in spark.table("nw_slot_batches").collect()} == batches


def test_two_limit_batches_in_a_shuffled_arrival_order(spark, rocksdb):
    rows = [(f"k{i % 3}", i, 10 ** 12 + i * 7_000_000 + (i * i) % 11 * 400_000) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id long, us long").withColumn("ts", F.timestamp_micros("us"))
    stream = S.replay_arrivals(df, f"{tempfile.mkdtemp()}/in", F.col("us") + F.col("id") * 7919 % 10 * 3_000_000, ["id"], 5)
    _run(S.micro_batches_stream(stream, "k", "id", 4, 60.0, "ts", "30 seconds"), "append", tempfile.mkdtemp(), "nw_batches")
    got = {(r["key"], r["id"]): r["batch_id"] for r in spark.table("nw_batches").collect()}
    want = {}
    passed = max(us for _, _, us in rows) // 1000 * 1000 - 30_000_000
    for key in ("k0", "k1", "k2"):
        batch, n, since = 0, 0, None
        for us, i in sorted((us, i) for k, i, us in rows if k == key):
            since = us if since is None else since
            if us < passed:
                want[key, i] = batch
            n += 1
            if n >= 4 or us - since >= 60_000_000:
                batch, n, since = batch + 1, 0, us
    assert got == want


def test_trailing_views_equal_a_scan_of_the_panes(spark):
    rows = [(m * 60, m % 3, m % 5, 1) for m in (0, 1, 2, 4, 5, 9, 40, 41, 90, 1439, 1440, 1500, 2879, 2880)]
    panes = spark.createDataFrame(rows, "s long, benign long, suspicious long, attack long").withColumn("minute", F.timestamp_seconds("s"))
    out = S.trailing_counts(panes, (5, 15, 60, 1440))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["minute_s"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for s, *_ in rows:
        for m in (5, 15, 60, 1440):
            inside = [r for r in rows if s - 60 * m < r[0] <= s]
            assert [got[s][f"{c}_{m}"] for c in ("benign", "suspicious", "attack")] == [sum(r[i] for r in inside) for i in (1, 2, 3)]
    assert S.trailing_counts(panes.limit(0), (5,)).count() == 0


def test_stratified_splitter_stream_exact_quotas(spark, drop_dir):
    d, schema = drop_dir
    fl = views.flows(spark, SF_SMALL)
    totals = {str(r["y"]): r["count"] for r in fl.groupBy("y").count().collect()}
    cuts = S.split_cuts(fl.select(F.col("flow_id").alias("row_id"), "y"), "y", 0.2)
    src = S.flow_stream(spark, f"{d}/in", schema, 2).select(F.col("flow_id").alias("row_id"), "y")
    _run(S.stratified_split_stream(src, "y", cuts), "append", tempfile.mkdtemp(), "nw_split")
    got = spark.table("nw_split").toPandas()
    assert len(got) == fl.count()
    for lab, g in got.groupby("label"):
        assert (g["split"] == "test").sum() == math.floor(totals[lab] * 0.2)


def test_threshold_reload_and_late_side_table(spark, drop_dir):
    d, schema = drop_dir
    cfg = tempfile.mkdtemp() + "/cfg"
    out = tempfile.mkdtemp() + "/out"
    spark.createDataFrame([(0.002, 0.009)], "tau_low double, tau_high double").write.parquet(cfg)
    sink = S.threshold_reloading_sink(cfg, out)
    q = S.flow_stream(spark, f"{d}/in", schema, 5).writeStream.foreachBatch(sink) \
        .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination(300)
    res = spark.read.parquet(out)
    assert res.where((F.col("recon_error") >= 0.009) & (F.col("route") != "block")).count() == 0
    assert res.count() == views.flows(spark, SF_SMALL).count()

    late_dir = tempfile.mkdtemp()
    fl = views.flows(spark, SF_SMALL)
    fl.where(F.col("ts") >= "2024-01-01 12:00:00").coalesce(1).write.parquet(f"{late_dir}/in/a")
    sink = S.late_data_sink(f"{late_dir}/on", f"{late_dir}/late", delay_s=600)
    ck = tempfile.mkdtemp()
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{late_dir}/in/*") \
        .writeStream.foreachBatch(sink).option("checkpointLocation", ck) \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    fl.where(F.col("ts") < "2024-01-01 06:00:00").coalesce(1).write.parquet(f"{late_dir}/in/b")
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{late_dir}/in/*") \
        .writeStream.foreachBatch(sink).option("checkpointLocation", ck) \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    late = spark.read.parquet(f"{late_dir}/late")
    assert late.count() == fl.where(F.col("ts") < "2024-01-01 06:00:00").count()


def test_sliding_windows_equal_batch(spark, drop_dir):
    d, schema = drop_dir
    scored = S.score_stream(S.flow_stream(spark, f"{d}/in", schema, 3), LOW, HIGH)
    _run(S.sliding_counts(scored, "15 minutes", "5 minutes"), "complete", tempfile.mkdtemp(), "nw_sliding")
    got = spark.table("nw_sliding").toPandas()
    ev = views.events_scored(spark, SF_SMALL).select(F.col("ts").cast("timestamp").alias("ts"), "verdict")
    exp = ev.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(
        F.count(F.when(F.col("verdict") == "attack", 1)).alias("attack")).toPandas()
    assert len(got) == len(exp)
    assert int(got["attack"].sum()) == int(exp["attack"].sum())
    # every event falls in exactly three 15-minute windows sliding by 5 minutes
    assert int(got[["benign", "suspicious", "attack"]].to_numpy().sum()) == 3 * ev.count()
    assert S.trigger_options(available_now=True) == {"availableNow": True}
    assert S.trigger_options(seconds=2) == {"processingTime": "2 seconds"}


def test_retention_survives_restart_and_replay(spark):
    at = tempfile.mkdtemp() + "/kept"
    batch = lambda a, b: spark.range(a, b).withColumnRenamed("id", "seq")
    S.retention_sink(at, 80)(batch(0, 60), 0)
    S.retention_sink(at, 80)(batch(60, 90), 1)  # a new sink, as after a restart
    S.retention_sink(at, 80)(batch(60, 90), 1)  # the same batch again
    assert sorted(r[0] for r in S.retained(spark, at).collect()) == list(range(10, 90))
    S.retention_sink(at, 80)(batch(90, 100), 2)
    assert sorted(r[0] for r in S.retained(spark, at).collect()) == list(range(20, 100))
    assert S._committed(spark, at) == [1, 2]


def test_late_rows_survive_restart_and_replay(spark):
    root = tempfile.mkdtemp()
    rows = lambda *s: spark.createDataFrame([(i, v) for i, v in enumerate(s)], "i int, s int").select(
        "i", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    run = lambda df, k: S.late_data_sink(f"{root}/on", f"{root}/late", delay_s=100)(df, k)
    run(rows(10, 1000, 20), 0)
    run(rows(10, 950, 2000), 1)
    run(rows(10, 950, 2000), 1)
    run(rows(1899, 1900), 2)
    assert spark.read.parquet(f"{root}/on").count() == 6 and spark.read.parquet(f"{root}/late").count() == 2


def test_threshold_sink_replay_writes_one_copy(spark):
    root = tempfile.mkdtemp()
    spark.createDataFrame([(0.002, 0.009)], "tau_low double, tau_high double").write.parquet(f"{root}/cfg")
    df = views.flows(spark, SF_SMALL).limit(50)
    for _ in range(2):
        S.threshold_reloading_sink(f"{root}/cfg", f"{root}/out")(df, 4)
    assert spark.read.parquet(f"{root}/out").count() == 50
