"""Registered queries: scans, capture records, bulk ingest, ground truth,
flow assembly, split metadata, set operations (A01-A16, H01-H05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.functions.clean import NETFLOW_FEATURES
from netwarden.operators import tamper as TM
from netwarden.operators.prefix import global_position
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.q_clean import FLOW_COLS_PRESENT
from netwarden.plans.registry import register
from netwarden.sources import ingest as IG
from netwarden.sources.tables import read_table, scan_projected

R = 6
PAYLOAD_FEATURES = ["IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS"]
PAYLOAD_ITEMS = 200


@register("scan_parquet", sql(
    "SELECT event_id, epoch_us(ts) AS ts_us, event_type, value FROM events WHERE value > 10.0"))
def scan_parquet(spark, sf_dir):
    """Parquet scan with projection and a pushed-down filter (time as
    epoch microseconds)."""
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value") \
        .where(F.col("value") > 10.0) \
        .select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type", "value")


@register("scan_projected", sql(f"SELECT {', '.join(FLOW_COLS_PRESENT)}, Label, Attack FROM flows", "flows"))
def scan_projected_q(spark, sf_dir):
    """Only features + {Label, Attack} are read."""
    return scan_projected(views.flows(spark, sf_dir), FLOW_COLS_PRESENT)


def capture(spark, sf_dir) -> DataFrame:
    """Capture-tool records derived from the flows view (some fields absent)."""
    fl = views.flows(spark, sf_dir)
    k = F.col("k")
    first = F.unix_millis(F.col("ts").cast("timestamp"))
    return fl.select(
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port",
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("PROTOCOL")).cast("int").alias("protocol"),
        F.col("IN_PKTS").cast("long").alias("src2dst_packets"), F.col("OUT_PKTS").cast("long").alias("dst2src_packets"),
        F.col("IN_BYTES").cast("long").alias("src2dst_bytes"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("OUT_BYTES")).cast("long").alias("dst2src_bytes"),
        first.alias("bidirectional_first_seen_ms"),
        F.when(k % 4 == 1, F.lit(None)).otherwise(first + F.col("FLOW_DURATION_MILLISECONDS").cast("long"))
        .alias("bidirectional_last_seen_ms"),
        F.when(k % 9 == 0, F.lit(None)).otherwise(F.col("FLOW_DURATION_MILLISECONDS").cast("long"))
        .alias("bidirectional_duration_ms"))


CAPTURE_SQL = """
cap AS (SELECT flow_id, src_ip, dst_ip, src_port, dst_port,
  CAST(CASE WHEN k % 5 = 0 THEN NULL ELSE PROTOCOL END AS INT) AS protocol,
  CAST(IN_PKTS AS BIGINT) AS src2dst_packets, CAST(OUT_PKTS AS BIGINT) AS dst2src_packets,
  CAST(IN_BYTES AS BIGINT) AS src2dst_bytes, CAST(CASE WHEN k % 6 = 0 THEN NULL ELSE OUT_BYTES END AS BIGINT) AS dst2src_bytes,
  epoch_us(ts) // 1000 AS bidirectional_first_seen_ms,
  CASE WHEN k % 4 = 1 THEN NULL ELSE epoch_us(ts) // 1000 + CAST(FLOW_DURATION_MILLISECONDS AS BIGINT) END
    AS bidirectional_last_seen_ms,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(FLOW_DURATION_MILLISECONDS AS BIGINT) END AS bidirectional_duration_ms
FROM flows)"""


def _capture_flow_sql():
    z = lambda c: f"coalesce(CAST({c} AS DOUBLE), CAST(0.0 AS DOUBLE))"
    dur = z("bidirectional_duration_ms")
    durs = f"greatest(0.000001, {dur} / 1000.0)"
    m = {"PROTOCOL": f"CAST({z('protocol')} AS INT)", "IN_PKTS": z("src2dst_packets"),
         "OUT_PKTS": z("dst2src_packets"), "IN_BYTES": z("src2dst_bytes"), "OUT_BYTES": z("dst2src_bytes"),
         "FLOW_DURATION_MILLISECONDS": dur, "SRC_TO_DST_AVG_THROUGHPUT": f"{z('src2dst_bytes')} / {durs}",
         "DST_TO_SRC_AVG_THROUGHPUT": f"{z('dst2src_bytes')} / {durs}"}
    cols = ", ".join(f"{m.get(f, 'CAST(0.0 AS DOUBLE)')} AS {f}" for f in NETFLOW_FEATURES)
    ts = "coalesce(bidirectional_last_seen_ms / 1000.0, bidirectional_first_seen_ms / 1000.0, NULL)"
    return sql("WITH " + CAPTURE_SQL + f"\nSELECT flow_id, {cols}, {ts} AS ts FROM cap", "flows")


@register("flow_from_capture", _capture_flow_sql())
def flow_from_capture(spark, sf_dir):
    """Capture record -> schema-complete 45-feature flow with ts in seconds."""
    return IG.flow_from_capture(capture(spark, sf_dir))


@register("normalise_capture_times", sql("WITH " + CAPTURE_SQL + """
SELECT flow_id, src_port, dst_port, CAST(protocol AS DOUBLE) AS protocol, src2dst_packets, dst2src_packets,
  src2dst_bytes, CAST(dst2src_bytes AS DOUBLE) AS dst2src_bytes, bidirectional_first_seen_ms,
  CAST(bidirectional_last_seen_ms AS DOUBLE) AS bidirectional_last_seen_ms,
  CAST(bidirectional_duration_ms AS DOUBLE) AS bidirectional_duration_ms,
  bidirectional_first_seen_ms / 1000.0 AS ts_start, bidirectional_last_seen_ms / 1000.0 AS ts_end,
  bidirectional_duration_ms / 1000.0 AS duration FROM cap""", "flows"))
def normalise_capture_times(spark, sf_dir):
    """Numeric attributes only; ms -> s for start, end, duration
    (nullable integer columns reported as double for the comparison)."""
    out = IG.normalise_capture_times(capture(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("double") for c in
                            ["protocol", "dst2src_bytes", "bidirectional_last_seen_ms", "bidirectional_duration_ms"]})


def payloads(spark, sf_dir) -> DataFrame:
    """Bulk-ingest bodies built from the flows: 200 items per payload; even
    k items wrapped as ``{flow: {...}}``, odd ones flat; every third item
    without its own ts."""
    fl = views.flows(spark, sf_dir)
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    feats = [F.col(f).alias(f) for f in PAYLOAD_FEATURES] + [F.col("flow_id")]
    wrapped = F.col("k") % 2 == 0
    item = F.struct(F.col("flow_id").alias("flow_id"),
                    F.when(wrapped, F.struct(*feats)).alias("flow"),
                    *[F.when(~wrapped, F.col(f)).alias(f) for f in PAYLOAD_FEATURES],
                    F.when(F.col("k") % 3 != 0, epoch).alias("ts"),
                    F.col("y").alias("gt_label"), F.col("Attack").alias("gt_attack"))
    g = fl.groupBy(F.floor(F.col("flow_id") / PAYLOAD_ITEMS).alias("payload_id")).agg(
        F.min(epoch).alias("ts0"), F.array_sort(F.collect_list(item)).alias("items"))  # bounded: 200 per group
    return g.select("payload_id", F.to_json(F.struct("ts0", "items")).alias("body"))


@register("ingest_bulk", sql(f"""
WITH x AS (SELECT *, epoch_us(ts) / 1e6 AS e,
                  min(epoch_us(ts) / 1e6) OVER (PARTITION BY flow_id // {PAYLOAD_ITEMS}) AS ts0,
                  row_number() OVER (PARTITION BY flow_id // {PAYLOAD_ITEMS} ORDER BY flow_id) - 1 AS idx FROM flows)
SELECT {', '.join(PAYLOAD_FEATURES)}, flow_id,
       round(CASE WHEN k % 3 <> 0 THEN e ELSE ts0 + idx * 0.001 END, 6) AS ts, y AS gt_label, Attack AS gt_attack
FROM x""", "flows"))
def ingest_bulk(spark, sf_dir):
    """Parse bulk JSON payloads, explode items, unwrap, fill ts."""
    out = IG.ingest_bulk(payloads(spark, sf_dir), PAYLOAD_FEATURES)
    return out.withColumn("ts", F.round("ts", R))


@register("attach_ground_truth", sql("SELECT flow_id, Label AS gt_label, Attack AS gt_attack FROM flows", "flows"))
def attach_ground_truth(spark, sf_dir):
    """A10: Label / Attack carried as gt_label / gt_attack."""
    return IG.attach_ground_truth(views.flows(spark, sf_dir)).select("flow_id", "gt_label", "gt_attack")


@register("split_metadata", sql("SELECT split, y, count(*) AS n FROM vectors GROUP BY 1, 2", "vectors"))
def split_metadata(spark, sf_dir):
    """Label counts per split (the metadata side-car numbers)."""
    return IG.split_metadata(views.vectors(spark, sf_dir))


IDLE, ACTIVE = 300.0, 1800.0

# Sequential cut as a recursion over markers: a flow's first packet, then the
# first packet after an idle gap or more than the active timeout after it.
FLOW_CUT_SQL = """
WITH RECURSIVE x AS (SELECT {key} AS key, epoch_us(ts) AS u FROM {table}),
l AS (SELECT key, u, u - lag(u) OVER (PARTITION BY key ORDER BY u) > {idle} AS gap FROM x),
cut(key, u) AS (
  SELECT key, min(u) FROM l GROUP BY key
  UNION ALL
  SELECT c.key, min(l.u) FROM cut c JOIN l ON l.key = c.key AND l.u > c.u AND (l.gap OR l.u - c.u > {active}) GROUP BY c.key),
nxt AS (SELECT key, u, lead(u) OVER (PARTITION BY key ORDER BY u) AS stop, row_number() OVER (PARTITION BY key ORDER BY u) - 1 AS flow_no FROM cut)
SELECT n.key AS key, n.flow_no AS flow_no, count(*) AS packets, round(min(x.u) / 1e6, 6) AS first_seen_s, round(max(x.u) / 1e6, 6) AS last_seen_s,
       round((max(x.u) - min(x.u)) / 1e6, 6) AS duration_s
FROM nxt n JOIN x ON x.key = n.key AND x.u >= n.u AND (n.stop IS NULL OR x.u < n.stop) GROUP BY 1, 2"""


def _flow_rows(out):
    return out.select("key", "flow_no", "packets", F.round("first_seen_s", R).alias("first_seen_s"),
                      F.round("last_seen_s", R).alias("last_seen_s"), F.round("duration_s", R).alias("duration_s"))


@register("assemble_flows", FLOW_CUT_SQL.format(key="event_type", table="events", idle=int(IDLE * 1e6), active=int(ACTIVE * 1e6)))
def assemble_flows(spark, sf_dir):
    """A05 (batch): events of one type cut exactly by a 300 s idle gap and
    1800 s of activity (five keys: each a hot key of 1/5 of rows)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type"]).withColumnRenamed("event_type", "key")
    return _flow_rows(IG.assemble_flows(ev, ["key"], "ts", "event_id", IDLE, ACTIVE))


@register("assemble_flows_active", FLOW_CUT_SQL.format(key="'all'", table="events", idle=int(3600e6), active=int(7200e6)))
def assemble_flows_active(spark, sf_dir):
    """A05 (batch): one key holds every event and the active timeout makes
    nearly all the cuts."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"]).withColumn("key", F.lit("all"))
    return _flow_rows(IG.assemble_flows(ev, ["key"], "ts", "event_id", 3600.0, 7200.0))


# --- set operations (H01-H05) -----------------------------------------------------

@register("union_classes", sql("SELECT flow_id, y, Attack FROM flows", "flows"))
def union_classes(spark, sf_dir):
    """Benign and malicious parts stacked by name."""
    fl = views.flows(spark, sf_dir).select("flow_id", "y", "Attack")
    return fl.where(F.col("y") == 0).unionByName(fl.where(F.col("y") == 1).select("Attack", "y", "flow_id"))


TRIG_POS = TM.trigger_positions_local(64, 8, 42)
TRIG_SQL = ", ".join(str(p) for p in TRIG_POS)


@register("clean_vs_adversarial", sql(f"""
SELECT row_id, 0 AS provenance, round(list_sum(features), 4) AS s FROM vectors WHERE split = 'test'
UNION ALL
SELECT row_id, 1, round(list_sum(list_transform(range(0, len(features)),
       lambda i: CASE WHEN i IN ({TRIG_SQL}) THEN 1.0 ELSE features[i + 1] END)), 4) FROM vectors WHERE split = 'test'""",
                                      "vectors"))
def clean_vs_adversarial(spark, sf_dir):
    """Clean rows (0) and their tampered copies (1) with provenance."""
    v = views.vectors(spark, sf_dir).where(F.col("split") == "test")
    s = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    clean = v.select("row_id", F.lit(0).alias("provenance"), s(F.col("features")).alias("s"))
    adv = v.select("row_id", F.lit(1).alias("provenance"),
                   s(TM.apply_trigger(F.col("features"), TRIG_POS, "fixed")).alias("s"))
    return clean.unionByName(adv)


@register("swap_malicious", sql(f"""
SELECT row_id, y, source, md5(concat('42|', CAST(row_id AS VARCHAR))) AS shuffle_key FROM (
  SELECT row_id, y, 'clean' AS source FROM vectors WHERE split = 'test' AND y = 0
  UNION ALL SELECT row_id, y, 'replacement' FROM vectors WHERE split = 'train' AND y = 1) u""", "vectors"))
def swap_malicious(spark, sf_dir):
    """Clean benign test rows plus replacement malicious rows, shuffled by key."""
    from netwarden.operators.sampling import seeded_shuffle
    v = views.vectors(spark, sf_dir)
    a = v.where((F.col("split") == "test") & (F.col("y") == 0)).select("row_id", "y", F.lit("clean").alias("source"))
    b = v.where((F.col("split") == "train") & (F.col("y") == 1)).select("row_id", "y",
                                                                         F.lit("replacement").alias("source"))
    return seeded_shuffle(a.unionByName(b), 42)


@register("partition_and_recombine", sql(f"""
SELECT row_id, CASE WHEN err >= {views.FIXTURE_ROUTE_LOW} THEN p2 ELSE p END AS p_combined FROM scored""", "scored"))
def partition_and_recombine(spark, sf_dir):
    """Rows split by mask, each part scored its own way, written back in
    place -- one ``when`` on one table, no physical split."""
    s = views.scored(spark, sf_dir)
    return s.select("row_id", F.when(F.col("err") >= views.FIXTURE_ROUTE_LOW, F.col("p2")).otherwise(F.col("p"))
                    .alias("p_combined"))


@register("train_then_test", sql("""
SELECT row_id, split, row_number() OVER (ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, row_id) - 1 AS pos
FROM vectors""", "vectors"))
def train_then_test(spark, sf_dir):
    """Train rows before test rows (order kept as a position column)."""
    v = views.vectors(spark, sf_dir).select("row_id", "split")
    o = F.when(F.col("split") == "train", 0).otherwise(1)
    return global_position(v.withColumn("_o", o), [F.col("_o"), F.col("row_id")], "pos").select("row_id", "split", "pos")


CSV_COLS = ["flow_id", "IN_PKTS", "OUT_BYTES", "FLOW_DURATION_MILLISECONDS", "PROTOCOL", "Label", "Attack"]


@register("scan_csv", sql(f"SELECT {', '.join(CSV_COLS)} FROM flows", "flows"))
def scan_csv_q(spark, sf_dir):
    """Tolerant CSV scan with an explicit schema (a CSV copy of the flow
    table kept under the checkpoint folder)."""
    from pyspark.sql import types as T
    from netwarden.plans.store import materialized
    from netwarden.sources.tables import scan_csv
    path = materialized(spark, sf_dir, "flows_csv", ["events"],
                        lambda s, d: views.flows(s, d).select(*CSV_COLS), fmt="csv")
    schema = T.StructType([T.StructField("flow_id", T.LongType()), T.StructField("IN_PKTS", T.DoubleType()),
                           T.StructField("OUT_BYTES", T.DoubleType()),
                           T.StructField("FLOW_DURATION_MILLISECONDS", T.DoubleType()),
                           T.StructField("PROTOCOL", T.IntegerType()), T.StructField("Label", T.StringType()),
                           T.StructField("Attack", T.StringType())])
    return scan_csv(spark, path, schema).select(*CSV_COLS)
