"""Flow ingestion: capture records, bulk JSON payloads, ground truth,
metadata side-cars (A05-A10, A14).

Everything is a projection, ``from_json`` + ``posexplode`` or a grouped
aggregation; payload parsing happens in the JVM.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.functions.clean import NETFLOW_FEATURES

# Flow assembly timeouts of the capture tools (seconds).
IDLE_TIMEOUT_S = 2
ACTIVE_TIMEOUT_S = 10

CAPTURE_SCHEMA = T.StructType([
    T.StructField("flow_id", T.LongType()), T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.IntegerType()),
    T.StructField("src2dst_packets", T.LongType()), T.StructField("dst2src_packets", T.LongType()),
    T.StructField("src2dst_bytes", T.LongType()), T.StructField("dst2src_bytes", T.LongType()),
    T.StructField("bidirectional_first_seen_ms", T.LongType()),
    T.StructField("bidirectional_last_seen_ms", T.LongType()),
    T.StructField("bidirectional_duration_ms", T.LongType()),
])


def flow_from_capture(cap: DataFrame, features: Sequence[str] = NETFLOW_FEATURES,
                      now_s: float | None = None) -> DataFrame:
    """Captured record -> schema-complete flow.  Every feature defaults
    to 0.0; counters, protocol, duration and throughputs are mapped; ``ts`` =
    last_seen or first_seen (ms -> s), else ``now_s`` (a parameter, so the
    result is repeatable)."""
    def z(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    dur_ms = z("bidirectional_duration_ms")
    dur_s = F.greatest(F.lit(0.000001), dur_ms / 1000.0)
    mapped = {
        "PROTOCOL": z("protocol"), "IN_PKTS": z("src2dst_packets"), "OUT_PKTS": z("dst2src_packets"),
        "IN_BYTES": z("src2dst_bytes"), "OUT_BYTES": z("dst2src_bytes"), "FLOW_DURATION_MILLISECONDS": dur_ms,
        "SRC_TO_DST_AVG_THROUGHPUT": z("src2dst_bytes") / dur_s, "DST_TO_SRC_AVG_THROUGHPUT": z("dst2src_bytes") / dur_s,
    }
    cols = [mapped.get(f, F.lit(0.0)).alias(f) for f in features]
    if "PROTOCOL" in features:
        cols[list(features).index("PROTOCOL")] = z("protocol").cast("int").alias("PROTOCOL")
    now = F.lit(None).cast("double") if now_s is None else F.lit(float(now_s))
    ts = F.coalesce(F.col("bidirectional_last_seen_ms") / 1000.0, F.col("bidirectional_first_seen_ms") / 1000.0, now)
    return cap.select("flow_id", *cols, ts.alias("ts"))


def normalise_capture_times(cap: DataFrame) -> DataFrame:
    """Ms -> s for start, end and duration; numeric attributes only."""
    numeric = [f.name for f in cap.schema.fields
               if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType))]
    out = cap.select(*numeric)
    return out.withColumns({
        "ts_start": F.col("bidirectional_first_seen_ms") / 1000.0,
        "ts_end": F.col("bidirectional_last_seen_ms") / 1000.0,
        "duration": F.col("bidirectional_duration_ms") / 1000.0,
    })


def payload_schema(features: Sequence[str]) -> T.StructType:
    """``{ts0?, items: [{flow: {...}, ts?, gt_label?, gt_attack?} | {flat...}]}``."""
    flow = T.StructType([T.StructField(f, T.DoubleType()) for f in features] +
                        [T.StructField("flow_id", T.LongType())])
    item = T.StructType([T.StructField("flow", flow)] + list(flow.fields) + [
        T.StructField("ts", T.DoubleType()), T.StructField("gt_label", T.IntegerType()),
        T.StructField("gt_attack", T.StringType())])
    return T.StructType([T.StructField("ts0", T.DoubleType()), T.StructField("items", T.ArrayType(item))])


def ingest_bulk(payloads: DataFrame, features: Sequence[str], body: str = "body",
                now_s: float = 0.0) -> DataFrame:
    """Explode ``items``; each item unwraps ``{flow: {...}}`` or is the
    flat object; ``ts = item.ts or ts0 + idx * 0.001``; ground truth carried."""
    p = payloads.select(F.from_json(F.col(body), payload_schema(features)).alias("p"))
    ex = p.select(F.coalesce(F.col("p.ts0"), F.lit(float(now_s))).alias("ts0"),
                  F.posexplode("p.items").alias("idx", "it"))
    cols = [F.coalesce(F.col(f"it.flow.{f}"), F.col(f"it.{f}")).alias(f) for f in list(features) + ["flow_id"]]
    ts = F.coalesce(F.col("it.ts"), F.col("ts0") + F.col("idx") * 0.001)
    return ex.select(*cols, ts.alias("ts"), F.col("it.gt_label").alias("gt_label"),
                     F.col("it.gt_attack").alias("gt_attack"))


def attach_ground_truth(df: DataFrame, label: str = "Label", attack: str = "Attack") -> DataFrame:
    """A10: split off ``Label`` / ``Attack`` and carry them as ``gt_*``."""
    out = df
    if label in df.columns:
        out = out.withColumnRenamed(label, "gt_label")
    if attack in df.columns:
        out = out.withColumnRenamed(attack, "gt_attack")
    return out


def split_metadata(df: DataFrame, split: str = "split", label: str = "y") -> DataFrame:
    """Counts per (split, label) -- the side-car numbers (task totals are
    sums of these rows)."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def assemble_flows(packets: DataFrame, key: Sequence[str], ts: str = "ts", row_id: str = "row_id",
                   idle_s: float = IDLE_TIMEOUT_S, active_s: float = ACTIVE_TIMEOUT_S,
                   sum_cols: Sequence[str] = ()) -> DataFrame:
    """packets/events -> flows, cut exactly as the capture tool does: a
    packet more than ``idle_s`` after the one before or more than ``active_s``
    after the flow's first packet starts the next flow.

    The cuts depend on each other, but no task walks through a key: see
    :mod:`netwarden.operators.greedy`.  ``flow_no`` counts a key's flows in
    time order; the streaming form (S08) gives the same flows."""
    from netwarden.operators.greedy import greedy_segments
    key = list(key)
    x = packets.select(*key, ts, row_id, *[c for c in sum_cols if c not in (ts, row_id)])
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = greedy_segments(x.withColumn("_us", us), key, F.col("_us"), [row_id], span_us=round(active_s * 1e6) + 1,
                          idle_us=round(idle_s * 1e6))
    agg = cut.groupBy(*key, F.col("segment").alias("flow_no")).agg(
        F.count(F.lit(1)).alias("packets"), F.min("_us").alias("_first"), F.max("_us").alias("_last"),
        *[F.sum(c).alias(c) for c in sum_cols])
    return agg.withColumns({"first_seen_s": F.col("_first") / 1e6, "last_seen_s": F.col("_last") / 1e6,
                            "duration_s": (F.col("_last") - F.col("_first")) / 1e6}).drop("_first", "_last")
