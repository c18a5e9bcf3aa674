"""Fixture views over the driver's tables (FIXTURES.md section 2).

``flows`` maps the ``events`` table onto the NetFlow flow shape (D1):
a pure row-wise projection, so it stays inside one whole-stage-codegen
span and keeps the scan's column pruning and filter pushdown.
``scored``, ``events_scored`` and ``vectors`` are built on top of it.
All are lazy DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.sources.tables import read_table

# Fixed values of the fixture: attack names in the order of the family map
# shipped with the reference (label_map_family), keyed by k % 14.
FIXTURE_ATTACKS = [
    "Bot", "Brute_Force_-Web", "Brute_Force_-XSS", "DDOS_attack-HOIC",
    "DDOS_attack-LOIC-UDP", "DDoS_attacks-LOIC-HTTP", "DoS_attacks-GoldenEye",
    "DoS_attacks-Hulk", "DoS_attacks-SlowHTTPTest", "DoS_attacks-Slowloris",
    "FTP-BruteForce", "Infilteration", "SQL_Injection", "SSH-Bruteforce",
]
BENIGN_LABEL_SPELLINGS = ["Benign", " benign ", "0", "normal"]
ATTACK_LABEL_SPELLINGS = ["Attack", "1", "TRUE", "weird"]

# Route thresholds used by the fixture's fused scorer (K16 inside C11).
FIXTURE_ROUTE_LOW = 0.002
FIXTURE_ROUTE_HIGH = 0.009


_MEMO: dict = {}


def memoized(name: str):
    """Reuse a view's DataFrame within one session as long as the input files
    are the same (size and time of each; see ``store._digest``).  Only views that
    are plans are kept, so every action still reads the files."""
    def deco(fn):
        def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
            from netwarden.plans.store import _digest
            key = (name, id(spark), spark.sparkContext.applicationId, sf_dir,
                   _digest(spark, sf_dir, name, ["events", "embeddings"]))
            if key not in _MEMO:
                _MEMO[key] = fn(spark, sf_dir)
            return _MEMO[key]
        wrapper.__doc__ = fn.__doc__
        wrapper.__wrapped__ = fn
        return wrapper
    return deco


def _case(key: Column, values: list, default=None) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = (F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@memoized("flows")
def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_of(read_table(spark, sf_dir, "events", EVENT_COLUMNS))


def flows_of(ev: DataFrame) -> DataFrame:
    """The flow shape of (batch or streaming) events."""
    k = F.get_json_object("props", "$.k").cast("int")
    b = ev.select(
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k"),
        ((F.col("event_id") * 7919 + k * 104729) % 1000).alias("x"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("y"),
    )
    eid, kk, val, y, x = F.col("event_id"), F.col("k"), F.col("value"), F.col("y"), F.col("x")
    f = b.select(
        eid.alias("flow_id"), "ts", "y", "x", "k",
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 16).cast("int").cast("string"), F.lit("."),
                 (F.col("user_id") % 16).cast("string")).alias("src_ip"),
        F.concat(F.lit("172.31.0."), (kk % 8).cast("string")).alias("dst_ip"),
        (F.lit(1024) + eid % 60000).cast("int").alias("src_port"),
        _case(kk % 4, [53, 80, 443, 22]).cast("int").alias("dst_port"),
        _case(kk % 3, [6, 17, 1]).cast("int").alias("PROTOCOL"),
        F.floor(val * 20).cast("double").alias("IN_PKTS"),
        F.floor(val * (kk % 5)).cast("double").alias("OUT_PKTS"),
        F.floor(val * val * (kk % 11) * 500).cast("double").alias("IN_BYTES"),
        F.floor(val * 100).cast("double").alias("OUT_BYTES"),
        ((eid * 37) % 7000).cast("double").alias("FLOW_DURATION_MILLISECONDS"),
        F.when(kk % 7 == 0, F.floor(val * 10)).otherwise(0).cast("double").alias("RETRANSMITTED_IN_PKTS"),
        F.when((kk % 7 == 0) & (eid % 2 == 0), F.floor(val * 8)).otherwise(0).cast("double")
        .alias("RETRANSMITTED_OUT_PKTS"),
        F.when(kk % 3 == 2, 8).otherwise(-1).cast("int").alias("ICMP_TYPE"),
        F.lit(-1).cast("int").alias("ICMP_IPV4_TYPE"),
        F.when(kk % 4 == 0, 1 + eid % 9).otherwise(0).cast("int").alias("DNS_QUERY_ID"),
        F.when(kk % 16 == 8, 99).when(kk % 4 == 0, 1).otherwise(-1).cast("int").alias("DNS_QUERY_TYPE"),
        F.when(kk % 8 == 0, 0).otherwise(300).cast("double").alias("DNS_TTL_ANSWER"),
        F.when(y == 0, _case(eid % 4, BENIGN_LABEL_SPELLINGS))
        .otherwise(_case(eid % 4, ATTACK_LABEL_SPELLINGS)).alias("Label"),
        F.when(y == 0, F.lit("Benign")).otherwise(_case(kk % 14, FIXTURE_ATTACKS)).alias("Attack"),
        (F.when(y == 1, 35000 + 65 * x).otherwise(65 * x).cast("double") / 100000).alias("p_model"),
        (((eid * 31 + kk * 17) % 1000).cast("double") / 100000).alias("recon_error"),
    )
    dur_s = F.greatest(F.lit(0.000001), F.col("FLOW_DURATION_MILLISECONDS") / F.lit(1000.0))
    return f.select(
        "*",
        (F.col("IN_BYTES") / dur_s).alias("SRC_TO_DST_AVG_THROUGHPUT"),
        (F.col("OUT_BYTES") / dur_s).alias("DST_TO_SRC_AVG_THROUGHPUT"),
    )


@memoized("flow_hits")
def flow_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows + first matching rule."""
    from netwarden.operators.rules import match_rules
    return match_rules(flows(spark, sf_dir))


@memoized("scored")
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored-table contract ``(row_id, y, p, yhat, err, p2)``."""
    fl = flows(spark, sf_dir)
    return fl.select(
        F.col("flow_id").alias("row_id"), "y", F.col("p_model").alias("p"),
        F.when(F.col("p_model") >= 0.5, 1).otherwise(0).alias("yhat"),
        F.col("recon_error").alias("err"),
        (F.col("x").cast("double") / 1000).alias("p2"),
        "Attack",
    )


@memoized("events_scored")
def events_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows + rules + fusion (C01-C11); ``seq`` is the arrival order."""
    return scored_of(flows(spark, sf_dir))


def scored_of(fl: DataFrame) -> DataFrame:
    """Rules, routing and fusion on (batch or streaming) flows."""
    from netwarden.operators.rules import fuse_verdict, match_rules
    from netwarden.operators.routing import three_way_route

    routed = three_way_route(fl, err="recon_error", low=FIXTURE_ROUTE_LOW, high=FIXTURE_ROUTE_HIGH,
                             model_pred=(F.col("p_model") >= 0.5).cast("int"))
    hits = match_rules(routed)
    return fuse_verdict(hits).select(
        "flow_id", F.col("flow_id").alias("seq"), "ts", "src_ip", "dst_ip", "src_port", "dst_port",
        "PROTOCOL", "rule_name", "rule_severity", "rule_score", "rule_reason", "p_attack", "stage",
        "verdict", "family", "family_conf", "final_source", "ml_verdict",
        F.col("recon_error").alias("dede_error"), "p_model",
        F.col("y").alias("gt_label"), F.col("Attack").alias("gt_attack"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors``: (row_id, features array<double>, y, family, split)."""
    from netwarden.operators.sampling import stratified_split

    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    v = emb.select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda e: e.cast("double")).alias("features"),
        F.when(F.col("label") >= 7, 1).otherwise(0).alias("y"),
        F.col("label").alias("family"),
    )
    return stratified_split(v, "y", 0.2, 42, "row_id").select("row_id", "features", "y", "family", "split")
