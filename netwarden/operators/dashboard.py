"""Dashboard and alert-page aggregations.

In the reference these run in the browser over the newest few thousand
events; here they are cluster aggregations over the whole event table and
only the small result leaves the executors.  Top-k queries use
``orderBy(...).limit(k)`` which plans as ``TakeOrderedAndProject`` (a
bounded heap per partition, no global sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ["benign", "suspicious", "attack"]
# Rows of the stage panel, in display order.
STAGE_ROWS = ["rule", "dede_blocked", "ganopt_stacking", "standard_stacking"]
OPTIONAL_STAGES = ["binary", "family"]
EVENT_QUEUE_CAP = 5000
FLOW_QUEUE_CAP = 20000


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def epoch_seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def alerts_per_minute(ev: DataFrame, ts: str = "ts", verdict: str = "verdict", last_n: int = 60) -> DataFrame:
    """per-minute counts of benign / suspicious / attack, the newest
    ``last_n`` non-empty minutes (rows without ``ts`` are dropped); the
    bucket is ``floor(ts / 60) * 60`` in epoch seconds, as in the reference."""
    minute = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(60000000.0)) * 60).cast("long")
    agg = ev.where(F.col(ts).isNotNull()).groupBy(minute.alias("minute")).agg(
        *[_cnt(F.col(verdict) == v).alias(v) for v in VERDICTS])
    return agg.orderBy(F.col("minute").desc()).limit(last_n)


def verdict_stats(ev: DataFrame, verdict: str = "verdict", seq: str = "seq", ts: str = "ts",
                  stage: str = "stage") -> DataFrame:
    """count per verdict, ts of the last ARRIVED event (max_by seq) and
    the interesting-event queue length (capped)."""
    counts = ev.groupBy(F.coalesce(F.col(verdict), F.lit("unknown")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = ev.agg(epoch_seconds(F.max_by(F.col(ts), F.col(seq))).alias("last_ts"),
                 F.least(_cnt(F.col(verdict).isin("suspicious", "attack") | (F.col(stage) == "rule")),
                         F.lit(EVENT_QUEUE_CAP)).cast("long").alias("queue_len"))
    from netwarden.functions.scalars import attach_scalars
    return attach_scalars(counts, tot)


def stage_breakdown(ev: DataFrame, stage: str = "stage", severity: str = "rule_severity") -> DataFrame:
    """fixed stage rows (zero-filled) plus ``binary``/``family`` only when
    non-zero; high / medium rule counts."""
    spark = ev.sparkSession
    agg = ev.groupBy(F.col(stage).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"),
        _cnt(F.col(severity) == "high").alias("high"),
        _cnt(F.col(severity) == "medium").alias("medium"))
    fixed = spark.createDataFrame([(s, i) for i, s in enumerate(STAGE_ROWS)], "stage string, ord int")
    base = fixed.join(agg, "stage", "left").select(
        "stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("high", F.lit(0)).cast("long").alias("high"),
        F.coalesce("medium", F.lit(0)).cast("long").alias("medium"))
    extra = agg.where(F.col("stage").isin(*OPTIONAL_STAGES) & (F.col("n") > 0)).select("stage", "n", "high", "medium")
    return base.unionByName(extra)


def verdict_distribution(ev: DataFrame, verdict: str = "verdict") -> DataFrame:
    """non-zero verdict counts."""
    return ev.where(F.col(verdict).isin(*VERDICTS)).groupBy(verdict).agg(F.count(F.lit(1)).alias("n"))


def count_top_k(ev: DataFrame, key: Column, k: int, where: Column | None = None, key_name: str = "key") -> DataFrame:
    """filter, key, count, top k by count (ties by key)."""
    src = ev.where(where) if where is not None else ev
    agg = src.where(key.isNotNull()).groupBy(key.alias(key_name)).agg(F.count(F.lit(1)).alias("n"))
    return agg.orderBy(F.col("n").desc(), F.col(key_name)).limit(k)


def top_families(ev: DataFrame, k: int = 8) -> DataFrame:
    """attack verdicts with a family, top 8."""
    return count_top_k(ev, F.col("family"), k, (F.col("verdict") == "attack") & (F.col("family") != ""), "family")


def ui_proto(c: Column) -> Column:
    """B19 UI variant: upper-case name, dash for null."""
    from netwarden.functions.clean import proto_name
    return F.when(c.isNull(), F.lit("-")).otherwise(F.upper(proto_name(c)))


def protocol_distribution(ev: DataFrame, k: int = 10) -> DataFrame:
    """attack + suspicious per protocol, top 10."""
    return count_top_k(ev, ui_proto(F.col("PROTOCOL")), k, F.col("verdict").isin("attack", "suspicious"), "proto")


def format_endpoint(ip: Column, port: Column) -> Column:
    """``ip``, ``ip:port``, or a dash without ip."""
    return F.when(ip.isNull() | (ip == ""), F.lit("-")) \
            .when(port.isNull(), ip).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def top_targets(ev: DataFrame, k: int = 8) -> DataFrame:
    """attack + suspicious per ``dst_ip[:port]``, top 8."""
    return count_top_k(ev, format_endpoint(F.col("dst_ip"), F.col("dst_port")), k,
                       F.col("verdict").isin("attack", "suspicious"), "target")


def top_sources(ev: DataFrame, k: int = 8) -> DataFrame:
    """attack + suspicious per src_ip, top 8."""
    return count_top_k(ev, F.col("src_ip"), k, F.col("verdict").isin("attack", "suspicious"), "src_ip")


def alert_source(rule: Column, p: Column) -> Column:
    """Both / rule / ml / none (null probability means no ML)."""
    has_rule = rule.isNotNull() & (rule != "")
    has_ml = p.isNotNull()
    return F.when(has_rule & has_ml, "both").when(has_rule, "rule").when(has_ml, "ml").otherwise("none")


def alert_summary(ev: DataFrame) -> DataFrame:
    """totals by verdict and by source (benign = everything else)."""
    src = alert_source(F.col("rule_name"), F.col("p_attack"))
    v = F.col("verdict")
    return ev.agg(
        F.count(F.lit(1)).alias("total"), _cnt(v == "attack").alias("attack"),
        _cnt(v == "suspicious").alias("suspicious"),
        _cnt(~v.isin("attack", "suspicious") | v.isNull()).alias("benign"),
        _cnt(src == "rule").alias("rule_only"), _cnt(src == "ml").alias("ml_only"),
        _cnt(src == "both").alias("both"))


def stat_cards(ev: DataFrame) -> DataFrame:
    """totals over the three verdicts only (unknown left out)."""
    v = F.col("verdict")
    return ev.agg(_cnt(v.isin(*VERDICTS)).alias("total"), *[_cnt(v == x).alias(x) for x in VERDICTS])


def newest_n(ev: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """Newest first, stop at ``n`` (after all filters); a heap for
    small n, a distributed rank for large n (see ``sampling.first_n``)."""
    from netwarden.operators.sampling import first_n
    return first_n(ev, n, [seq], descending=True)


def retain_latest(ev: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """Bounded retention as a keyed top-n (no global sort)."""
    return newest_n(ev, n, seq)


def recent_alerts(ev: DataFrame, n: int = 15, key: str = "flow_id") -> DataFrame:
    """Newest by ts (null ts counts as epoch 0), first 15."""
    t = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))
    return ev.orderBy(t.desc(), F.col(key)).limit(n)


def decision_text(stage: Column, rule: Column, severity: Column, p: Column, family: Column) -> Column:
    """``NAME (severity)`` for the rule stage, else ``ML p=0.1234``,
    else ``Family: f``, else a dash."""
    return F.when((stage == "rule") & rule.isNotNull(), F.concat(rule, F.lit(" ("), severity, F.lit(")"))) \
            .when(p.isNotNull(), F.format_string("ML p=%.4f", p)) \
            .when(family.isNotNull(), F.concat(F.lit("Family: "), family)).otherwise(F.lit("-"))


def alert_key(ev: DataFrame) -> Column:
    """Id, or ``ts-src-dst-sport-dport-stage-verdict``."""
    parts = [F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.col("src_ip"), F.col("dst_ip"),
             F.col("src_port").cast("string"), F.col("dst_port").cast("string"), F.col("stage"), F.col("verdict")]
    ident = F.col("id") if "id" in ev.columns else F.lit(None).cast("string")
    return F.coalesce(ident, F.concat_ws("-", *parts))


# Alias lists of the alert page (first present wins).
ALERT_META_ALIASES = {
    "src_ip": ["src_ip", "IPV4_SRC_ADDR"], "dst_ip": ["dst_ip", "IPV4_DST_ADDR"],
    "src_port": ["src_port", "L4_SRC_PORT"], "dst_port": ["dst_port", "L4_DST_PORT"],
    "proto": ["proto", "PROTOCOL"], "l7_proto": ["l7_proto", "L7_PROTO"],
}
ALERT_STATS_ALIASES = {
    "in_bytes": ["in_bytes", "IN_BYTES"], "out_bytes": ["out_bytes", "OUT_BYTES"],
    "in_pkts": ["in_pkts", "IN_PKTS"], "out_pkts": ["out_pkts", "OUT_PKTS"],
    "duration_ms": ["duration_ms", "FLOW_DURATION_MILLISECONDS", "FLOW_DURATION"],
}


def normalise_alert(df: DataFrame, keep=()) -> DataFrame:
    """Flat alert rows -> ``meta`` / ``stats`` structs from alias columns
    (resolved on the driver against the schema, exact names), defaults
    ``verdict = unknown`` and ``stage = binary``."""
    def first(aliases):
        present = [F.col(a) for a in aliases if a in df.columns]
        return F.coalesce(*present) if present else F.lit(None)

    def opt(c):
        return F.col(c) if c in df.columns else F.lit(None)

    meta = F.struct(*[first(v).alias(k) for k, v in ALERT_META_ALIASES.items()])
    stats = F.struct(*[first(v).cast("double").alias(k) for k, v in ALERT_STATS_ALIASES.items()])
    return df.select(
        *keep, opt("ts").alias("ts"), F.coalesce(opt("verdict"), F.lit("unknown")).alias("verdict"),
        F.coalesce(opt("stage"), F.lit("binary")).alias("stage"), opt("p_attack").alias("p_attack"),
        opt("family").alias("family"), opt("gt_attack").alias("gt_attack"), meta.alias("meta"),
        stats.alias("stats"))
