"""Registered queries: dashboard and alert-page aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.operators import dashboard as D
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.registry import register
from netwarden.plans.store import event_store


@register("alerts_per_minute", sql("""
SELECT CAST(floor(epoch_us(ts) / 60000000.0) * 60 AS BIGINT) AS minute,
       count(*) FILTER (WHERE verdict = 'benign') AS benign,
       count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious,
       count(*) FILTER (WHERE verdict = 'attack') AS attack
FROM events_scored WHERE ts IS NOT NULL GROUP BY 1 ORDER BY minute DESC LIMIT 60""", "events_scored"))
def alerts_per_minute(spark, sf_dir):
    """Flagship (F05): flows -> rules -> fusion -> per-minute verdict counts,
    scored end to end from the raw events (not from the store)."""
    return D.alerts_per_minute(views.events_scored(spark, sf_dir))


AS = "CASE WHEN rule_name IS NOT NULL AND rule_name <> '' AND p_attack IS NOT NULL THEN 'both' " \
     "WHEN rule_name IS NOT NULL AND rule_name <> '' THEN 'rule' WHEN p_attack IS NOT NULL THEN 'ml' ELSE 'none' END"


@register("verdict_stats", sql("""
SELECT coalesce(verdict, 'unknown') AS verdict, count(*) AS n,
       (SELECT epoch_us(arg_max(ts, seq)) / 1e6 FROM events_scored) AS last_ts,
       (SELECT CAST(least(count(*) FILTER (WHERE verdict IN ('suspicious','attack') OR stage = 'rule'), 5000) AS BIGINT)
        FROM events_scored) AS queue_len
FROM events_scored GROUP BY 1""", "events_scored"))
def verdict_stats(spark, sf_dir):
    """counts per verdict, ts of the last arrived event, queue length."""
    return D.verdict_stats(event_store(spark, sf_dir))


@register("stage_breakdown", sql("""
SELECT s.stage, coalesce(a.n, 0) AS n, coalesce(a.high, 0) AS high, coalesce(a.medium, 0) AS medium
FROM (VALUES ('rule'), ('dede_blocked'), ('ganopt_stacking'), ('standard_stacking')) s(stage)
LEFT JOIN (SELECT stage, count(*) AS n, count(*) FILTER (WHERE rule_severity = 'high') AS high,
                  count(*) FILTER (WHERE rule_severity = 'medium') AS medium FROM events_scored GROUP BY stage) a
  ON s.stage = a.stage
UNION ALL
SELECT stage, count(*), count(*) FILTER (WHERE rule_severity = 'high'), count(*) FILTER (WHERE rule_severity = 'medium')
FROM events_scored WHERE stage IN ('binary', 'family') GROUP BY stage""", "events_scored"))
def stage_breakdown(spark, sf_dir):
    """fixed stage rows, zero-filled, plus non-zero optional stages."""
    return D.stage_breakdown(event_store(spark, sf_dir))


@register("verdict_distribution", sql("""
SELECT verdict, count(*) AS n FROM events_scored WHERE verdict IN ('benign','suspicious','attack') GROUP BY 1""",
                                      "events_scored"))
def verdict_distribution(spark, sf_dir):
    """non-zero verdict counts."""
    return D.verdict_distribution(event_store(spark, sf_dir))


@register("count_top_k", sql("""
SELECT gt_attack AS key, count(*) AS n FROM events_scored WHERE verdict <> 'benign' AND gt_attack IS NOT NULL
GROUP BY 1 ORDER BY n DESC, key LIMIT 5""", "events_scored"))
def count_top_k(spark, sf_dir):
    """generic filter / key / count / top-k (ties by key)."""
    ev = event_store(spark, sf_dir)
    return D.count_top_k(ev, F.col("gt_attack"), 5, F.col("verdict") != "benign")


@register("top_families", sql("""
SELECT family, count(*) AS n FROM events_scored WHERE verdict = 'attack' AND family IS NOT NULL AND family <> ''
GROUP BY 1 ORDER BY n DESC, family LIMIT 8""", "events_scored"))
def top_families(spark, sf_dir):
    """attack verdicts by family, top 8."""
    return D.top_families(event_store(spark, sf_dir))


@register("protocol_distribution", sql("""
SELECT CASE WHEN PROTOCOL IS NULL THEN '-' ELSE upper(CASE PROTOCOL WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp'
       WHEN 1 THEN 'icmp' ELSE CAST(PROTOCOL AS VARCHAR) END) END AS proto, count(*) AS n
FROM events_scored WHERE verdict IN ('attack', 'suspicious') GROUP BY 1 ORDER BY n DESC, proto LIMIT 10""",
                                       "events_scored"))
def protocol_distribution(spark, sf_dir):
    """attack + suspicious by protocol, top 10."""
    return D.protocol_distribution(event_store(spark, sf_dir))


@register("top_targets", sql("""
SELECT CASE WHEN dst_ip IS NULL OR dst_ip = '' THEN '-' WHEN dst_port IS NULL THEN dst_ip
       ELSE concat(dst_ip, ':', CAST(dst_port AS VARCHAR)) END AS target, count(*) AS n
FROM events_scored WHERE verdict IN ('attack', 'suspicious') GROUP BY 1 ORDER BY n DESC, target LIMIT 8""",
                             "events_scored"))
def top_targets(spark, sf_dir):
    """attack + suspicious by dst_ip:port, top 8."""
    return D.top_targets(event_store(spark, sf_dir))


@register("top_sources", sql("""
SELECT src_ip, count(*) AS n FROM events_scored WHERE verdict IN ('attack', 'suspicious') AND src_ip IS NOT NULL
GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 8""", "events_scored"))
def top_sources(spark, sf_dir):
    """attack + suspicious by src_ip, top 8."""
    return D.top_sources(event_store(spark, sf_dir))


@register("alert_summary", sql(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'attack') AS attack,
  count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious,
  count(*) FILTER (WHERE verdict NOT IN ('attack', 'suspicious') OR verdict IS NULL) AS benign,
  count(*) FILTER (WHERE {AS} = 'rule') AS rule_only, count(*) FILTER (WHERE {AS} = 'ml') AS ml_only,
  count(*) FILTER (WHERE {AS} = 'both') AS both
FROM events_scored""", "events_scored"))
def alert_summary(spark, sf_dir):
    """totals by verdict and by source."""
    return D.alert_summary(event_store(spark, sf_dir))


@register("stat_cards", sql("""
SELECT count(*) FILTER (WHERE verdict IN ('benign','suspicious','attack')) AS total,
  count(*) FILTER (WHERE verdict = 'benign') AS benign, count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious,
  count(*) FILTER (WHERE verdict = 'attack') AS attack
FROM events_scored""", "events_scored"))
def stat_cards(spark, sf_dir):
    """totals over the three verdicts."""
    return D.stat_cards(event_store(spark, sf_dir))


@register("recent_alerts", sql("""
SELECT flow_id, epoch_us(ts) / 1e6 AS ts, verdict, stage FROM events_scored
ORDER BY coalesce(epoch_us(ts), 0) DESC, flow_id LIMIT 15""", "events_scored"))
def recent_alerts(spark, sf_dir):
    """Newest 15 by ts (null ts as 0); ts as epoch seconds."""
    r = D.recent_alerts(event_store(spark, sf_dir))
    return r.select("flow_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "verdict", "stage")


@register("decision_text", sql("""
SELECT flow_id,
  CASE WHEN stage = 'rule' AND rule_name IS NOT NULL THEN concat(rule_name, ' (', rule_severity, ')')
       WHEN p_attack IS NOT NULL THEN concat('ML p=', CASE WHEN p_attack = 1 THEN '1.0000' ELSE '0.0000' END)
       WHEN family IS NOT NULL THEN concat('Family: ', family) ELSE '-' END AS decision,
  CASE WHEN src_ip IS NULL OR src_ip = '' THEN '-' WHEN src_port IS NULL THEN src_ip
       ELSE concat(src_ip, ':', CAST(src_port AS VARCHAR)) END AS source,
  CASE WHEN rule_name IS NOT NULL AND rule_name <> '' AND p_attack IS NOT NULL THEN 'both'
       WHEN rule_name IS NOT NULL AND rule_name <> '' THEN 'rule' WHEN p_attack IS NOT NULL THEN 'ml' ELSE 'none' END
    AS alert_source,
  concat_ws('-', CAST(epoch_us(ts) AS VARCHAR), src_ip, dst_ip, CAST(src_port AS VARCHAR), CAST(dst_port AS VARCHAR),
            stage, verdict) AS alert_key
FROM events_scored""", "events_scored"))
def decision_text(spark, sf_dir):
    """Alert-table text columns (p is 0/1 here, so the
    %.4f text is exact in both engines)."""
    ev = event_store(spark, sf_dir)
    return ev.select(
        "flow_id",
        D.decision_text(F.col("stage"), F.col("rule_name"), F.col("rule_severity"), F.col("p_attack"),
                        F.col("family")).alias("decision"),
        D.format_endpoint(F.col("src_ip"), F.col("src_port")).alias("source"),
        D.alert_source(F.col("rule_name"), F.col("p_attack")).alias("alert_source"),
        D.alert_key(ev).alias("alert_key"))


@register("normalise_alert", sql("""
SELECT flow_id, 'unknown' AS verdict, 'binary' AS stage, src_ip, dst_ip, src_port, dst_port, PROTOCOL AS proto,
       IN_BYTES AS in_bytes, OUT_BYTES AS out_bytes, IN_PKTS AS in_pkts, OUT_PKTS AS out_pkts,
       FLOW_DURATION_MILLISECONDS AS duration_ms
FROM flows""", "flows"))
def normalise_alert(spark, sf_dir):
    """Raw flat rows (no verdict / stage yet) normalised to the alert
    shape with defaults; meta and stats flattened for the comparison."""
    n = D.normalise_alert(views.flows(spark, sf_dir), keep=["flow_id"])
    return n.select("flow_id", "verdict", "stage", "meta.src_ip", "meta.dst_ip", "meta.src_port", "meta.dst_port",
                    "meta.proto", "stats.in_bytes", "stats.out_bytes", "stats.in_pkts", "stats.out_pkts",
                    "stats.duration_ms")
