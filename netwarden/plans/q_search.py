"""Registered queries: event filters and the search language."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.operators import search as S
from netwarden.operators.dashboard import newest_n
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.registry import register
from netwarden.plans.store import event_index, event_store

OUT_NAMES = ["flow_id", "ts", "verdict", "stage", "src_ip", "dst_ip", "src_port", "dst_port", "PROTOCOL", "rule_name"]
# time leaves the engine as epoch seconds (the reference's representation);
# it also keeps pandas dtypes identical across engines


def out_cols():
    """Output columns (built lazily: importing this module needs no Spark)."""
    return [F.col(c) if c != "ts" else (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")
            for c in OUT_NAMES]


OUT_SQL = ", ".join(c if c != "ts" else "epoch_us(ts) / 1e6 AS ts" for c in OUT_NAMES)

PROTO_SQL = ("CASE PROTOCOL WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' "
             "ELSE coalesce(CAST(PROTOCOL AS VARCHAR), '') END")
BLOB_SQL = ("lower(concat(verdict, ' ', stage, ' ', coalesce(family, ''), ' ', " + PROTO_SQL +
            ", ' ', src_ip, ':', CAST(src_port AS VARCHAR), ' ', dst_ip, ':', CAST(dst_port AS VARCHAR), ' ', "
            "coalesce(rule_name, ''), ' ', coalesce(rule_severity, '')))")


def port(n):
    return f"(src_port = {n} OR dst_port = {n})"


def fam(t):
    return f"(contains(lower(coalesce(family, '')), '{t}') OR contains({BLOB_SQL}, '{t}'))"


# (query key, search string, equivalent SQL predicate)
CASES = [
    ("search_ip_contains", "src=10.0.1", "contains(src_ip, '10.0.1')"),
    ("search_ip_prefix", "sip=10.0.1.", "starts_with(src_ip, '10.0.1.')"),
    ("search_ip_star", "dst_ip=172.*", "starts_with(dst_ip, '172')"),
    ("search_dst_contains", "dip=0.3", "contains(dst_ip, '0.3')"),
    ("search_family", "fam=MAL", "contains(lower(coalesce(family, '')), 'mal')"),
    ("search_rule", "rule=dns_ttl", "contains(lower(coalesce(rule_name, '')), 'dns_ttl')"),
    ("search_proto_name", "proto=udp", f"{PROTO_SQL} = 'udp'"),
    ("search_proto_number", "protocol=17", "PROTOCOL = 17"),
    ("search_proto_junk", "proto=xyz", "false"),
    ("search_port_key", "port=53", port(53)),
    ("search_port_junk", "p=abc", "true"),
    ("search_unknown_key", "stage=rule", f"contains({BLOB_SQL}, 'stage=rule')"),
    ("search_empty_value", "family=", "true"),
    ("search_colon_port", ":443", port(443)),
    ("search_bare_proto", "icmp", f"{PROTO_SQL} = 'icmp'"),
    ("search_bare_number", "22", port(22)),
    ("search_rule_token", "short_pkt",
     f"(contains(lower(coalesce(rule_name, '')), 'short_pkt') OR contains({BLOB_SQL}, 'short_pkt'))"),
    ("search_dns_token", "dns", f"(contains(lower(coalesce(rule_name, '')), 'dns') OR contains({BLOB_SQL}, 'dns'))"),
    ("search_default_token", "suspicious", fam("suspicious")),
    ("search_blob_ip_port", "172.31.0.2:443", fam("172.31.0.2:443")),
    ("search_combined", "udp :53 dst=172.31.0.4 attack",
     f"{PROTO_SQL} = 'udp' AND {port(53)} AND contains(dst_ip, '172.31.0.4') AND {fam('attack')}"),
]


def _make(q):
    def build(spark, sf_dir):
        return S.filter_events(event_store(spark, sf_dir), q=q).select(*out_cols())
    build.__doc__ = f"D07: flows matching search {q!r}."
    return build


for _name, _q, _where in CASES:
    register(_name, sql(f"SELECT {OUT_SQL} FROM events_scored WHERE {_where}", "events_scored"))(_make(_q))


@register("interesting_events", sql(f"""
SELECT {OUT_SQL} FROM events_scored WHERE verdict IN ('suspicious', 'attack') OR stage = 'rule'""",
                                    "events_scored"))
def interesting_events(spark, sf_dir):
    """The side stream of suspicious / attack / rule-stage events."""
    ev = event_store(spark, sf_dir)
    return ev.where(S.interesting()).select(*out_cols())


@register("filter_time", sql(f"""
SELECT {OUT_SQL} FROM events_scored
WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-05 12:00:00'""", "events_scored"))
def filter_time(spark, sf_dir):
    """Both bounds inclusive."""
    ev = event_store(spark, sf_dir)
    return S.filter_events(ev, since="2024-01-03 00:00:00", until="2024-01-05 12:00:00").select(*out_cols())


@register("filter_verdict", sql(f"SELECT {OUT_SQL} FROM events_scored WHERE verdict = 'suspicious'",
                                "events_scored"))
def filter_verdict(spark, sf_dir):
    """Equality on one of the three verdicts."""
    return S.filter_events(event_store(spark, sf_dir), verdict="suspicious").select(*out_cols())


@register("filter_verdict_ignored", sql(f"SELECT {OUT_SQL} FROM events_scored", "events_scored"))
def filter_verdict_ignored(spark, sf_dir):
    """An unknown verdict value is ignored (no filter)."""
    return S.filter_events(event_store(spark, sf_dir), verdict="unknown").select(*out_cols())


@register("filter_ip_contains", sql(f"""
SELECT {OUT_SQL} FROM events_scored WHERE contains(src_ip, '10.0.3') AND contains(dst_ip, '.0.5')""",
                                    "events_scored"))
def filter_ip_contains(spark, sf_dir):
    """Substring on src and dst ip."""
    return S.filter_events(event_store(spark, sf_dir), src_ip=" 10.0.3 ", dst_ip=".0.5").select(*out_cols())


@register("relative_range", sql(f"""
SELECT {OUT_SQL} FROM events_scored WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 24 HOUR""",
                                "events_scored"))
def relative_range(spark, sf_dir):
    """The 24h range relative to a fixed reference time."""
    return S.relative_range(event_store(spark, sf_dir), "24h", "2024-01-10 12:00:00").select(*out_cols())


@register("filter_source_tab", sql(f"""
SELECT {OUT_SQL} FROM events_scored WHERE rule_name IS NOT NULL AND p_attack IS NOT NULL""", "events_scored"))
def filter_source_tab(spark, sf_dir):
    """The 'both' tab (rule and model present)."""
    return S.filter_source_tab(event_store(spark, sf_dir), "both").select(*out_cols())


@register("newest_events", sql(f"""
SELECT {OUT_SQL} FROM events_scored
WHERE (verdict IN ('suspicious', 'attack') OR stage = 'rule') AND {PROTO_SQL} = 'udp'
ORDER BY seq DESC LIMIT 200""", "events_scored"))
def newest_events(spark, sf_dir):
    """The event API -- interesting events matching a search, newest 200."""
    ev = event_store(spark, sf_dir)
    return newest_n(S.filter_events(ev.where(S.interesting()), q="udp"), 200).select(*out_cols())


@register("retain_latest", sql(f"SELECT {OUT_SQL} FROM events_scored ORDER BY seq DESC LIMIT 5000",
                               "events_scored"))
def retain_latest(spark, sf_dir):
    """Bounded retention of the newest 5,000 rows."""
    return newest_n(event_store(spark, sf_dir), 5000).select(*out_cols())


INDEXED = [
    ("indexed_ip_contains", {"src_ip": "10.0.3", "dst_ip": ".0.5"}, "contains(src_ip, '10.0.3') AND contains(dst_ip, '.0.5')"),
    ("indexed_ip_absent", {"q": "src=192.168.77"}, "contains(src_ip, '192.168.77')"),
    ("indexed_text", {"q": "172.31.0.2:443"}, fam("172.31.0.2:443")),
    ("indexed_combined", {"q": "udp :53 dst=172.31.0.4 attack"},
     f"{PROTO_SQL} = 'udp' AND {port(53)} AND contains(dst_ip, '172.31.0.4') AND {fam('attack')}"),
]


def _make_indexed(filters):
    def build(spark, sf_dir):
        path, index = event_index(spark, sf_dir)
        return S.search_store(spark, path, index, **filters).select(*out_cols())
    build.__doc__ = f"D03 + D07: flows matching {filters!r}; files without the texts' trigrams are not read."
    return build


for _name, _filters, _where in INDEXED:
    register(_name, sql(f"SELECT {OUT_SQL} FROM events_scored WHERE {_where}", "events_scored"))(_make_indexed(_filters))
