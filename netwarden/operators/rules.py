"""Detection rules and verdict fusion.

The whole ordered rule list compiles to ONE expression:
``coalesce(when(p1, hit1), when(p2, hit2), ...)`` -- first match wins, it
is evaluated inside whole-stage codegen, and there is no Python on the
row path.  User rules are plain ``Rule`` objects holding a ``Column``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.functions.clean import META_ALIASES

# Fixed values (DNS query types counted as "real DNS": A, NS, CNAME, SOA,
# PTR, MX, TXT, AAAA, SRV, ANY).
DNS_QTYPES = [1, 2, 5, 6, 12, 15, 16, 28, 33, 255]

RULE_STRUCT = "rule"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str  # "high" | "medium"
    score: float
    predicate: Callable[[dict], Column]
    reason: Callable[[dict], Column]


def _types(df) -> dict:
    """Column -> type map; accepts a DataFrame or an already built map so a
    rule compile reads the schema once."""
    return df if isinstance(df, dict) else dict(df.dtypes)


# names under which a flow table may carry the ports of the rules
_PORT_NAMES = {"SRC_PORT": META_ALIASES["src_port"], "DST_PORT": META_ALIASES["dst_port"]}


def _present(df, name: str) -> str | None:
    """The table's own name of a rule input: Spark compares names without
    regard to case, and the ports go by several names."""
    have = {}
    for c in _types(df):
        have.setdefault(c.lower(), c)
    return next((have[n.lower()] for n in [name, *_PORT_NAMES.get(name, [])] if n.lower() in have), None)


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_FLOATING = ("float", "double")


def _dtype(df, name: str) -> str:
    return _types(df)[name]


def num(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Rule-side float read: missing, null or unparsable -> ``default``.
    NaN is turned into null so that, as in the reference, every comparison
    with it is false (Spark orders NaN above every number).  Typed numeric
    columns skip the string parse (smaller generated code)."""
    name = _present(df, name)
    if name is None:
        return F.lit(float(default))
    t = _dtype(df, name)
    if t in _INTEGRAL:
        return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))
    v = F.col(name).cast("double") if t in _FLOATING else F.expr(f"try_cast(`{name}` as double)")
    return F.coalesce(F.when(~F.isnan(v), v), F.when(v.isNull(), F.lit(float(default))))


def integer(df: DataFrame, name: str, default: int) -> Column:
    """Rule-side int read: ``int(float(v))`` (truncates), else ``default``."""
    name = _present(df, name)
    if name is None:
        return F.lit(int(default))
    t = _dtype(df, name)
    if t in ("tinyint", "smallint", "int"):
        return F.coalesce(F.col(name).cast("int"), F.lit(int(default)))
    src = F.col(name) if t in _FLOATING or t == "bigint" else F.expr(f"try_cast(`{name}` as double)")
    return F.coalesce(src.try_cast("int"), F.lit(int(default)))


def rule_inputs(df: DataFrame) -> dict:
    """Derived inputs shared by all rules."""
    df = _types(df)
    g = {}
    g["proto"] = integer(df, "PROTOCOL", -1)
    g["pkts"] = num(df, "IN_PKTS") + num(df, "OUT_PKTS")
    g["bytes"] = num(df, "IN_BYTES") + num(df, "OUT_BYTES")
    g["dur_ms"] = num(df, "FLOW_DURATION_MILLISECONDS")
    g["rratio"] = (num(df, "RETRANSMITTED_IN_PKTS") + num(df, "RETRANSMITTED_OUT_PKTS")) / \
        F.greatest(F.lit(1.0), g["pkts"])
    # an inbound NaN (null here) decides, an outbound one is passed over
    inbound, outbound = num(df, "SRC_TO_DST_AVG_THROUGHPUT"), num(df, "DST_TO_SRC_AVG_THROUGHPUT")
    g["thr"] = F.when(inbound.isNotNull(), F.greatest(inbound, outbound))
    g["icmp_type"] = integer(df, "ICMP_TYPE", -1)
    g["icmp4_type"] = integer(df, "ICMP_IPV4_TYPE", -1)
    g["src_port"] = integer(df, "SRC_PORT", -1)
    g["dst_port"] = integer(df, "DST_PORT", -1)
    g["dns_id"] = integer(df, "DNS_QUERY_ID", -1)
    g["dns_qtype"] = integer(df, "DNS_QUERY_TYPE", -1)
    g["dns_ttl"] = num(df, "DNS_TTL_ANSWER", -1.0)
    g["is_dns"] = (g["dns_id"] > 0) | g["dns_qtype"].isin(DNS_QTYPES)
    return g


def _f0(c: Column) -> Column:
    return F.format_string("%.0f", c)


def default_rules() -> list[Rule]:
    """The shipped rule set, in evaluation order (first match wins)."""
    def short(g, hi):
        return (g["dur_ms"] > 0) & (g["dur_ms"] <= hi)

    return [
        Rule("DNS_TTL_ANOMALY", "medium", 0.55,
             lambda g: g["is_dns"] & (g["dns_ttl"] == 0) & (g["pkts"] >= 3) & (g["dur_ms"] > 0),
             lambda g: F.format_string("dns_id=%d qtype=%d ttl=%s pkts=%s", g["dns_id"], g["dns_qtype"],
                                       g["dns_ttl"].cast("string"), _f0(g["pkts"]))),
        Rule("ICMP_BURST", "high", 0.97,
             lambda g: ((g["icmp_type"] != -1) | (g["icmp4_type"] != -1)) & (g["pkts"] >= 2000) & short(g, 5000),
             lambda g: F.format_string("icmp=%d/%d pkts=%s dur_ms=%s", g["icmp_type"], g["icmp4_type"],
                                       _f0(g["pkts"]), _f0(g["dur_ms"]))),
        Rule("HIGH_RETRANSMISSION_RATIO", "high", 0.95,
             lambda g: (g["pkts"] >= 200) & (g["rratio"] >= 0.60),
             lambda g: F.format_string("rratio=%.2f pkts=%s", g["rratio"], _f0(g["pkts"]))),
        Rule("THROUGHPUT_EXTREME_SHORT", "high", 0.93,
             lambda g: short(g, 3000) & (g["thr"] >= 1e8),
             lambda g: F.format_string("thr=%.1e dur_ms=%s pkts=%s", g["thr"], _f0(g["dur_ms"]), _f0(g["pkts"]))),
        Rule("DNS_TTL_ANOMALY", "medium", 0.55,
             lambda g: g["is_dns"] & (((g["src_port"] == 53) | (g["dst_port"] == 53)) | g["dns_qtype"].isin(DNS_QTYPES))
             & (g["pkts"] >= 2) & (g["bytes"] >= 60) & (g["dns_ttl"] == 0),
             lambda g: F.format_string("dns_id=%d qtype=%d ttl=%s sport=%d dport=%d", g["dns_id"], g["dns_qtype"],
                                       g["dns_ttl"].cast("string"), g["src_port"], g["dst_port"])),
        Rule("SHORT_PKT_BURST", "medium", 0.65,
             lambda g: short(g, 1000) & (g["pkts"] >= 500),
             lambda g: F.format_string("pkts=%s dur_ms=%s", _f0(g["pkts"]), _f0(g["dur_ms"]))),
        Rule("SHORT_BYTES_BURST", "medium", 0.62,
             lambda g: short(g, 2000) & (g["bytes"] >= 5e7),
             lambda g: F.format_string("bytes=%s dur_ms=%s", _f0(g["bytes"]), _f0(g["dur_ms"]))),
        Rule("THROUGHPUT_SPIKE", "medium", 0.60,
             lambda g: g["thr"] >= 5e7,
             lambda g: F.format_string("thr=%.1e", g["thr"])),
        Rule("RETRANSMISSION_SUSPECT", "medium", 0.58,
             lambda g: (g["pkts"] >= 100) & (g["rratio"] >= 0.35),
             lambda g: F.format_string("rratio=%.2f pkts=%s", g["rratio"], _f0(g["pkts"]))),
        Rule("UDP_BURST", "medium", 0.62,
             lambda g: (g["proto"] == 17) & short(g, 2000) & (g["pkts"] >= 800),
             lambda g: F.format_string("pkts=%s dur_ms=%s", _f0(g["pkts"]), _f0(g["dur_ms"]))),
    ]


INPUT_COLS = ["proto", "pkts", "bytes", "dur_ms", "rratio", "thr", "icmp_type", "icmp4_type", "src_port", "dst_port",
              "dns_id", "dns_qtype", "dns_ttl", "is_dns"]


def with_rule_inputs(df: DataFrame) -> DataFrame:
    """Stage 1: the derived rule inputs as columns ``_ri_<name>``.  Keeping
    them as attributes (not re-inlined expressions) keeps the generated code
    of the rule predicate small."""
    g = rule_inputs(df)
    return df.select("*", *[g[c].alias(f"_ri_{c}") for c in INPUT_COLS])


def _input_refs() -> dict:
    return {c: F.col(f"_ri_{c}") for c in INPUT_COLS}


def rule_id_expr(rules: list[Rule] | None = None) -> Column:
    """Stage 2: 1-based index of the first matching rule, null when none."""
    rules = default_rules() if rules is None else rules
    g = _input_refs()
    return F.coalesce(*[F.when(F.coalesce(r.predicate(g), F.lit(False)), F.lit(i))
                        for i, r in enumerate(rules, start=1)])


def match_rules(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``rule_id, rule_name, rule_severity, rule_score, rule_reason``
    (all null when no rule fires).  Name, severity and score are lookups in
    literal arrays by ``rule_id``; the reason text is only computed when a
    query selects it (column pruning drops it otherwise)."""
    rules = default_rules() if rules is None else rules
    cols = df.columns
    staged = with_rule_inputs(df).withColumn("rule_id", rule_id_expr(rules))
    rid = F.col("rule_id")
    names = F.array(*[F.lit(r.name) for r in rules])
    sevs = F.array(*[F.lit(r.severity) for r in rules])
    scores = F.array(*[F.lit(float(r.score)) for r in rules])
    g = _input_refs()
    reason = None
    for i, r in enumerate(rules, start=1):
        reason = F.when(rid == i, r.reason(g)) if reason is None else reason.when(rid == i, r.reason(g))
    out = staged.select(
        *cols, "rule_id",
        F.when(rid.isNotNull(), F.get(names, rid - 1)).alias("rule_name"),
        F.when(rid.isNotNull(), F.get(sevs, rid - 1)).alias("rule_severity"),
        F.when(rid.isNotNull(), F.get(scores, rid - 1)).alias("rule_score"),
        reason.alias("rule_reason"))
    return out


def fuse_verdict(df: DataFrame, model_pred: str | None = "ml_pred", model_stage: str = "ml_stage") -> DataFrame:
    """C11: rule hit + model -> ``p_attack, stage, verdict, family,
    family_conf, final_source, ml_verdict``.

    ``model_pred`` (0/1) and ``model_stage`` come from the model path (e.g.
    :func:`netwarden.operators.routing.three_way_route`); with
    ``model_pred=None`` the rules-only fallback is used.
    """
    rule_any = F.col("rule_name").isNotNull()
    rule_high = rule_any & (F.col("rule_severity") == "high")
    if model_pred is None:
        return df.select(
            "*",
            F.lit(0.0).alias("p_attack"),
            F.when(rule_high, "rule").when(rule_any, "rule").otherwise("none").alias("stage"),
            F.when(rule_high, "attack").when(rule_any, "suspicious").otherwise("benign").alias("verdict"),
            F.when(rule_high, F.lit("rule_blocked")).alias("family"),
            F.when(rule_high, 1.0).otherwise(0.0).alias("family_conf"),
            F.when(rule_any, "rule-only").otherwise("none").alias("final_source"),
            F.lit("benign").alias("ml_verdict"),
        ).withColumn("p_attack", F.when(rule_high, 1.0).otherwise(0.0))
    is_attack = F.col(model_pred) == 1
    ml_verdict = F.when(is_attack, "attack").otherwise("benign")
    verdict = (F.when(rule_high, "attack").when(rule_any & is_attack, "attack")
               .when(rule_any, "suspicious").otherwise(ml_verdict))
    return df.select(
        "*",
        F.when(rule_high, 1.0).when(is_attack, 1.0).otherwise(0.0).alias("p_attack"),
        F.when(rule_high, F.lit("rule")).when(rule_any & is_attack, F.col(model_stage))
        .when(rule_any, F.lit("rule")).otherwise(F.col(model_stage)).alias("stage"),
        verdict.alias("verdict"),
        F.when(rule_high, F.lit("rule_blocked")).when(verdict == "attack", F.lit("malicious")).alias("family"),
        F.when(rule_high | (verdict == "attack"), 1.0).otherwise(0.0).alias("family_conf"),
        F.when(rule_high, "rule-only").when(rule_any & is_attack, "both").when(rule_any, "rule-only")
        .when(is_attack, "ml-only").otherwise("none").alias("final_source"),
        F.when(rule_high, F.lit("benign")).otherwise(ml_verdict).alias("ml_verdict"),
    )
