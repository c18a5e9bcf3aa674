"""Registered queries: projections, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.functions import clean as C
from netwarden.operators.prefix import exact_percentiles
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.registry import register
from netwarden.plans.store import event_store
from netwarden.plans.q_search import BLOB_SQL

FLOW_COLS_PRESENT = ["IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS",
                     "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_PKTS", "SRC_TO_DST_AVG_THROUGHPUT",
                     "DST_TO_SRC_AVG_THROUGHPUT", "ICMP_TYPE", "ICMP_IPV4_TYPE", "DNS_QUERY_ID", "DNS_QUERY_TYPE",
                     "DNS_TTL_ANSWER"]

# SQL twins of the cleaning expressions (DuckDB casts double->int by
# rounding, so ``trunc`` first to match Python's int()).
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_sql(x):
    return STRIP.format(x=x)


def clean_sql(x):
    return f"lower({strip_sql(x)})"


def binarize_sql(x):
    s = clean_sql(x)
    return (f"CASE WHEN {s} IN ('benign','normal','0','false','f','no') THEN 0 "
            f"WHEN {s} IN ('attack','malicious','1','true','t','yes') THEN 1 "
            f"WHEN TRY_CAST({s} AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST({s} AS DOUBLE)) "
            f"THEN CASE WHEN TRY_CAST({s} AS DOUBLE) <> 0 THEN 1 ELSE 0 END ELSE 1 END")


def family_sql(x):
    s = clean_sql(x)
    parts = [f"WHEN {s} IN ('benign','normal') THEN 'Benign'"]
    for fam, words in C.FAMILY_KEYWORDS:
        cond = " OR ".join(f"contains({s}, '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{fam}'")
    return "CASE " + " ".join(parts) + " ELSE 'Other' END"


def proto_sql(x):
    s = f"lower({strip_sql(f'CAST({x} AS VARCHAR)')})"
    n = f"TRY_CAST(trunc(TRY_CAST({s} AS DOUBLE)) AS INT)"
    return (f"CASE WHEN {s} IN ('tcp','udp','icmp') THEN {s} WHEN {n} = 6 THEN 'tcp' WHEN {n} = 17 THEN 'udp' "
            f"WHEN {n} = 1 THEN 'icmp' WHEN {n} IS NOT NULL THEN CAST({n} AS VARCHAR) ELSE '' END")


def _flows(spark, sf_dir):
    return views.flows(spark, sf_dir)


@register("lower_columns", sql("""
SELECT flow_id AS flow_id, k AS k, IN_PKTS AS in_pkts, OUT_PKTS AS out_pkts, Label AS label, Attack AS attack
FROM flows""", "flows"))
def lower_columns(spark, sf_dir):
    """Lower-case column names."""
    return C.lower_columns(_flows(spark, sf_dir).select("flow_id", "K", "IN_PKTS", "OUT_PKTS", "Label", "Attack"))


@register("canonical_names", sql("""
SELECT flow_id AS "flow id", IN_PKTS AS "in pkts", FLOW_DURATION_MILLISECONDS AS "flow duration milliseconds",
       DNS_TTL_ANSWER AS "dns ttl answer" FROM flows""", "flows"))
def canonical_names(spark, sf_dir):
    """Strip / lower / '_' -> ' ' on names."""
    return C.canonical_names(_flows(spark, sf_dir).select("flow_id", "IN_PKTS", "FLOW_DURATION_MILLISECONDS",
                                                          "DNS_TTL_ANSWER"))


def _align_sql():
    cols = []
    for f in C.NETFLOW_FEATURES:
        cols.append(f"coalesce(TRY_CAST({f} AS DOUBLE), CAST(0.0 AS DOUBLE)) AS {f}" if f in FLOW_COLS_PRESENT
                    else f"CAST(0.0 AS DOUBLE) AS {f}")
    n_missing = len([f for f in C.NETFLOW_FEATURES if f not in FLOW_COLS_PRESENT])
    return sql(f"SELECT flow_id, {', '.join(cols)}, CAST({n_missing} AS INT) AS n_missing FROM flows", "flows")


@register("align_record", _align_sql())
def align_record(spark, sf_dir):
    """Project flows onto the 45-feature schema; missing -> 0.0, counted."""
    return C.align_record(_flows(spark, sf_dir), C.NETFLOW_FEATURES, keep=["flow_id"])


@register("extract_meta", sql("""
SELECT flow_id, PROTOCOL AS proto, src_ip, dst_ip, src_port, dst_port,
       coalesce(IN_PKTS, 0.0) + coalesce(OUT_PKTS, 0.0) AS pkts, coalesce(IN_BYTES, 0.0) + coalesce(OUT_BYTES, 0.0) AS bytes,
       FLOW_DURATION_MILLISECONDS AS dur_ms
FROM flows""", "flows"))
def extract_meta(spark, sf_dir):
    """B04 + B05: the meta struct built from alias lists, flattened."""
    fl = _flows(spark, sf_dir)
    return fl.select("flow_id", C.extract_meta(fl).alias("meta")).select("flow_id", "meta.*")


@register("alias_coalesce", sql("""
SELECT flow_id, coalesce(CASE WHEN trim(Label) NOT IN ('None', '', 'NA', 'N/A') THEN Label END,
                         CASE WHEN trim(Attack) NOT IN ('None', '', 'NA', 'N/A') THEN Attack END) AS label_any
FROM flows""", "flows"))
def alias_coalesce(spark, sf_dir):
    """First usable value among aliases (exact name, then normalised)."""
    fl = _flows(spark, sf_dir)
    return fl.select("flow_id", C.alias_coalesce(fl, ["label", "_Attack"]).alias("label_any"))


@register("clean_label", sql(f"SELECT flow_id, Label, {clean_sql('Label')} AS label_clean FROM flows", "flows"))
def clean_label(spark, sf_dir):
    """Strip + lower."""
    return _flows(spark, sf_dir).select("flow_id", "Label", C.clean_label("Label").alias("label_clean"))


@register("benign_flag", sql(f"""
SELECT flow_id, CAST({clean_sql('Label')} IN ('benign','normal','0') AS INT) AS is_benign FROM flows""", "flows"))
def benign_flag(spark, sf_dir):
    """Benign / normal / 0."""
    return _flows(spark, sf_dir).select("flow_id", C.benign_flag("Label").alias("is_benign"))


@register("binarize_label", sql(f"SELECT flow_id, Label, {binarize_sql('Label')} AS y_bin FROM flows", "flows"))
def binarize_label(spark, sf_dir):
    """Token sets, numbers, anything else -> 1."""
    return _flows(spark, sf_dir).select("flow_id", "Label", C.binarize_label("Label").alias("y_bin"))


@register("attack_family", sql(f"""
SELECT Attack, {family_sql('Attack')} AS family, count(*) AS n FROM flows GROUP BY 1, 2""", "flows"))
def attack_family(spark, sf_dir):
    """Keyword families (grouped to one row per attack name)."""
    fl = _flows(spark, sf_dir)
    return fl.groupBy("Attack", C.attack_family("Attack").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def _map_values_sql():
    return ", ".join(f"('{k}', '{v}')" for k, v in sorted(C.FAMILY_MAP.items()))


@register("family_lookup", sql(f"""
SELECT f.flow_id, f.Attack, coalesce(m.family, 'Other') AS family
FROM flows f LEFT JOIN (VALUES {_map_values_sql()}) m(attack, family) ON f.Attack = m.attack""", "flows"))
def family_lookup(spark, sf_dir):
    """Broadcast dictionary join, default Other."""
    return C.family_lookup(_flows(spark, sf_dir).select("flow_id", "Attack"))


@register("family_no_benign", sql(f"""
SELECT flow_id, CASE WHEN {family_sql('Attack')} = 'Benign' THEN 'Other' ELSE {family_sql('Attack')} END AS family
FROM flows WHERE {binarize_sql('Label')} = 1""", "flows"))
def family_no_benign(spark, sf_dir):
    """Inside attack rows Benign becomes Other."""
    fl = _flows(spark, sf_dir).where(C.binarize_label("Label") == 1)
    return fl.select("flow_id", C.family_no_benign(C.attack_family("Attack")).alias("family"))


@register("coerce_numeric", sql("SELECT flow_id, Label, TRY_CAST(Label AS DOUBLE) AS label_num FROM flows", "flows"))
def coerce_numeric(spark, sf_dir):
    """Non-numeric -> NaN; SQL-facing output shows NaN as NULL."""
    fl = _flows(spark, sf_dir)
    v = C.coerce_numeric("Label")
    return fl.select("flow_id", "Label", F.when(~F.isnan(v), v).alias("label_num"))


@register("inf_nan_to_zero", sql("""
SELECT flow_id, CASE WHEN FLOW_DURATION_MILLISECONDS <> 0 THEN IN_BYTES / FLOW_DURATION_MILLISECONDS
                      ELSE 0.0 END AS bytes_per_ms
FROM flows""", "flows"))
def inf_nan_to_zero(spark, sf_dir):
    """Numpy-style ratio (x/0 -> inf, 0/0 -> NaN) cleaned to 0."""
    fl = _flows(spark, sf_dir)
    r = C.inf_nan_to_zero(C.np_divide("IN_BYTES", "FLOW_DURATION_MILLISECONDS"))
    return fl.select("flow_id", r.alias("bytes_per_ms"))


@register("median_impute", sql("""
SELECT flow_id, coalesce(TRY_CAST(Label AS DOUBLE), (SELECT quantile_cont(TRY_CAST(Label AS DOUBLE), 0.5) FROM flows))
       AS label_imputed FROM flows""", "flows"))
def median_impute(spark, sf_dir):
    """Fill missing with the exact global median (distributed order statistic)."""
    fl = _flows(spark, sf_dir).select("flow_id", F.expr("try_cast(Label as double)").alias("v"))
    med = exact_percentiles(fl, "v", [0.5]).select(F.col("value").alias("_med"))
    from netwarden.functions.scalars import attach_scalars
    return attach_scalars(fl, med).select("flow_id", F.coalesce("v", "_med").alias("label_imputed"))


@register("drop_identifier_features", sql("""
SELECT epoch_us(ts) / 1e6 AS ts, y, x, k, IN_PKTS, OUT_PKTS, IN_BYTES, OUT_BYTES, FLOW_DURATION_MILLISECONDS, RETRANSMITTED_IN_PKTS,
  RETRANSMITTED_OUT_PKTS, ICMP_TYPE, ICMP_IPV4_TYPE, DNS_QUERY_ID, DNS_QUERY_TYPE, DNS_TTL_ANSWER, p_model,
  recon_error, SRC_TO_DST_AVG_THROUGHPUT, DST_TO_SRC_AVG_THROUGHPUT
FROM flows""", "flows"))
def drop_identifier_features(spark, sf_dir):
    """Drop ids, addresses, ports, protocol, attack and label by normalised name
    (time reported as epoch seconds)."""
    out = C.drop_identifier_features(_flows(spark, sf_dir))
    return out.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@register("proto_name", sql(f"""
SELECT flow_id, {proto_sql('PROTOCOL')} AS proto, {proto_sql('Label')} AS label_as_proto FROM flows""", "flows"))
def proto_name(spark, sf_dir):
    """Protocol names from numbers or strings; junk -> ''."""
    return _flows(spark, sf_dir).select("flow_id", C.proto_name("PROTOCOL").alias("proto"),
                                        C.proto_name("Label").alias("label_as_proto"))


@register("safe_int", sql(f"""
SELECT flow_id,
  CAST(CASE WHEN regexp_full_match({strip_sql("concat(CAST(dst_port AS VARCHAR), '.0')")}, '[+-]?[0-9]+')
       THEN TRY_CAST({strip_sql("concat(CAST(dst_port AS VARCHAR), '.0')")} AS INT) END AS DOUBLE) AS port_search,
  coalesce(TRY_CAST(trunc(TRY_CAST(concat(CAST(dst_port AS VARCHAR), '.0') AS DOUBLE)) AS INT), -1) AS port_rule,
  CAST(TRY_CAST(trunc(TRY_CAST(Label AS DOUBLE)) AS INT) AS DOUBLE) AS label_meta,
  CAST(CASE WHEN regexp_full_match({strip_sql('Label')}, '[+-]?[0-9]+') THEN TRY_CAST({strip_sql('Label')} AS INT) END
       AS DOUBLE) AS label_search
FROM flows""", "flows"))
def safe_int(spark, sf_dir):
    """The three int parsers ('53.0' is null for search, 53 for rules)."""
    fl = _flows(spark, sf_dir)
    p = F.concat(F.col("dst_port").cast("string"), F.lit(".0"))
    # nullable ints are returned as double so that both engines hand the
    # same dtype to the comparison
    return fl.select("flow_id", C.safe_int_search(p).cast("double").alias("port_search"),
                     C.safe_int_rule(p).alias("port_rule"),
                     C.safe_int_meta("Label").cast("double").alias("label_meta"),
                     C.safe_int_search("Label").cast("double").alias("label_search"))


@register("throughput", sql("""
SELECT flow_id, IN_BYTES / greatest(0.000001, FLOW_DURATION_MILLISECONDS / 1000.0) AS thr_in,
       OUT_BYTES / greatest(0.000001, FLOW_DURATION_MILLISECONDS / 1000.0) AS thr_out
FROM flows""", "flows"))
def throughput(spark, sf_dir):
    """Bytes / max(1e-6, seconds)."""
    fl = _flows(spark, sf_dir)
    return fl.select("flow_id", C.throughput("IN_BYTES", "FLOW_DURATION_MILLISECONDS").alias("thr_in"),
                     C.throughput("OUT_BYTES", "FLOW_DURATION_MILLISECONDS").alias("thr_out"))


@register("sigmoid_clip", sql("""
SELECT flow_id, round(1.0 / (1.0 + exp(-(p_model * 10 - 5))), 6) AS sig,
       round(least(greatest(recon_error * 100, 0.8), 1.0), 6) AS clipped FROM flows""", "flows"))
def sigmoid_clip(spark, sf_dir):
    """B26 + B27: sigmoid of a decision value, clip to [0.8, 1]."""
    fl = _flows(spark, sf_dir)
    return fl.select("flow_id", F.round(C.sigmoid(F.col("p_model") * 10 - 5), 6).alias("sig"),
                     F.round(C.clip(F.col("recon_error") * 100), 6).alias("clipped"))


@register("probability_band", sql("""
SELECT flow_id, CASE WHEN p_model < 0.2 THEN 'low' WHEN p_model <= 0.95 THEN 'mid' WHEN p_model > 0.95 THEN 'high' END
       AS band FROM flows""", "flows"))
def probability_band(spark, sf_dir):
    """Low / mid / high with an inclusive mid band."""
    return _flows(spark, sf_dir).select("flow_id", C.probability_band("p_model").alias("band"))


@register("search_blob", sql(f"SELECT flow_id, {BLOB_SQL} AS blob FROM events_scored", "events_scored"))
def search_blob(spark, sf_dir):
    """Lower-cased search text of an event."""
    from netwarden.operators.search import blob
    return event_store(spark, sf_dir).select("flow_id", blob().alias("blob"))
