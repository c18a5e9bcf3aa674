"""Cleaning and scalar functions (B01-B33) as built-in Column expressions.

ANSI mode is on, so a plain cast of a malformed string raises; every
parse here goes through ``try_cast``.  Python's ``str.strip()`` removes
all whitespace, so trimming uses a regular expression.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the two label classes.
BENIGN_TOKENS = ["benign", "normal", "0", "false", "f", "no"]
ATTACK_TOKENS = ["attack", "malicious", "1", "true", "t", "yes"]
BENIGN_FLAG_TOKENS = ["benign", "normal", "0"]
NULL_TOKENS = ["None", "", "NA", "N/A"]

# Ordered keyword rules attack name -> family (first match wins).
FAMILY_KEYWORDS = [
    ("DDoS", ["ddos", "hoic", "loic"]),
    ("DoS", ["dos", "hulk", "goldeneye", "slowloris", "slowhttptest"]),
    ("BruteForce", ["brute", "bruteforce", "ssh", "ftp"]),
    ("WebAttack", ["xss", "sql", "injection", "web"]),
    ("Bot", ["bot"]),
    ("Infiltration", ["infil"]),
]

# The attack -> family file shipped with the reference.
FAMILY_MAP = {
    "Benign": "Benign",
    "Bot": "Bot",
    "Brute_Force_-Web": "BruteForce",
    "Brute_Force_-XSS": "BruteForce",
    "DDOS_attack-HOIC": "DDoS",
    "DDOS_attack-LOIC-UDP": "DDoS",
    "DDoS_attacks-LOIC-HTTP": "DDoS",
    "DoS_attacks-GoldenEye": "DoS",
    "DoS_attacks-Hulk": "DoS",
    "DoS_attacks-SlowHTTPTest": "DoS",
    "DoS_attacks-Slowloris": "DoS",
    "FTP-BruteForce": "BruteForce",
    "Infilteration": "Infiltration",
    "SQL_Injection": "WebAttack",
    "SSH-Bruteforce": "BruteForce",
}

# The 45 NetFlow-v3 features of the binary schema, in order.
NETFLOW_FEATURES = [
    "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS",
    "FLOW_DURATION_MILLISECONDS",
    "TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS",
    "DURATION_IN", "DURATION_OUT",
    "MIN_TTL", "MAX_TTL",
    "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT",
    "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN",
    "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES",
    "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS",
    "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS",
    "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT",
    "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES",
    "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES",
    "NUM_PKTS_1024_TO_1514_BYTES",
    "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT",
    "ICMP_TYPE", "ICMP_IPV4_TYPE",
    "DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER",
    "FTP_COMMAND_RET_CODE",
    "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV",
    "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV",
]

# Name fragments of identifier columns dropped before training.
IDENTIFIER_NAMES = ["flow id", "src ip", "source ip", "dst ip", "destination ip", "src port", "source port",
                    "dst port", "destination port", "timestamp", "protocol", "attack", "label"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names (B01, B02, B16, B17) -------------------------------------------

def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case all column names; refuse collisions."""
    low = [c.lower() for c in df.columns]
    if len(set(low)) != len(low):
        raise ValueError("lower-casing would merge columns")
    return df.toDF(*low)


def canonical_name(name: str) -> str:
    """Strip, lower, ``_`` -> space (``'Bwd_IAT_Max'`` == ``' Bwd IAT Max'``)."""
    return name.strip().lower().replace("_", " ")


def canonical_names(df: DataFrame) -> DataFrame:
    names = [canonical_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("canonical names collide")
    return df.toDF(*names)


def common_numeric_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Numeric columns present in both frames (first frame's order)."""
    num = ("int", "bigint", "double", "float", "smallint", "tinyint")
    bn = {n for n, t in b.dtypes if t in num or t.startswith("decimal")}
    return [n for n, t in a.dtypes if (t in num or t.startswith("decimal")) and n in bn]


def drop_identifier_features(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Drop ids, addresses, ports, time, protocol, attack and label by
    normalised name."""
    targets = set(IDENTIFIER_NAMES) | {canonical_name(e) for e in extra}
    keep = [c for c in df.columns if canonical_name(c) not in targets]
    return df.select(*keep)


# --- labels (B06-B12) ------------------------------------------------------

def find_label_column(df: DataFrame, candidates: Sequence[str] = ("label", "class", "type")) -> str:
    """First of ``label/class/type`` (case-insensitive)."""
    low = {c.lower(): c for c in df.columns}
    for cand in candidates:
        if cand in low:
            return low[cand]
    raise ValueError(f"no label column among {list(candidates)}")


def pystrip(c) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace."""
    return F.regexp_replace(_c(c).cast("string"), r"^\s+|\s+$", "")


def clean_label(c) -> Column:
    """``str(x).strip().lower()``."""
    return F.lower(pystrip(c))


def benign_flag(c) -> Column:
    """1 when the cleaned label is benign/normal/0."""
    return clean_label(c).isin(*BENIGN_FLAG_TOKENS).cast("int")


def binarize_label(c) -> Column:
    """Benign tokens -> 0, attack tokens -> 1, numbers -> (v != 0),
    anything else (including 'nan') -> 1."""
    s = clean_label(c)
    v = s.try_cast("double")
    return F.when(s.isin(*BENIGN_TOKENS), 0).when(s.isin(*ATTACK_TOKENS), 1) \
            .when(v.isNotNull() & ~F.isnan(v), F.when(v != 0, 1).otherwise(0)).otherwise(1)


def attack_family(c) -> Column:
    """Keyword family of an attack name, first match wins."""
    s = clean_label(c)
    expr = F.when(s.isin("benign", "normal"), F.lit("Benign"))
    for fam, words in FAMILY_KEYWORDS:
        cond = None
        for w in words:
            cw = s.contains(w)
            cond = cw if cond is None else (cond | cw)
        expr = expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit("Other"))


def family_map_frame(spark, mapping: dict | None = None) -> DataFrame:
    mapping = FAMILY_MAP if mapping is None else mapping
    return spark.createDataFrame(sorted(mapping.items()), "attack string, family string")


def family_lookup(df: DataFrame, attack: str = "Attack", mapping: dict | None = None,
                  out: str = "family") -> DataFrame:
    """Explicit attack -> family map, default ``Other``.

    The map has one row per attack name (bounded by the label vocabulary),
    so it is broadcast; the big side never shuffles."""
    m = family_map_frame(df.sparkSession, mapping).withColumnRenamed("family", "_fam")
    j = df.join(F.broadcast(m), df[attack] == m["attack"], "left")
    return j.select(*[df[c] for c in df.columns], F.coalesce(F.col("_fam"), F.lit("Other")).alias(out))


def family_no_benign(c) -> Column:
    """Inside attack rows the family ``Benign`` becomes ``Other``."""
    return F.when(_c(c) == "Benign", F.lit("Other")).otherwise(_c(c))


# --- numbers (B13-B15, B18-B20, B25-B27) -----------------------------------

def coerce_numeric(c, nan_as_null: bool = False) -> Column:
    """Non-numeric cell -> NaN (or null)."""
    v = F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else c.try_cast("double")
    return v if nan_as_null else F.coalesce(v, F.lit(float("nan")))


def np_divide(a, b) -> Column:
    """IEEE division as numpy/pandas do it (x/0 -> +-inf, 0/0 -> NaN); the
    source of the inf values that B14 cleans."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, a / b).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))) \
            .otherwise(F.lit(float("nan")))


def inf_nan_to_zero(c) -> Column:
    """Inf, -inf, NaN (and null) -> 0."""
    x = _c(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def proto_name(c) -> Column:
    """tcp/udp/icmp pass; 6/17/1 (also '6.0') -> name; other numbers ->
    their integer text; junk -> ''."""
    s = F.lower(pystrip(_c(c).cast("string")))
    n = s.try_cast("double").try_cast("int")
    return F.when(s.isin("tcp", "udp", "icmp"), s).when(n == 6, "tcp").when(n == 17, "udp") \
            .when(n == 1, "icmp").when(n.isNotNull(), n.cast("string")).otherwise(F.lit(""))


def safe_int_search(c) -> Column:
    """B20 (search variant): ``int(str(x).strip())``; '53.0' -> null."""
    return pystrip(_c(c).cast("string")).try_cast("int")


def safe_int_rule(c, default: int = -1) -> Column:
    """B20 (rule variant): ``int(float(v))`` truncating, else default."""
    return F.coalesce(_c(c).cast("string").try_cast("double").try_cast("int"), F.lit(default))


def safe_int_meta(c) -> Column:
    """B20 (meta variant): ``int(float(x))``, else null."""
    return _c(c).cast("string").try_cast("double").try_cast("int")


def safe_float(c) -> Column:
    return _c(c).cast("string").try_cast("double")


def throughput(bytes_col, ms_col) -> Column:
    """Bytes / max(1e-6, ms / 1000)."""
    return _c(bytes_col) / F.greatest(F.lit(0.000001), _c(ms_col) / F.lit(1000.0))


def sigmoid(c) -> Column:
    """B26."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def clip(c, lo: float = 0.8, hi: float = 1.0) -> Column:
    """B27."""
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def probability_band(p, lo: float = 0.2, hi: float = 0.95) -> Column:
    """P < lo low; lo <= p <= hi mid; p > hi high."""
    p = _c(p)
    return F.when(p < lo, "low").when(p <= hi, "mid").when(p > hi, "high")


# --- aliases and meta (B03-B05, B28-B30) ----------------------------------

def _norm_alias(name: str) -> str:
    return name.strip().lower().lstrip("_")


def resolve_alias(df: DataFrame, aliases: Sequence[str]) -> list[str]:
    """Driver-side alias resolution against the schema: exact names first,
    then names normalised by strip/lower/lstrip('_')."""
    out = [a for a in aliases if a in df.columns]
    norm = {}
    for c in df.columns:
        norm.setdefault(_norm_alias(c), c)
    for a in aliases:
        c = norm.get(_norm_alias(a))
        if c is not None and c not in out:
            out.append(c)
    return out


def alias_coalesce(df: DataFrame, aliases: Sequence[str]) -> Column:
    """First non-null, non-null-token value among the alias columns."""
    cols = resolve_alias(df, aliases)
    if not cols:
        return F.lit(None).cast("string")
    vals = [F.when(~F.trim(F.col(c).cast("string")).isin(*NULL_TOKENS), F.col(c).cast("string")) for c in cols]
    return F.coalesce(*vals)


# Alias lists used to build the event ``meta`` struct.
META_ALIASES = {
    "proto": ["PROTOCOL", "protocol", "proto", "L4_PROTO"],
    "src_ip": ["IPV4_SRC_ADDR", "src_ip", "SRC_IP", "Src IP", "source_ip"],
    "dst_ip": ["IPV4_DST_ADDR", "dst_ip", "DST_IP", "Dst IP", "destination_ip"],
    "src_port": ["L4_SRC_PORT", "src_port", "SRC_PORT", "Src Port", "sport"],
    "dst_port": ["L4_DST_PORT", "dst_port", "DST_PORT", "Dst Port", "dport"],
    "pkts_in": ["IN_PKTS", "in_pkts"],
    "pkts_out": ["OUT_PKTS", "out_pkts"],
    "bytes_in": ["IN_BYTES", "in_bytes"],
    "bytes_out": ["OUT_BYTES", "out_bytes"],
    "dur_ms": ["FLOW_DURATION_MILLISECONDS", "flow_duration_milliseconds", "dur_ms"],
}


def extract_meta(df: DataFrame) -> Column:
    """``meta`` struct; ``pkts``/``bytes`` default 0, the rest null."""
    a = {k: alias_coalesce(df, v) for k, v in META_ALIASES.items()}
    f0 = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.struct(
        safe_int_meta(a["proto"]).alias("proto"), a["src_ip"].alias("src_ip"), a["dst_ip"].alias("dst_ip"),
        safe_int_meta(a["src_port"]).alias("src_port"), safe_int_meta(a["dst_port"]).alias("dst_port"),
        (f0(a["pkts_in"]) + f0(a["pkts_out"])).alias("pkts"),
        (f0(a["bytes_in"]) + f0(a["bytes_out"])).alias("bytes"),
        a["dur_ms"].try_cast("double").alias("dur_ms"),
    )


def align_record(df: DataFrame, features: Sequence[str], out_missing: str = "n_missing",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Project onto an ordered feature list; names are matched after
    B02 normalisation, missing or unparsable -> 0.0 (counted), extras dropped."""
    canon = {}
    for c in df.columns:
        canon.setdefault(canonical_name(c), c)
    cols, missing = [], []
    for f in features:
        src = canon.get(canonical_name(f))
        if src is None:
            cols.append(F.lit(0.0).alias(f))
            missing.append(F.lit(1))
        else:
            v = F.col(src).cast("string").try_cast("double")
            cols.append(F.coalesce(v, F.lit(0.0)).alias(f))
            missing.append(F.when(v.isNull(), 1).otherwise(0))
    n_missing = sum(missing[1:], missing[0]) if missing else F.lit(0)
    return df.select(*keep, *cols, n_missing.cast("int").alias(out_missing))


def rule_name(rule_info: Column) -> Column:
    """``rule_info.rule or rule_info.name`` else ''."""
    return F.coalesce(rule_info, F.lit(""))
