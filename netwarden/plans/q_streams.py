"""Registered queries: the streaming path (S01-S13), run with ``availableNow``
over the given events file and compared with the batch SQL.

Each query starts its stream, waits until the available input is drained,
and returns the table the stream wrote under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.q_sources import FLOW_CUT_SQL
from netwarden.plans.registry import register
from netwarden.session import checkpoint_dir
from netwarden.sources.tables import read_table, table_path
from netwarden.streaming import online as S

LOW, HIGH = views.FIXTURE_ROUTE_LOW, views.FIXTURE_ROUTE_HIGH
KEEP = 300
DELAY_S = 3600.0


def _flows(spark, sf_dir) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    path = table_path(sf_dir, "events")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        # the file source watches folders: this table is one file of its folder
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
            "pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = S.flow_stream(spark, path, schema)
    return views.flows_of(stream.select(*views.EVENT_COLUMNS))


def _place(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _drain(df: DataFrame, name: str) -> DataFrame:
    """Append the stream to a Parquet table and return it."""
    spark = df.sparkSession
    at = _place(spark, name)
    q = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state")
         .trigger(**S.trigger_options(available_now=True)).start(f"{at}/out"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _sink(df: DataFrame, name: str, make, mode: str = "append") -> str:
    """Run the stream through a ``foreachBatch`` sink; ``make`` gets the folder."""
    at = _place(df.sparkSession, name)
    q = (df.writeStream.foreachBatch(make(at)).outputMode(mode).option("checkpointLocation", f"{at}/state")
         .trigger(**S.trigger_options(available_now=True)).start())
    q.awaitTermination()
    return at


def _final(df: DataFrame, name: str) -> DataFrame:
    """The last complete result of an aggregating stream."""
    at = _sink(df, name, lambda p: lambda b, i: S._write_batch(b, f"{p}/out", i), "complete")
    done = S._committed(df.sparkSession, f"{at}/out")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out/batch={done[-1]}")


@register("stream_score", sql("SELECT flow_id, verdict, stage, rule_name FROM events_scored", "events_scored"))
def stream_score(spark, sf_dir):
    """Scoring of arriving flows."""
    return _drain(views.scored_of(_flows(spark, sf_dir)).select("flow_id", "verdict", "stage", "rule_name"), "score")


@register("stream_interesting", sql(
    "SELECT flow_id FROM events_scored WHERE verdict IN ('suspicious', 'attack') OR stage = 'rule'", "events_scored"))
def stream_interesting(spark, sf_dir):
    """The side stream of interesting events."""
    return _drain(S.interesting_stream(views.scored_of(_flows(spark, sf_dir))).select("flow_id"), "interesting")


@register("stream_verdict_counters", sql(
    "SELECT coalesce(verdict, 'unknown') AS verdict, count(*) AS n FROM events_scored GROUP BY 1", "events_scored"))
def stream_verdict_counters(spark, sf_dir):
    """Running counts per verdict."""
    return _final(S.verdict_counters(views.scored_of(_flows(spark, sf_dir))), "counters")


_MINUTES = """
SELECT epoch_us(date_trunc('minute', ts)) / 1e6 AS minute, count(*) FILTER (WHERE verdict = 'benign') AS benign,
       count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious, count(*) FILTER (WHERE verdict = 'attack') AS attack
FROM events_scored GROUP BY 1"""


@register("stream_per_minute", sql(_MINUTES, "events_scored"))
def stream_per_minute(spark, sf_dir):
    """Tumbling one-minute counts per verdict."""
    out = _final(S.per_minute_counts(views.scored_of(_flows(spark, sf_dir))), "minutes")
    return out.select((F.unix_micros("minute") / 1e6).alias("minute"), "benign", "suspicious", "attack")


@register("stream_sliding", sql("""
WITH w AS (SELECT verdict, unnest([0, 60, 120, 180, 240]) AS back, date_trunc('minute', ts) AS m FROM events_scored)
SELECT epoch_us(m - to_seconds(back)) / 1e6 AS start_s, count(*) FILTER (WHERE verdict = 'benign') AS benign,
       count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious, count(*) FILTER (WHERE verdict = 'attack') AS attack
FROM w GROUP BY 1""", "events_scored"))
def stream_sliding(spark, sf_dir):
    """Five-minute windows sliding by one minute."""
    out = _final(S.sliding_counts(views.scored_of(_flows(spark, sf_dir))), "sliding")
    return out.select((F.unix_micros("start") / 1e6).alias("start_s"), "benign", "suspicious", "attack")


TRAILING = (5, 15, 60, 1440)
_PANES = _MINUTES.replace("epoch_us(date_trunc('minute', ts)) / 1e6", "CAST(epoch_us(date_trunc('minute', ts)) // 1000000 AS BIGINT)")
_VIEWS = ", ".join(f"CAST(sum({c}) OVER (ORDER BY minute RANGE BETWEEN {60 * (m - 1)} PRECEDING AND CURRENT ROW) AS BIGINT) AS {c}_{m}"
                   for m in TRAILING for c in S.VERDICTS)


@register("stream_trailing", sql(f"WITH p AS ({_PANES}) SELECT minute AS minute_s, {_VIEWS} FROM p", "events_scored"))
def stream_trailing(spark, sf_dir):
    """Trailing 5 m, 15 m, 1 h and 24 h views of every minute, from one
    stream of one-minute panes."""
    return S.trailing_counts(_final(S.per_minute_counts(views.scored_of(_flows(spark, sf_dir))), "panes"), TRAILING)


@register("stream_retention", sql(f"SELECT flow_id FROM flows ORDER BY flow_id DESC LIMIT {KEEP}", "flows"))
def stream_retention(spark, sf_dir):
    """The newest rows kept in a table (the limit is the feature)."""
    at = _sink(_flows(spark, sf_dir).select("flow_id"), "retention", lambda p: S.retention_sink(f"{p}/out", KEEP, "flow_id"))
    return S.retained(spark, f"{at}/out")


@register("stream_split", sql("""
WITH r AS (SELECT flow_id AS row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || flow_id), flow_id) AS k,
                  count(*) OVER (PARTITION BY y) AS n FROM flows)
SELECT row_id, CAST(y AS VARCHAR) AS label, CASE WHEN k <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM r""",
                                "flows"))
def stream_split(spark, sf_dir):
    """Exact stratified split of the stream by the counting pass's cuts."""
    rows = views.flows(spark, sf_dir).select(F.col("flow_id").alias("row_id"), "y")
    cuts = S.split_cuts(rows, "y", 0.2)
    return _drain(S.stratified_split_stream(_flows(spark, sf_dir).withColumnRenamed("flow_id", "row_id"), "y", cuts), "split")


# The replayed arrival order: a row arrives up to JITTER_S after its event
# time, and the table comes in BATCHES micro-batches.
BATCHES, JITTER_S = 6, 7200
ARRIVALS_SQL = f"""
  SELECT *, epoch_us(ts) AS u, epoch_us(ts) + (flow_id * 7919) % 1000 * {JITTER_S * 1000} AS arrival FROM flows"""
BATCHES_SQL = f"""
  SELECT *, CAST(floor((arrival - (SELECT min(arrival) FROM a)) * {BATCHES}
                       / ((SELECT max(arrival) - min(arrival) FROM a) + 1)) AS INTEGER) AS b FROM a"""


def _replayed(spark, sf_dir, name, *columns) -> DataFrame:
    rows = views.flows(spark, sf_dir).select("flow_id", "ts", *columns)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return S.replay_arrivals(rows, f"{_place(spark, name)}/in", us + F.col("flow_id") * 7919 % 1000 * (JITTER_S * 1000),
                             ["flow_id"], BATCHES)


# A key's state is written with the first row of its batch, expires DEDUPE_S
# after that row's time and is dropped at the end of a batch whose watermark (of
# the batches before it) has reached the expiry.
DEDUPE_S = 2 * 86400
_DEDUPE = f"""
WITH RECURSIVE a AS ({ARRIVALS_SQL}), r AS ({BATCHES_SQL}),
w AS (SELECT n.b, (SELECT max(u) FROM r WHERE r.b < n.b) // 1000 * 1000 - {DEDUPE_S * 1_000_000} AS wm FROM generate_series(0, {BATCHES - 1}) n(b)),
f AS (SELECT b, src_ip, arg_min(u, (arrival, flow_id)) AS u FROM r GROUP BY 1, 2),
g AS (SELECT k.src_ip, w.b, w.wm, f.u FROM (SELECT DISTINCT src_ip FROM r) k CROSS JOIN w LEFT JOIN f ON f.src_ip = k.src_ip AND f.b = w.b),
s(src_ip, b, expires, sent) AS (
  SELECT src_ip, CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), false FROM r GROUP BY 1
  UNION ALL
  SELECT src_ip, b, CASE WHEN e <= coalesce(wm, e - 1) THEN NULL ELSE e END, sent
  FROM (SELECT g.src_ip, g.b, g.wm, coalesce(s.expires, g.u + {DEDUPE_S * 1_000_000}) AS e, s.expires IS NULL AND g.u IS NOT NULL AS sent
        FROM s JOIN g ON g.src_ip = s.src_ip AND g.b = s.b + 1) x)
SELECT src_ip, count(*) AS alerts FROM s WHERE sent GROUP BY 1"""


def recursive(body: str, *needs: str) -> str:
    """``sql`` for a body that begins with WITH RECURSIVE."""
    return sql(body.replace("WITH RECURSIVE", "WITH", 1), *needs).replace("WITH", "WITH RECURSIVE", 1)


@register("stream_dedupe", recursive(_DEDUPE, "flows"))
def stream_dedupe(spark, sf_dir):
    """Alerts per source when an alert silences its source for two days of
    event time: keys expire with the watermark and come again."""
    out = S.dedupe_alerts(_replayed(spark, sf_dir, "dedupe-in", "src_ip"), "src_ip", watermark=f"{DEDUPE_S} seconds")
    return _drain(out.select("src_ip"), "dedupe").groupBy("src_ip").agg(F.count(F.lit(1)).alias("alerts"))


@register("stream_thresholds", sql(f"""
SELECT flow_id, CASE WHEN recon_error >= {HIGH} THEN 'block' WHEN recon_error >= {LOW} THEN 'tuned' ELSE 'standard' END AS route
FROM flows""", "flows"))
def stream_thresholds(spark, sf_dir):
    """Routes by thresholds that each batch reads from a table."""
    config = f"{_place(spark, 'config')}/thresholds"
    spark.createDataFrame([(LOW, HIGH)], "tau_low double, tau_high double").write.parquet(config)
    at = _sink(_flows(spark, sf_dir).select("flow_id", "recon_error", "p_model"), "routes",
               lambda p: S.threshold_reloading_sink(config, f"{p}/out"))
    return spark.read.parquet(f"{at}/out").select("flow_id", "route")


@register("stream_late_rows", sql(f"""
WITH a AS ({ARRIVALS_SQL}), r AS ({BATCHES_SQL}),
m AS (SELECT b, max(max(u)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r GROUP BY b)
SELECT flow_id, CASE WHEN u / 1e6 < seen / 1e6 - {DELAY_S} THEN 'late' ELSE 'on time' END AS arrival FROM r JOIN m USING (b)""", "flows"))
def stream_late_rows(spark, sf_dir):
    """Rows older than the bound that earlier batches set go to the side table."""
    at = _sink(_replayed(spark, sf_dir, "late-in"), "late", lambda p: S.late_data_sink(f"{p}/on", f"{p}/late", DELAY_S))
    sides = [spark.read.parquet(f"{at}/{d}").select("flow_id", F.lit(name).alias("arrival"))
             for d, name in (("on", "on time"), ("late", "late"))]
    return sides[0].unionByName(sides[1])


def _stateful(make, name: str) -> DataFrame:
    """Drain a stream whose state lives in RocksDB (the setting is put back)."""
    df = make()
    conf, key = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(key)
    conf.set(key, S.ROCKSDB)
    try:
        return _drain(df, name)
    finally:
        conf.set(key, old)


FLOW_IDLE_S, FLOW_ACTIVE_S = 5 * 86400.0, 6 * 86400.0
_PAIR_FLOWS = recursive(FLOW_CUT_SQL.lstrip().format(key="src_ip || '|' || dst_ip", table="flows", idle=int(FLOW_IDLE_S * 1e6),
                                                     active=int(FLOW_ACTIVE_S * 1e6)), "flows")


@register("stream_flows", f"""
SELECT key, first_seen_s, last_seen_s, packets FROM ({_PAIR_FLOWS}) z
QUALIFY least(last_seen_s + {FLOW_IDLE_S}, lead(first_seen_s) OVER (PARTITION BY key ORDER BY flow_no))
        < (SELECT epoch_us(max(ts)) // 1000 / 1e3 FROM events) - {JITTER_S}""")
def stream_flows(spark, sf_dir):
    """Flows of host pairs, idle and active timeout, from several
    micro-batches in a shuffled arrival order; those closed by the last
    watermark or by a packet it has passed."""
    ev = _replayed(spark, sf_dir, "flows-in", "src_ip", "dst_ip").withColumn("pair", F.concat_ws("|", "src_ip", "dst_ip"))
    out = _stateful(lambda: S.assemble_flows_stream(ev, "pair", "ts", FLOW_IDLE_S, FLOW_ACTIVE_S, f"{JITTER_S} seconds"), "flows")
    return out.select("key", F.round(F.col("first_us") / 1e6, 6).alias("first_seen_s"),
                      F.round(F.col("last_us") / 1e6, 6).alias("last_seen_s"), "packets")


SENDER_ITEMS, SENDER_S = 10, 86400
_SENDER = f"""
WITH RECURSIVE x AS (SELECT src_ip AS key, flow_id, epoch_us(ts) AS u, row_number() OVER (PARTITION BY src_ip ORDER BY ts, flow_id) AS p FROM flows),
e(key, p, u) AS (
  SELECT key, CAST(0 AS BIGINT), min(u) FROM x GROUP BY key
  UNION ALL
  SELECT e.key, arg_min(x.p, x.p), arg_min(x.u, x.p) FROM e
  JOIN x ON x.key = e.key AND x.p > e.p AND (x.p - e.p >= {SENDER_ITEMS} OR x.u - e.u >= {SENDER_S * 1_000_000}) GROUP BY e.key),
n AS (SELECT key, p, lead(p) OVER w AS stop, row_number() OVER w - 1 AS batch_id FROM e WINDOW w AS (PARTITION BY key ORDER BY p))
SELECT x.key, x.flow_id AS id, n.batch_id FROM x JOIN n ON n.key = x.key AND x.p > n.p AND (n.stop IS NULL OR x.p <= n.stop)
WHERE x.u < (SELECT max(u) FROM x) // 1000 * 1000 - {JITTER_S * 1_000_000}"""


@register("stream_micro_batches", recursive(_SENDER, "flows"))
def stream_micro_batches(spark, sf_dir):
    """Batches of every sender that close after N rows or T seconds,
    whichever comes first (rows that the last watermark passed)."""
    rows = _replayed(spark, sf_dir, "batches-in", "src_ip")
    return _stateful(lambda: S.micro_batches_stream(rows, "src_ip", "flow_id", SENDER_ITEMS, SENDER_S, "ts", f"{JITTER_S} seconds"), "batches")
