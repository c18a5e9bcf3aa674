"""Structured Streaming form of the online path.

The batch operators are column expressions, so the stateless part of the
online service (align -> rules -> route -> fuse -> interesting events) is
the SAME code on a streaming DataFrame.  Stateful parts use watermarks
(state is bounded in time), ``transformWithState`` (RocksDB state, list
state, timers) where the semantics are order-dependent (flow cut, two-limit
batches), and ``foreachBatch`` for sinks that need table logic (retention,
thresholds re-read per batch, late rows to a side table).  Checkpoint locations are always given by the caller and must be
on shared storage on a cluster.
"""

from __future__ import annotations

import bisect
from typing import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from netwarden.operators.dashboard import VERDICTS
from netwarden.operators.routing import three_way_route
from netwarden.operators.rules import fuse_verdict, match_rules
from netwarden.operators.search import interesting


# --- S01 / S09: source and trigger -------------------------------------------------

def flow_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 1,
                fmt: str = "parquet") -> DataFrame:
    """File-drop source with a fixed schema; S09: batch size by files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).format(fmt).load(path)


def trigger_options(seconds: float | None = None, available_now: bool = False) -> dict:
    """Cut batches every ``seconds`` (processing time) or drain what is
    there (``availableNow``); size per batch comes from maxFilesPerTrigger."""
    if available_now:
        return {"availableNow": True}
    return {"processingTime": f"{seconds} seconds"}


# --- S02 / S03: stateless scoring ----------------------------------------------------

def score_stream(flows: DataFrame, low: float, high: float, p: str = "p_model", err: str = "recon_error") -> DataFrame:
    """Rules + three-way route + fusion on arriving flows (same code as batch)."""
    routed = three_way_route(flows, err=err, low=low, high=high, model_pred=(F.col(p) >= 0.5).cast("int"))
    return fuse_verdict(match_rules(routed))


def interesting_stream(scored: DataFrame) -> DataFrame:
    """The suspicious / attack / rule-stage side stream."""
    return scored.where(interesting())


# --- S04-S06: counters and windows ---------------------------------------------------

def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned TIMESTAMP; the tables carry TIMESTAMP_NTZ
    (wall clock in UTC, the session zone), so the cast is exact."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def verdict_counters(scored: DataFrame) -> DataFrame:
    """Running counts per verdict (4 keys: tiny state; update mode)."""
    return scored.groupBy(F.coalesce("verdict", F.lit("unknown")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def per_minute_counts(scored: DataFrame, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Tumbling 1-minute counts per verdict; state is dropped once the
    watermark passes a window (append mode emits each window once)."""
    w = _event_time(scored, ts).withWatermark(ts, watermark).groupBy(F.window(ts, "1 minute").alias("w"))
    return w.agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS]) \
            .select(F.col("w.start").alias("minute"), *VERDICTS)


def sliding_counts(scored: DataFrame, length: str = "5 minutes", slide: str = "1 minute", ts: str = "ts",
                   watermark: str = "10 minutes") -> DataFrame:
    """Trailing 5m / 15m / 1h / 24h views as sliding windows."""
    w = _event_time(scored, ts).withWatermark(ts, watermark).groupBy(F.window(ts, length, slide).alias("w"))
    return w.agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS]) \
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *VERDICTS)


def dedupe_alerts(scored: DataFrame, key: str, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Drop duplicate alerts by key within the watermark delay."""
    return _event_time(scored, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


# --- S07 / S12 / S13: foreachBatch sinks ----------------------------------------------

def _committed(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches whose folder ``batch=<id>`` under ``path`` was written
    completely, ascending (a missing ``path`` has none)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch=")
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Overwrites the batch's own folder, so a replay leaves one copy.  The
    batch id is the partition column ``batch`` of the table at ``path``."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def retention_sink(path: str, keep: int, seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """Keep only the newest ``keep`` rows (by arrival ``seq``) in a table.
    Batch ``id`` writes the table's version ``batch=<id>`` from the latest
    complete version before it, so restarts go on where the table was and a
    replayed batch gives the same version again; older versions than the one
    before are removed."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _committed(spark, path) if b < batch_id]
        both = batch
        if before:
            old = spark.read.parquet(f"{path}/batch={before[-1]}")
            both = old.unionByName(batch.select(*old.columns))
        _write_batch(both.orderBy(F.col(seq).desc()).limit(keep), path, batch_id)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for b in before[:-1]:
            gone = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}")
            gone.getFileSystem(conf).delete(gone, True)
    return run


def retained(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table kept by :func:`retention_sink`."""
    done = _committed(spark, path)
    if not done:
        raise ValueError(f"no retained table at {path}")
    return spark.read.parquet(f"{path}/batch={done[-1]}")


def threshold_reloading_sink(config_path: str, out_path: str, err: str = "recon_error",
                             p: str = "p_model") -> Callable[[DataFrame, int], None]:
    """Thresholds live in a one-row table re-read at every batch, so a
    change takes effect on the next batch (the reference never passes its
    runtime change to the scorer).  Each batch writes its own folder
    ``batch=<id>`` of ``out_path``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        cfg = batch.sparkSession.read.parquet(config_path).first()
        scored = three_way_route(batch, err=err, low=float(cfg["tau_low"]), high=float(cfg["tau_high"]),
                                 model_pred=(F.col(p) >= 0.5).cast("int"))
        _write_batch(scored.withColumn("batch_id", F.lit(batch_id)), out_path, batch_id)
    return run


def late_data_sink(out_path: str, late_path: str, delay_s: float, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """S13 (ours): rows older than ``max event time seen before the batch -
    delay`` go to a side table instead of being dropped silently.  The maximum
    after each batch is stored with its id (``<late_path>-bound``), so a
    restart keeps the bound and a replay uses the one the batch had."""
    bounds = f"{late_path}-bound"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _committed(spark, bounds) if b < batch_id]
        seen = spark.read.parquet(f"{bounds}/batch={before[-1]}").first()["seen"] if before else None
        b = batch.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
        late = F.lit(False) if seen is None else F.coalesce(F.col("_t") < seen - delay_s, F.lit(False))
        _write_batch(b.where(~late).drop("_t"), out_path, batch_id)
        _write_batch(b.where(late).drop("_t"), late_path, batch_id)
        newest = F.greatest(F.max("_t"), F.lit(seen).cast("double"))
        _write_batch(b.agg(newest.alias("seen")), bounds, batch_id)
    return run


# --- a replayed arrival order ------------------------------------------------------------

def arrival_batch(arrival_us: Column, lo: int, hi: int, batches: int) -> Column:
    """Batch of an arrival time: ``batches`` equal slices of [lo, hi]."""
    return F.floor((arrival_us - F.lit(lo)) * F.lit(batches) / F.lit(hi - lo + 1)).cast("int")


def replay_arrivals(rows: DataFrame, path: str, arrival_us: Column, order: Sequence[str], batches: int) -> DataFrame:
    """A stream that hands ``rows`` over in ``batches`` micro-batches of arrival
    order: one file a batch, written one after the other (the file source
    reads oldest first), rows inside in arrival order."""
    spark = rows.sparkSession
    x = rows.withColumn("_arrival", arrival_us)
    lo, hi = x.agg(F.min("_arrival"), F.max("_arrival")).first()
    cut = x.withColumn("_batch", arrival_batch(F.col("_arrival"), lo, hi, batches)).checkpoint(eager=True)
    for b in range(batches):
        cut.where(F.col("_batch") == b).drop("_batch").repartition(1).sortWithinPartitions("_arrival", *order) \
           .drop("_arrival").write.mode("append").parquet(path)
    return flow_stream(spark, path, rows.schema, 1)


# --- S06: trailing views from panes -----------------------------------------------------

def trailing_counts(panes: DataFrame, minutes: Sequence[int], minute: str = "minute", counts: Sequence[str] = VERDICTS) -> DataFrame:
    """Trailing views over one-minute panes kept once: a view of ``m``
    minutes that ends with a pane is the difference of two running sums, so
    an event is counted in one pane and not copied into every window.
    ``minute`` is the pane's start (timestamp); one row per pane, columns
    ``<count>_<m>``.  Work follows the number of minutes, not of events."""
    from netwarden.operators.prefix import prefix_sums
    p = panes.select((F.unix_micros(minute) / 60_000_000).cast("long").alias("_m"), *counts)
    ends = p.agg(F.min("_m").alias("lo"), F.max("_m").alias("hi")).first()
    if ends["lo"] is None:
        lo, hi = 0, -1
    else:
        lo, hi = ends["lo"], ends["hi"]
    grid = p.sparkSession.range(lo, hi + 1).withColumnRenamed("id", "_m").join(p, "_m", "left").na.fill(0, list(counts))
    run = prefix_sums(grid, [F.col("_m")], list(counts), out_prefix="_c_").select("_m", *[f"_c_{c}" for c in counts])
    run = run.checkpoint(eager=True)
    out = p.select("_m").join(run, "_m")
    for m in minutes:
        before = run.select((F.col("_m") + m).alias("_m"), *[F.col(f"_c_{c}").alias(f"_b_{c}") for c in counts])
        out = out.join(before, "_m", "left").withColumns(
            {f"{c}_{m}": F.col(f"_c_{c}") - F.coalesce(f"_b_{c}", F.lit(0)) for c in counts}).drop(*[f"_b_{c}" for c in counts])
    return out.select((F.col("_m") * 60).alias("minute_s"), *[f"{c}_{m}" for m in minutes for c in counts])


# --- S08: exact idle + active timeout flow cut ----------------------------------------

FLOW_OUT = "key string, first_us long, last_us long, packets long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Keys share state by hash: a state call costs about as much as a thousand rows, so
# calls follow the slots (fixed: a restart finds its state) and not the keys.
STATE_SLOTS = 256


def _frame(rows: list[tuple], columns: Sequence[str]) -> pd.DataFrame:
    """Output rows of a processor: a text key, then whole numbers."""
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="int64" if i else object) for i, c in enumerate(columns)})


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows of a slot (a text key, then whole numbers) as one state value."""
    types = [pa.string() if c == "key" else pa.int64() for c in rows.columns]
    b = pa.RecordBatch.from_arrays([pa.array(rows[c], t, from_pandas=True) for c, t in zip(rows.columns, types)], names=list(rows.columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, b.schema) as w:
        w.write_batch(b)
    return (out.getvalue().to_pybytes(),)


def _unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(value)).read_all()


class _Slot(StatefulProcessor):
    """Per slot of keys: the packed open item of every key (value state), the packed
    rows that the watermark has not passed yet (list state, one value an input)
    and the time of the one timer.  When it fires, the rows that are final are
    taken in time order, so arrival order does not matter."""

    columns: tuple
    open_columns: tuple
    row_columns: tuple

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.timer = handle.getValueState("timer", "at_ms long")

    def _wake(self, at_us: int) -> None:
        """One timer a slot, at the earliest time asked for."""
        at = at_us // 1000 + 1
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([pdf[list(self.row_columns)] for pdf in rows], ignore_index=True)
        if len(new):
            self.waiting.appendValue(_packed(new))
            self._wake(int(new["t"].min()))
        yield _frame([], self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        parts = [_unpacked(v[0]) for v in self.waiting.get()] if self.waiting.exists() else []
        held = {}
        if self.open.exists():
            held = {r[0]: r[1:] for r in zip(*_unpacked(self.open.get()[0]).to_pydict().values())}
        rest = None
        final = []
        if parts:
            pending = pa.concat_tables(parts).sort_by([(c, "ascending") for c in self.row_columns[1:]])
            ready = bisect.bisect_left(pending.column("t").to_numpy(), passed)
            final, rest = zip(*pending.slice(0, ready).to_pydict().values()), pending.slice(ready)
            if ready:
                self.waiting.clear()
                if len(rest):
                    self.waiting.appendValue(_packed(rest.to_pandas()))
        out = self.take(held, final, passed)
        if held:
            self.open.update(_packed(_frame([(k, *v) for k, v in held.items()], self.open_columns)))
        else:
            self.open.clear()
        again = [] if rest is None or not len(rest) else [rest.column("t")[0].as_py()]
        again += self.due(held)
        if again:
            self._wake(min(again))
        yield _frame(out, self.columns)

    def take(self, held: dict, final, passed: int) -> list[tuple]:
        """Output of the final rows; ``held`` is brought up to date."""
        raise NotImplementedError

    def due(self, held: dict) -> list[int]:
        """Times at which an open item is to be looked at without new rows."""
        return []

    def close(self) -> None:
        pass


class FlowCut(_Slot):
    """The open flow of every key; a flow closes with the first final packet beyond
    its idle or active timeout, or once no packet within its idle timeout can come."""

    columns = ("key", "first_us", "last_us", "packets")
    open_columns = ("key", "start", "last", "n")
    row_columns = ("key", "t")

    def __init__(self, idle_us: int, active_us: int):
        self.idle_us, self.active_us = idle_us, active_us

    def take(self, held, final, passed):
        done = []
        for key, t in final:
            flow = held.get(key)
            if flow is None or t - flow[1] > self.idle_us or t - flow[0] > self.active_us:
                if flow:
                    done.append((key, *flow))
                held[key] = (t, t, 1)
            else:
                held[key] = (flow[0], t, flow[2] + 1)
        silent = [k for k, flow in held.items() if flow[1] + self.idle_us < passed]
        return done + [(k, *held.pop(k)) for k in silent]

    def due(self, held):
        return [min(flow[1] for flow in held.values()) + self.idle_us] if held else []


def _by_slot(rows: DataFrame, watermark: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``rows`` (text ``key``, ``ts``) through a processor, keys dealt to the slots."""
    slot = F.pmod(F.xxhash64("key"), F.lit(STATE_SLOTS)).cast("int").alias("slot")
    return rows.select("*", slot).withWatermark("ts", watermark).groupBy("slot").transformWithStateInPandas(
        processor, schema, "append", "eventTime")


def assemble_flows_stream(events: DataFrame, key: str, ts: str = "ts", idle_s: float = 2.0,
                          active_s: float = 10.0, watermark: str = "1 minute") -> DataFrame:
    """The flows of A05 from a stream, exactly: per key a flow ends after
    an idle gap > ``idle_s`` or before the packet more than ``active_s`` after
    its first.  State (RocksDB) is the open flow and the packets younger than
    the watermark; a flow is emitted once the watermark has closed it.  Needs
    ``spark.sql.streaming.stateStore.providerClass`` set to :data:`ROCKSDB`."""
    x = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return _by_slot(x, watermark, FlowCut(round(idle_s * 1e6), round(active_s * 1e6)), FLOW_OUT)


# --- S09: micro-batches by size or time ---------------------------------------------------

class TwoLimitBatches(_Slot):
    """Numbers the rows of a key as A16 does: open is the number of the open
    batch, its rows so far and the time of the last close."""

    columns = ("key", "id", "batch_id")
    open_columns = ("key", "batch", "n", "since")
    row_columns = ("key", "t", "id")

    def __init__(self, items: int, span_us: int):
        self.items, self.span_us = items, span_us

    def take(self, held, final, passed):
        out = []
        for key, t, i in final:
            batch, n, since = held.get(key) or (0, 0, t)
            out.append((key, i, batch))
            n += 1
            held[key] = (batch + 1, 0, t) if n >= self.items or t - since >= self.span_us else (batch, n, since)
        return out


def micro_batches_stream(rows: DataFrame, key: str, row_id: str, items: int, seconds: float, ts: str = "ts",
                         watermark: str = "1 minute") -> DataFrame:
    """Per key (a sender) the batch of every row: a batch closes with its
    ``items``-th row or the first row ``seconds`` after the last close.  A row
    comes out once the watermark has passed it."""
    x = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"),
                    F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(row_id).cast("long").alias("id"))
    return _by_slot(x, watermark, TwoLimitBatches(items, round(seconds * 1e6)), "key string, id long, batch_id long")


# --- S10: exact stratified splitter -------------------------------------------------------

def split_cuts(rows: DataFrame, label: str, test_fraction: float, seed: int = 42, row_id: str = "row_id") -> dict:
    """The counting pass of S10: per class the hash of its last test row, so
    that exactly ``floor(n_c * f)`` rows of the class are at or below it (one
    entry per class)."""
    from netwarden.operators.sampling import hash_cuts, hash_key
    cuts = hash_cuts(rows, [label], hash_key(seed, row_id), row_id, F.floor(F.col("n_stratum") * F.lit(float(test_fraction))))
    return {str(r[label]): r["cut_hash"] for r in cuts.collect()}


def stratified_split_stream(rows: DataFrame, label: str, cuts: dict, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Exact stratified split of a stream.  With the cuts of the counting
    pass every row decides on its own hash: no state, no grouping, the same
    answer on a replay; a class without a cut has no test rows."""
    from netwarden.operators.sampling import hash_key
    name = F.col(label).cast("string")
    cut = F.lit(None).cast("string")
    for k, v in cuts.items():
        cut = F.when(name == F.lit(k), F.lit(v)).otherwise(cut)
    test = F.coalesce(hash_key(seed, row_id) <= cut, F.lit(False))
    return rows.select(F.col(row_id).cast("long").alias("row_id"), name.alias("label"),
                       F.when(test, "test").otherwise("train").alias("split"))
