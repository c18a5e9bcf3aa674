"""Greedy segmentation of ordered rows without a sequential task.

A *marker* row decides where the next one falls: the first later row at least
``span_us`` after it, the row ``max_items`` further on, or the first row
after an idle gap longer than ``idle_us``, whichever comes first.  Flow cuts
(active and idle timeout) and "N items or every T seconds" batches are
both orbits of such a jump function, and an orbit looks sequential: each marker
depends on the one before.

Here the rows of a key are cut into blocks by time quantiles.  Inside a block
the jump function is tabulated from the back, so it is known for *every* place
where the orbit may enter what the last marker in the block is and how many
there are.  That function of the entry is monotone and changes at few places;
a block sends on only those.  The blocks' functions are then composed in
order, one lookup a block, streamed through sorted partitions.  With the marker
that each block inherits, its rows are marked independently.

Bounds: a block holds the rows of one key in one time quantile (about
rows / buckets); a hot key spreads over all blocks of its time range and only
its block functions (entries within one ``span_us`` of a block's first row) are
read in sequence, one at a time.  All times are whole microseconds, so
batch, stream and SQL agree exactly.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.operators.prefix import _B, MIN_ROWS_PER_BUCKET, quantile_bucket

_T = "_nw_t"
_NONE = np.iinfo(np.int64).min


def _jumps(t: np.ndarray, span_us: int, max_items: int | None, idle_us: int | None) -> tuple[np.ndarray, int]:
    """Next marker of every row of a block (``len(t)``: none in this block) and
    the first row after an idle gap inside the block."""
    n = len(t)
    nxt = np.searchsorted(t, t + span_us, side="left")
    if max_items:
        nxt = np.minimum(nxt, np.arange(n) + max_items)
    gap = n
    if idle_us is not None and n:
        gaps = np.flatnonzero(np.diff(t) > idle_us) + 1
        if len(gaps):
            gap = int(gaps[0])
            nxt = np.minimum(nxt, np.append(gaps, n)[np.searchsorted(gaps, np.arange(n), side="right")])
    return np.minimum(nxt, n), gap


def block_function(t: np.ndarray, span_us: int, max_items: int | None, idle_us: int | None) -> dict:
    """The block as a function of where the orbit enters: at entries ``k`` from
    ``at[i]`` on (the row before it is at ``before[i]``) the last marker is row
    ``last[i]`` (-1: the orbit passes over the block) after ``count[i]`` markers."""
    n = len(t)
    nxt, gap = _jumps(t, span_us, max_items, idle_us)
    last, count = np.full(n + 1, -1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    jump = nxt.tolist()
    la, co = last.tolist(), count.tolist()
    for i in range(n - 1, -1, -1):
        j = jump[i]
        la[i], co[i] = (i, 1) if j >= n else (la[j], co[j] + 1)
    last, count = np.array(la), np.array(co)
    # the marker before the block is no later than its first row
    reach = min(int(np.searchsorted(t, t[0] + span_us, side="left")), gap, max_items or n, n)
    last, count = last[:reach + 1], count[:reach + 1]
    at = np.flatnonzero(np.concatenate([[True], (last[1:] != last[:-1]) | (count[1:] != count[:-1])]))
    before = np.where(at > 0, t[np.maximum(at - 1, 0)], _NONE)
    return {"n": n, "t0": int(t[0]), "t1": int(t[-1]), "gap": gap, "at": at.tolist(), "before": before.tolist(),
            "last": last[at].tolist(), "last_t": np.where(last[at] >= 0, t[np.maximum(last[at], 0)], 0).tolist(),
            "count": count[at].tolist()}


_FUNCTION = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "t0", "t1", "gap")] +
                         [T.StructField(c, T.ArrayType(T.LongType())) for c in ("at", "before", "last", "last_t", "count")])
_CARRY = ("in_t", "in_since", "in_count", "in_first")


def _entry(marker: tuple | None, first: bool, since: int, t: np.ndarray, gap: int, span_us: int, max_items: int | None) -> int:
    """Row of a block where the orbit enters."""
    if first:
        return 0
    k = int(np.searchsorted(t, marker + span_us, side="left"))
    if max_items:
        k = min(k, max_items - since - 1)
    return min(k, gap)


def _compose(key: Sequence[str], schema: T.StructType, span_us: int, max_items: int | None, idle_us: int | None, start_us: int | None):
    """Streams sorted block functions and gives every block the marker before it."""
    def run(batches):
        current, marker, since, count, prev = (), None, 0, 0, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                k = tuple(r[c] for c in key)
                if k != current:
                    current, marker, since, count, prev = k, start_us, 0, 0, None
                first = marker is None or (idle_us is not None and prev is not None and r["t0"] - prev > idle_us)
                out.append((*k, r[_B], marker, since, count, first))
                i, limit = 0, r["gap"]
                if not first:
                    if max_items:
                        limit = min(limit, max_items - since - 1)
                    while i + 1 < len(r["at"]) and r["at"][i + 1] <= limit and r["before"][i + 1] < marker + span_us:
                        i += 1
                if r["last"][i] < 0:
                    since += r["n"]
                else:
                    marker, since, count = r["last_t"][i], r["n"] - 1 - r["last"][i], count + r["count"][i]
                prev = r["t1"]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.fieldNames(), o)) for o in out], schema=_arrow(schema))
    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def greedy_segments(df: DataFrame, key: Sequence[str], t_us: Column, order: Sequence[str], span_us: int,
                    max_items: int | None = None, idle_us: int | None = None, start_us: int | None = None,
                    closing: bool = False) -> DataFrame:
    """``df`` with ``segment`` (0, 1, ... per key in time order) and
    ``segment_us`` (time of the segment's marker).

    Opening markers (default) begin a segment and the key's first row is one;
    ``closing`` markers end a segment, and the clock of the first starts at ``start_us``.
    Ties in time are put in order by ``order``; rows without a time are left out.
    The source is read once (checkpointed)."""
    key, spark = list(key), df.sparkSession
    one = not key
    base = df.withColumn(_T, t_us.cast("long")).filter(F.col(_T).isNotNull())
    if one:
        key, base = ["_nw_key"], base.withColumn("_nw_key", F.lit(0))
    base = base.checkpoint(eager=True)
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // MIN_ROWS_PER_BUCKET)))
    rows = base.withColumn(_B, quantile_bucket(base, F.col(_T), buckets).cast("int"))
    if closing and start_us is None:
        start_us = base.agg(F.min(_T)).first()[0]
    fields = {f.name: f for f in rows.schema.fields}
    head = [fields[c] for c in key] + [fields[_B]]
    by = [*key, _B]

    def summarise(k, table):
        t = np.sort(table.column(_T).to_numpy())
        row = {c: v.as_py() for c, v in zip(by, k)} | block_function(t, span_us, max_items, idle_us)
        return pa.Table.from_pylist([row], schema=_arrow(T.StructType(head + _FUNCTION.fields)))

    functions = rows.select(*by, _T).groupBy(*by).applyInArrow(summarise, T.StructType(head + _FUNCTION.fields))
    carried = T.StructType(head + [T.StructField(c, T.LongType()) for c in _CARRY[:3]] + [T.StructField("in_first", T.BooleanType())])
    carry = functions.repartition(*key).sortWithinPartitions(*by).mapInArrow(
        _compose(key, carried, span_us, max_items, idle_us, start_us), carried)

    out = T.StructType([f for f in rows.schema.fields if f.name != _B] +
                       [T.StructField("segment", T.LongType()), T.StructField("segment_us", T.LongType())])
    names = [f.name for f in out.fields[:-2]]

    def mark(left, right):
        left = left.sort_by([(_T, "ascending"), *[(c, "ascending") for c in order]])
        t, c = left.column(_T).to_numpy(), right.to_pylist()[0]
        nxt, gap = _jumps(t, span_us, max_items, idle_us)
        is_marker = np.zeros(len(t), dtype=np.int64)
        i, jump = _entry(c["in_t"], c["in_first"], c["in_since"], t, gap, span_us, max_items), nxt.tolist()
        while i < len(t):
            is_marker[i] = 1
            i = jump[i]
        upto = np.cumsum(is_marker)
        place = np.flatnonzero(is_marker)
        seen = upto - is_marker if closing else upto
        number = c["in_count"] + seen - (0 if closing else 1)
        at = np.concatenate([[c["in_t"] if c["in_t"] is not None else 0], t[place]])[seen]
        cols = [left.column(n) for n in names] + [pa.array(number, pa.int64()), pa.array(at, pa.int64())]
        return pa.Table.from_arrays(cols, names=[*names, "segment", "segment_us"]).cast(_arrow(out))

    marked = rows.groupBy(*by).cogroup(carry.groupBy(*by)).applyInArrow(mark, out).drop(_T)
    return marked.drop("_nw_key") if one else marked
