"""Distributed running sums, ranks and exact order statistics.

A window with ORDER BY but no PARTITION BY moves the whole table into one
task.  Instead every row gets a *bucket*: a deterministic, monotone
function of its ``(group, order)`` key (a binary search over quantile
bounds taken from a hash-selected sample).  Running sums are computed
inside each bucket and shifted by the totals of the earlier buckets.

Why not ``repartitionByRange`` + ``spark_partition_id()``: its bounds are
sampled from shuffle output whose row order is not deterministic, so two
branches of one plan (or a recomputation after an executor loss) can see
different bounds.  A bucket computed from the row's own values is the same
everywhere, every time.

Size bounds: the sample is ``~32 x buckets`` keys (collected once); the
offset table has one row per bucket boundary a group crosses, i.e. at most
``buckets`` rows, so its broadcast is bounded by the bucket count and does
not grow with the data.  A group holding a third of all rows spans a third
of the buckets, so there is no hot task.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_B = "_nw_bucket"
SAMPLE_PER_BUCKET = 32
# bucket count = min(shuffle partitions, rows / MIN_ROWS_PER_BUCKET): every
# bucket task stays bounded, and small inputs do not pay for empty buckets
MIN_ROWS_PER_BUCKET = 50000
QUANTILE_REL_ERR = 0.0005
# bounds in one binary-search expression; more bounds are searched in two levels
SEARCH_WIDTH = 128


def _as_cols(cols: Iterable) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_buckets(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _search(k: Column, lits: list[Column]) -> Column:
    """Index of the bucket of ``k``: number of bounds ``<= k`` (binary search,
    log2(buckets) comparisons per row)."""
    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(k >= lits[mid - 1], build(mid, hi)).otherwise(build(lo, mid - 1))
    return build(0, len(lits))


def hash_bucket(hex_key: Column, n: int) -> Column:
    """Monotone bucket of a hex digest (md5 / sha) by its leading 7 digits:
    uniform, needs no sampling job."""
    return F.floor(F.conv(F.substring(hex_key, 1, 7), 16, 10).cast("double") * n / float(16 ** 7)).cast("int")


def _bounds_bucket(key: Column, lits: list[Column]) -> Column:
    """Number of (sorted) bounds ``<= key`` for any number of bounds: a binary
    search over every k-th bound finds the coarse interval, then the bounds
    inside that interval alone are compared."""
    if len(lits) <= SEARCH_WIDTH:
        return _search(key, lits)
    k = -(-len(lits) // SEARCH_WIDTH)
    groups = [lits[i:i + k] for i in range(0, len(lits), k)]
    coarse = _search(key, [g[0] for g in groups])  # groups whose first bound is reached
    inside = F.get(F.array(*[F.array(*g) for g in groups]), F.greatest(coarse - 1, F.lit(0)))
    reached = F.size(F.filter(inside, lambda b: b <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * F.lit(k) + reached).cast("int")


def quantile_bucket(df: DataFrame, value: Column, n: int) -> Column:
    """Monotone bucket in ``[0, n)`` of a numeric expression: quantile edges
    from one Greenwald-Khanna sketch job whose error is a quarter of a bucket
    (its size follows the bucket count, not the rows), so heavy tails are cut
    by rows, not by width."""
    if n <= 1:
        return F.lit(0)
    probs = [i / n for i in range(1, n)]
    edges = df.select(value.cast("double").alias("_q")).approxQuantile("_q", probs, min(QUANTILE_REL_ERR, 0.25 / n))
    if not edges:
        return F.lit(0)
    return _bounds_bucket(value.cast("double"), [F.lit(float(x)) for x in sorted(set(edges))])


def sampled_bucket(df: DataFrame, key: Column, n: int) -> Column:
    """Monotone bucket of any orderable struct key from a hash-selected
    sample of about ``32 x n`` keys (a count job and a sample job)."""
    if n <= 1:
        return F.lit(0)
    keyed = df.select(key.alias("_k"))
    total = keyed.count()
    if total == 0:
        return F.lit(0)
    want, modulus = n * SAMPLE_PER_BUCKET, 1 << 30
    cut = modulus if want >= total else max(1, int(modulus * want / total))
    sample = keyed.where(F.pmod(F.xxhash64("_k"), F.lit(modulus)) < cut).orderBy("_k").collect()
    if not sample:
        return F.lit(0)
    bounds = []
    for i in range(1, n):
        bnd = sample[min(len(sample) - 1, (i * len(sample)) // n)][0]
        if not bounds or bnd != bounds[-1]:
            bounds.append(bnd)
    stype = keyed.schema["_k"].dataType
    lits = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(bd, stype.fields)]) for bd in bounds]
    return _bounds_bucket(key, lits)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def auto_bucket(df: DataFrame, order_cols: list[Column], n: int) -> Column:
    if len(order_cols) == 1:
        dt = df.select(order_cols[0].alias("_o")).schema["_o"].dataType
        if isinstance(dt, _NUMERIC):
            return quantile_bucket(df, order_cols[0], n)
    return sampled_bucket(df, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_cols)]), n)


def prefix_sums(df: DataFrame, order_by: Sequence, sum_cols: Sequence[str], group_by: Sequence[str] = (),
                out_prefix: str = "cum_", num_partitions: int | None = None, descending: bool = False,
                bucket: Column | None = None, materialize: bool = True) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_by`` order (all
    ascending, or all descending), restarting per ``group_by``.

    ``order_by`` should be unique within a group (pre-aggregate ties first, or
    end it with the row key) so that the running sum is deterministic.
    ``bucket`` may be given when a monotone bucket is known -- a Column, or a
    function of the bucket count (e.g. ``lambda n: hash_bucket(h, n)``);
    otherwise it is derived from the data.

    The input is read by up to three branches (bucket bounds, bucket-local
    sums, bucket totals).  With ``materialize`` it is checkpointed once into
    ``spark.checkpoint.dir`` (a reliable checkpoint, which also cuts the
    lineage), so the upstream scan / parse / aggregation runs exactly once.
    """
    group_by = list(group_by)
    if materialize:
        df = df.checkpoint(eager=True)
    order_cols = _as_cols(order_by)
    n = _num_buckets(df, num_partitions)
    if num_partitions is None and materialize:
        rows = df.count()  # reads the checkpoint, not the source
        n = max(1, min(n, -(-rows // MIN_ROWS_PER_BUCKET)))
    one = n <= 1 and (bucket is None or not isinstance(bucket, Column))
    if callable(bucket) and not isinstance(bucket, Column):
        bucket = bucket(n)
    if bucket is None:
        bucket = auto_bucket(df, order_cols, n)
        if descending:
            bucket = F.lit(n) - bucket
    b = df.withColumn(_B, bucket)

    ordered = [c.desc() if descending else c.asc() for c in order_cols]
    w_local = Window.partitionBy(_B, *group_by).orderBy(*ordered) \
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.select("*", *[F.sum(c).over(w_local).alias(f"_loc_{c}") for c in sum_cols])

    if one:  # a single bucket has nothing before it
        return local.select(*[F.col(c) for c in df.columns],
                            *[F.col(f"_loc_{c}").alias(f"{out_prefix}{c}") for c in sum_cols])

    totals = b.groupBy(_B, *group_by).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    if group_by:
        w_prev = Window.partitionBy(*group_by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    else:
        # one row per bucket: this window sees at most ``n`` rows
        w_prev = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _B, *group_by, F.count(F.lit(1)).over(w_prev).alias("_prev"),
        *[F.sum(f"_tot_{c}").over(w_prev).alias(f"_off_{c}") for c in sum_cols],
    ).where(F.col("_prev") > 0).drop("_prev")

    # offsets: at most (buckets x groups) rows -- AQE broadcasts it when its
    # measured size is under the broadcast threshold, else shuffles it.
    joined = local.join(offsets, [_B, *group_by], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_loc_{c}") + F.coalesce(F.col(f"_off_{c}"), F.lit(0))).alias(f"{out_prefix}{c}")
          for c in sum_cols],
    )


def rank_within(df: DataFrame, group_by: Sequence[str], order_by: Sequence, rank_col: str = "rank",
                num_partitions: int | None = None, bucket=None, descending: bool = False) -> DataFrame:
    """1-based ``row_number`` per group without a per-group single task.

    ``order_by`` must be unique within a group (end it with the row key).
    """
    tmp = "_nw_one"
    out = prefix_sums(df.withColumn(tmp, F.lit(1).cast("long")), order_by, [tmp], group_by,
                      out_prefix="_cum", num_partitions=num_partitions, bucket=bucket, descending=descending)
    return out.withColumnRenamed(f"_cum{tmp}", rank_col).drop(tmp)


def global_position(df: DataFrame, order_by: Sequence, pos_col: str = "pos",
                    num_partitions: int | None = None, bucket=None, descending: bool = False) -> DataFrame:
    """0-based global position in ``order_by`` order (unique keys)."""
    return rank_within(df, [], order_by, "_nw_rank", num_partitions, bucket, descending) \
        .withColumn(pos_col, F.col("_nw_rank") - 1).drop("_nw_rank")


def value_counts(df: DataFrame, value: str, group_by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rows per distinct (group, value); partial aggregation runs map side."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))) \
             .groupBy(*group_by, value).agg(F.sum(w).alias("_c"))


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], group_by: Sequence[str] = (),
                      num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles (numpy 'linear', DuckDB
    ``quantile_cont``, Spark ``percentile``) per group.

    Spark's ``percentile`` buffers every value of a group in one task; here
    the values are reduced to distinct counts (checkpointed once) and ranked
    with :func:`prefix_sums`; then one aggregation per group picks, for every
    probability, the two neighbours of its target rank by conditional maxima.

    Returns ``group_by + [p, value_at_p]``.
    """
    group_by = list(group_by)
    vc = value_counts(df, value, group_by).checkpoint(eager=True)
    if num_partitions is None:
        n = max(1, min(_num_buckets(vc, None), -(-vc.count() // MIN_ROWS_PER_BUCKET)))
    else:
        n = num_partitions
    cum = prefix_sums(vc, [F.col(value)], ["_c"], group_by, num_partitions=n, materialize=False) \
        .select(*group_by, F.col(value).cast("double").alias("_v"),
                (F.col("cum__c") - F.col("_c")).alias("_lo"), F.col("cum__c").alias("_hi"))
    sizes = vc.groupBy(*group_by).agg((F.sum("_c") - 1).alias("_last"))
    if group_by:
        ranked = cum.join(sizes, group_by)
    else:
        from netwarden.functions.scalars import attach_scalars
        ranked = attach_scalars(cum, sizes)

    def at(rank: Column, name: str) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v"))).alias(name)

    picks = []
    for i, p in enumerate(probs):
        pos = F.col("_last") * F.lit(float(p))
        picks += [at(F.floor(pos), f"_a{i}"), at(F.ceil(pos), f"_b{i}")]
    got = ranked.groupBy(*group_by).agg(F.max("_last").alias("_last"), *picks)
    rows = []
    for i, p in enumerate(probs):
        pos = F.col("_last") * F.lit(float(p))
        v = F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (pos - F.floor(pos))
        rows.append(F.struct(F.lit(float(p)).alias("p"), v.alias("value")))
    out = got.where(F.col("_last").isNotNull()).select(*group_by, F.explode(F.array(*rows)).alias("_r"))
    return out.select(*group_by, F.col("_r.p").alias("p"), F.col("_r.value").alias("value"))
