"""Seeded sampling, splitting and shuffling.

Sequential RNG draws cannot be replayed in parallel, so every random
choice here is a rank by ``md5(concat(seed, '|', row_id))`` -- identical on
every executor, on re-execution after an executor loss, and in DuckDB.
"The k smallest hashes per stratum" needs only the k-th smallest hash: rows
are counted per (stratum, hash prefix), the one prefix that holds the k-th is
ranked, and every row then decides by comparing its own hash with that cut.
Only (stratum, hash, id) is ever shuffled, never a row's other columns, and a
stratum holding a third of the table is spread over 65,536 prefixes.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.operators.prefix import hash_bucket, rank_within


def hash_key(seed, row_id: str = "row_id") -> Column:
    """Deterministic pseudo-random sort key for (seed, row)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def seeded_shuffle(df: DataFrame, seed: int = 42, row_id: str = "row_id", out: str = "shuffle_key") -> DataFrame:
    """A permutation is fully described by its sort key; storing the
    key is enough (ordering on read is ``orderBy(shuffle_key, row_id)``)."""
    return df.withColumn(out, hash_key(seed, row_id))


def hash_rank(df: DataFrame, strata: Sequence[str], seed: int = 42, row_id: str = "row_id",
              rank_col: str = "hrank") -> DataFrame:
    """1-based rank of each row inside its stratum by seeded hash (ties by row_id)."""
    h = hash_key(seed, row_id)
    return rank_within(df, list(strata), [h, F.col(row_id)], rank_col, bucket=lambda n: hash_bucket(h, n))


PREFIX_DIGITS = 4
# cuts are one row per stratum; up to this many travel with the plan
LOCAL_CUTS = 10000


def hash_cuts(df: DataFrame, strata: Sequence[str], h: Column, row_id: str, k: Column,
              quota: DataFrame | None = None) -> DataFrame:
    """(strata, cut_hash, cut_id) of the k-th smallest ``(h, row_id)`` of every
    stratum, ``k`` being an expression over ``n_stratum`` and the columns of
    ``quota`` (one row per stratum).  A stratum with k < 1 has no row, one with
    k above its size has its last row."""
    keyed = df.select(*strata, h.alias("_h"), F.col(row_id).alias("_id"), F.substring(h, 1, PREFIX_DIGITS).alias("_p"))
    per = Window.partitionBy(*strata)
    counts = keyed.groupBy(*strata, "_p").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select("*", F.sum("_c").over(per).alias("n_stratum"), F.sum("_c").over(per.orderBy("_p")).alias("_to"))
    if quota is not None:
        counts = counts.join(quota, list(strata))
    counts = counts.withColumn("_k", F.least(k, F.col("n_stratum")))
    hit = counts.where((F.col("_to") - F.col("_c") < F.col("_k")) & (F.col("_k") <= F.col("_to"))).select(
        *strata, "_p", (F.col("_k") - F.col("_to") + F.col("_c")).alias("_need"))
    inside = keyed.join(hit, [*strata, "_p"])
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", "_id"))
    return inside.withColumn("_r", rank).where(F.col("_r") == F.col("_need")).select(
        *strata, F.col("_h").alias("cut_hash"), F.col("_id").alias("cut_id"))


def with_cuts(df: DataFrame, strata: Sequence[str], cuts: DataFrame) -> DataFrame:
    """``df`` plus its stratum's ``cut_hash`` and ``cut_id`` (null without one).
    Cuts within ``LOCAL_CUTS`` rows become a local table that is broadcast."""
    rows = cuts.limit(LOCAL_CUTS + 1).collect()
    if len(rows) <= LOCAL_CUTS:
        cuts = F.broadcast(df.sparkSession.createDataFrame(rows, cuts.schema))
    return df.join(cuts, list(strata), "left")


def within_cut(h: Column, row_id: str) -> Column:
    """Whether a row is at or before its stratum's cut."""
    at = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (F.col(row_id) <= F.col("cut_id")))
    return F.coalesce(at, F.lit(False))


def class_counts_table(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_stratum"))


def stratified_split(df: DataFrame, label: str = "y", test_fraction: float = 0.2, seed: int = 42,
                     row_id: str = "row_id", out: str = "split") -> DataFrame:
    """Exactly ``floor(n_c * f)`` test rows per class ``c``."""
    h = hash_key(seed, row_id)
    cuts = hash_cuts(df, [label], h, row_id, F.floor(F.col("n_stratum") * F.lit(float(test_fraction))))
    j = with_cuts(df, [label], cuts)
    return j.withColumn(out, F.when(within_cut(h, row_id), "test").otherwise("train")).drop("cut_hash", "cut_id")


def class_quota_split(df: DataFrame, quotas: dict, label: str = "y", seed: int = 42,
                      row_id: str = "row_id", out: str = "split") -> DataFrame:
    """Per class exact sizes ``{class: (n_train, n_test)}``; rows beyond
    ``n_train + n_test`` are marked ``unused`` (kept, not dropped)."""
    h = hash_key(seed, row_id)
    j = df
    for name, size in (("_train", {c: a for c, (a, _) in quotas.items()}), ("_used", {c: a + b for c, (a, b) in quotas.items()})):
        k = F.lit(0)
        for c, n in size.items():
            k = F.when(F.col(label) == F.lit(c), F.lit(int(n))).otherwise(k)
        j = with_cuts(j, [label], hash_cuts(df, [label], h, row_id, k)).withColumn(
            name, within_cut(h, row_id)).drop("cut_hash", "cut_id")
    return j.withColumn(out, F.when(F.col("_train"), "train").when(F.col("_used"), "test").otherwise("unused")).drop("_train", "_used")


def sample_per_stratum(df: DataFrame, strata: Sequence[str], quota: DataFrame, seed: int = 42,
                       row_id: str = "row_id") -> DataFrame:
    """The ``quota.k`` rows with smallest hash in each stratum."""
    h = hash_key(seed, row_id)
    j = with_cuts(df, list(strata), hash_cuts(df, list(strata), h, row_id, F.col("k"), quota))
    return j.where(within_cut(h, row_id)).drop("cut_hash", "cut_id")


def proportional_targets(counts: DataFrame, n_benign: int, n_malicious: int, label: str = "label",
                         benign_values: Sequence[str] = ("benign", "normal", "0")) -> DataFrame:
    """I01 targets: fixed benign quota; malicious quota split over attack
    types as ``int(N * count / total_malicious)`` (may sum to less than N)."""
    from netwarden.functions.scalars import attach_scalars
    is_b = F.col(label).isin(*benign_values)
    tot = counts.agg(F.sum(F.when(~is_b, F.col("n"))).alias("_mal"))
    j = attach_scalars(counts, tot)
    k = F.when(is_b, F.least(F.col("n"), F.lit(int(n_benign)))) \
         .otherwise(F.least(F.col("n"), F.floor(F.lit(int(n_malicious)) * F.col("n") / F.col("_mal")).cast("long")))
    return j.select(label, k.alias("k"))


TOPK_HEAP_LIMIT = 10000


def first_n(df: DataFrame, n: int, order_by: Sequence, descending: bool = False) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order (unique keys of any orderable
    type), returned in that order for every ``n``.

    Up to ``TOPK_HEAP_LIMIT`` rows Spark's ``TakeOrderedAndProject`` keeps a heap
    of n rows per partition; above it that heap would bring ``partitions x n``
    rows into one task, so the rows are ranked by the bucketed global position
    and range-sorted on it.  Both plans give the same rows in the same order."""
    from netwarden.operators.prefix import global_position
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if n <= TOPK_HEAP_LIMIT:
        return df.orderBy(*[c.desc() if descending else c.asc() for c in cols]).limit(n)
    pos = global_position(df, cols, "_pos", descending=descending)
    return pos.where(F.col("_pos") < n).orderBy("_pos").drop("_pos")


def head_then_sample(df: DataFrame, n: int, order_key: str, factor: int = 5, min_head: int = 500000,
                     seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Take the first ``max(factor*n, min_head)`` rows by ``order_key``
    (a keyed prefix, not file order), then ``n`` of them by seeded hash.
    The limits are the feature here (a sampling operator)."""
    head = first_n(df, max(factor * n, min_head), [order_key, row_id])
    return head.orderBy(hash_key(seed, row_id), F.col(row_id)).limit(n)


def micro_batches(df: DataFrame, ts: str, row_id: str, items: int, seconds: float) -> DataFrame:
    """``df`` with ``batch_id``: in time order a batch closes with its
    ``items``-th row or with the first row at least ``seconds`` after the last
    close, whichever comes first (the clock starts with the first row)."""
    from netwarden.operators.greedy import greedy_segments
    cut = greedy_segments(df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))), [], F.col("_us"), [row_id],
                          span_us=round(seconds * 1e6), max_items=items, closing=True)
    return cut.withColumnRenamed("segment", "batch_id").drop("_us", "segment_us")
