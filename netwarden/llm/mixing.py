"""Mixing sources to target weights by hash-random keys and prefix sums.

Every row gets a hash-random key (md5 of its id).  Within a source the rows
are ranged over equal key intervals (the keys are uniform, so the intervals
are balanced without a sample), sorted inside each interval and summed; the
interval totals, one row per source and interval, give the offsets.  Each
source is cut at the exact word budget: whole epochs first, then rows in key
order until the rest is used up; the row at the cut is taken in part.

Targets: sources by code point order, null last, weigh 5, 2, 1, repeating,
and share the total size; a target stops at ``max_epochs`` times its source's
size and the excess is shared among the others by weight.

DataFrame functions only; deterministic, so reruns agree.  Defined cases: null text
has size 0; null source is a source of its own; rows of equal id sort by size
and then by a digest of their content, identical rows are interchangeable; an
empty table gives no rows; a result column takes the place of an input column of
its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.llm.common import carried, materialise, prepare

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# rows that share one key interval of the whole table, on average
INTERVAL_ROWS = 50_000
_SPACE = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(_SPACE)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, rank, source_size, target) from (src, source_size)."""
    spark = totals.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rank in code point order without one global window: range partitions plus offsets
    part = materialise(totals.withColumn("_null", F.col("src").isNull())
                       .repartitionByRange(n, "_null", "src").withColumn("_p", F.spark_partition_id()), "sources")
    before = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_null", "src")) + F.col("_before")
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when((F.col("rank") - 1) % len(weights) == i, F.lit(x)).otherwise(w)
    ranked = part.join(before, "_p").withColumn("rank", rank).withColumn("w", w).select(
        "src", "source_size", F.col("rank").cast("long").alias("rank"), F.col("w").cast("long").alias("w"))
    ranked = materialise(ranked, "weights")
    total, free_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total, free_w, capped = total or 0, free_w or 1, 0
    while True:  # each round caps the sources above their limit and shares anew
        level = [F.lit(float(total - capped)), F.lit(float(free_w))]
        full = F.col("w") * level[0] / level[1] > max_epochs * F.col("source_size")
        got = ranked.agg(F.sum(F.when(full, max_epochs * F.col("source_size"))),
                         F.sum(F.when(~full, F.col("w")))).first()
        now = got[0] or 0
        if now == capped or got[1] is None:
            capped, free_w = (now, free_w) if got[1] is None else (capped, free_w)
            break
        capped, free_w = now, got[1]
    share = F.col("w") * level[0] / level[1]
    limit = (max_epochs * F.col("source_size")).cast("double")
    return ranked.select("src", "rank", "source_size", F.when(share > limit, limit).otherwise(share).alias("target"))


def mix(docs: DataFrame, *, size: str, source: str, order: list[str], weights=WEIGHTS,
        max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` plus ``source_size``, ``target`` and ``taken``; ``size`` is a long
    column, ``order`` the columns whose md5 is the random key (first) and that
    break ties (all)."""
    prepare(docs.sparkSession)
    names = carried(docs.columns, "source_size", "target", "taken")
    # every column under an inner name, each once
    inner = {c: f"_llm_c{i}" for i, c in enumerate([*names, *(c for c in order if c not in names)])}
    docs = docs.select(*[F.col(c).alias(x) for c, x in inner.items()],
                       F.col(size).alias("_llm_size"), F.col(source).cast("string").alias("_llm_src"))
    order = [inner[c] for c in order]
    key = F.md5(F.coalesce(F.col(order[0]).cast("string"), F.lit("")))
    keyed = materialise(docs.withColumn("_llm_key", key), "keyed")
    totals = keyed.groupBy(F.col("_llm_src").alias("src")).agg(
        F.sum("_llm_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    totals = materialise(totals, "totals")
    rows = totals.agg(F.sum("rows")).first()[0] or 0
    cuts = max(16, math.ceil(rows / INTERVAL_ROWS))
    targets = source_targets(totals.select("src", "source_size"), weights, max_epochs)
    targets = targets.select(F.col("src").alias("_llm_s"), F.col("rank").alias("_llm_rank"), "source_size", "target")
    u = F.conv(F.substring("_llm_key", 1, 12), 16, 10).cast("double") / F.lit(2.0**48)
    cut = F.floor(u * cuts).cast("int")
    sums = keyed.groupBy("_llm_src", cut.alias("_llm_cut")).agg(F.sum("_llm_size").alias("_n"))
    w = Window.partitionBy("_llm_src").orderBy("_llm_cut")
    offsets = sums.select(F.col("_llm_src").alias("_o"), F.col("_llm_cut").alias("_oc"),
                          (F.sum("_n").over(w) - F.col("_n")).alias("_llm_offset"))
    offsets = offsets.join(targets, F.col("_o").eqNullSafe(F.col("_llm_s"))).drop("_llm_s")
    tie = [F.col(c) for c in order] + [F.col("_llm_size")]
    inside = Window.partitionBy("_llm_src", "_llm_cut").orderBy("_llm_key", *tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = keyed.withColumn("_llm_cut", cut).withColumn("_llm_run", F.sum("_llm_size").over(inside))
    j = run.join(offsets, F.col("_llm_src").eqNullSafe(F.col("_o")) & (F.col("_llm_cut") == F.col("_oc")))
    before = F.col("_llm_offset") + F.col("_llm_run") - F.col("_llm_size")
    budget = F.floor("target")
    n_src = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / n_src)
    rest = budget - epochs * n_src
    part = F.greatest(F.lit(0), F.least(F.col("_llm_size"), rest - before))
    taken = (epochs * F.col("_llm_size") + part).cast("long")
    return j.select(*[F.col(inner[c]).alias(c) for c in names], "source_size", "target", taken.alias("taken"))
