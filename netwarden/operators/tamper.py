"""Tampered data sets for robustness tests.

Selections are seeded hash ranks (see :mod:`netwarden.operators.sampling`);
array edits are ``transform`` lambdas evaluated in the JVM.  Features
are never touched by label poisoning, and triggers touch only the chosen
positions -- both are asserted by the property tests.
"""

from __future__ import annotations

import hashlib
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Poisoning rates of the experiments (fraction of malicious
# training labels flipped).
POISON_RATES = [0.05, 0.10, 0.15, 0.50]
TRIGGER_NOISE_STD = 0.5


def seed_for_rate(rate: float, base: int = 42) -> int:
    """Per-rate seed ``base + int(rate * 1000)`` (one of the two formulas in
    use; the other, ``base + rate_percent``, is ``seed_for_rate_pct``)."""
    return base + int(round(rate * 1000))


def seed_for_rate_pct(rate_pct: int, base: int = 42) -> int:
    return base + int(rate_pct)


def _hash(seed: Column, row_id: str) -> Column:
    return F.md5(F.concat(seed.cast("string"), F.lit("|"), F.col(row_id).cast("string")))


def poison_labels(df: DataFrame, rate: float, seed: int | None = None, y: str = "y", row_id: str = "row_id",
                  out: str = "y_poisoned") -> DataFrame:
    """Flip ``int(n_mal * rate)`` malicious labels to benign (smallest
    seeded hashes among ``y = 1``); features untouched."""
    seed = seed_for_rate(rate) if seed is None else seed
    return poison_scenarios(df, [rate], {rate: seed}, y, row_id, out).drop("scenario", "rate")


def poison_scenarios(df: DataFrame, rates: Sequence[float] = tuple(POISON_RATES), seeds: dict | None = None,
                     y: str = "y", row_id: str = "row_id", out: str = "y_poisoned") -> DataFrame:
    """Every poisoning rate from ONE clean table.

    The malicious row ids fan out once per rate (a fixed, small factor) and
    give one cut hash per rate; the clean rows then fan out once per rate and
    each decides by its own per-rate hash."""
    from netwarden.operators.sampling import hash_cuts
    seeds = seeds or {r: seed_for_rate(r) for r in rates}
    grid = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rate"), F.lit(int(seeds[r])).alias("seed"),
                                        F.lit(f"poison_{int(round(r * 100)):02d}").alias("scenario"))
                               for r in rates]))
    mal = df.where(F.col(y) == 1).select(row_id, grid.alias("_g")).select(row_id, "_g.rate", "_g.seed")
    cuts = {c["rate"]: c for c in hash_cuts(mal, ["rate"], _hash(F.col("seed"), row_id), row_id,
                                            F.floor(F.col("n_stratum") * F.col("rate"))).collect()}  # one per rate
    x = df.select("*", grid.alias("_g")).select("*", "_g.*").drop("_g")
    h = _hash(F.col("seed"), row_id)
    flip = F.lit(False)
    for r, c in cuts.items():
        before = (h < F.lit(c["cut_hash"])) | ((h == F.lit(c["cut_hash"])) & (F.col(row_id) <= F.lit(c["cut_id"])))
        flip = F.when(F.col("rate") == F.lit(float(r)), before).otherwise(flip)
    return x.withColumn(out, F.when((F.col(y) == 1) & flip, F.lit(0)).otherwise(F.col(y))).drop("seed")


def label_flips(tampered: DataFrame, clean: DataFrame, y: str = "y", y_t: str = "y_poisoned",
                row_id: str = "row_id", group_by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Inner join on ``row_id``; flipped count and percent per scenario."""
    j = tampered.select(*group_by, row_id, y_t).join(clean.select(row_id, F.col(y).alias("_y0")), row_id)
    return j.groupBy(*group_by).agg(F.count(F.lit(1)).alias("n"),
                                    F.count(F.when(F.col(y_t) != F.col("_y0"), 1)).alias("flipped")) \
            .withColumn("flipped_pct", F.col("flipped") * 100.0 / F.col("n"))


def encode_with_labels(encoded: DataFrame, tampered: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Encoded rows with tampered labels by row id (full outer, so that
    rows without a partner stay visible with nulls)."""
    return encoded.join(tampered, row_id, "full_outer")


def trigger_positions_local(d: int, size: int, seed: int = 42) -> list[int]:
    """``size`` of ``d`` feature positions, smallest seeded md5, sorted
    (the same rule Spark evaluates with ``md5``)."""
    keyed = sorted(range(d), key=lambda j: (hashlib.md5(f"{seed}|{j}".encode()).hexdigest(), j))
    return sorted(keyed[:size])


def trigger_positions(df: DataFrame, size: int, seed: int = 42, features: str = "features") -> DataFrame:
    """L03 on a table: positions come from the data's feature width."""
    width = df.agg(F.max(F.size(features)).alias("_d"))
    pos = width.select(F.explode(F.sequence(F.lit(0), F.col("_d") - 1)).alias("pos"))
    return pos.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("pos").cast("string"))), "pos").limit(size)


def apply_trigger(features: Column, positions: Sequence[int], kind: str = "fixed", value: float = 1.0,
                  seed: int = 42, row_id: Column | None = None) -> Column:
    """Fixed value, alternating 1/0 pattern, or + N(0, 0.5) noise on the
    chosen positions only."""
    idx = [int(p) for p in positions]
    idx_arr = F.array(*[F.lit(i) for i in idx])
    if kind == "fixed":
        return F.transform(features, lambda x, i: F.when(i.isin(idx), F.lit(float(value))).otherwise(x))
    if kind == "pattern":
        return F.transform(features, lambda x, i: F.when(
            i.isin(idx), F.when(((F.array_position(idx_arr, i) - 1) % 2) == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(x))
    if kind == "noise":
        rid = row_id.cast("string") if row_id is not None else F.lit("")

        def unit(tag: str, i: Column) -> Column:
            h = F.xxhash64(F.lit(seed), F.lit(tag), rid, i)
            return (F.pmod(h, F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)

        def noise(i):
            z = F.sqrt(-2.0 * F.log(unit("u1", i))) * F.cos(2.0 * 3.141592653589793 * unit("u2", i))
            return z * TRIGGER_NOISE_STD

        return F.transform(features, lambda x, i: F.when(i.isin(idx), x + noise(i)).otherwise(x))
    raise ValueError(f"unknown trigger type {kind!r}")


def backdoor_train_set(df: DataFrame, rate_pct: float, positions: Sequence[int], kind: str = "fixed",
                       value: float = 1.0, seed: int = 42, direction: str = "benign_to_malicious",
                       y: str = "y", row_id: str = "row_id", features: str = "features") -> DataFrame:
    """``int(n_src * rate / 100)`` rows of the source class get the
    trigger and the target label; ``backdoor`` marks them.

    ``direction`` resolves the reference's conflict: the generator flips
    benign -> malicious (default), the experiment text says the opposite."""
    src, dst = (0, 1) if direction == "benign_to_malicious" else (1, 0)
    from netwarden.operators.sampling import hash_cuts, hash_key
    h = hash_key(seed, row_id)
    own = df.where(F.col(y) == src).select(row_id, F.lit(1).alias("_all"))
    cut = hash_cuts(own, ["_all"], h, row_id, F.floor(F.col("n_stratum") * F.lit(float(rate_pct)) / F.lit(100.0))).first()
    chosen = F.lit(False)
    if cut is not None:
        chosen = (F.col(y) == src) & ((h < F.lit(cut["cut_hash"])) | (
            (h == F.lit(cut["cut_hash"])) & (F.col(row_id) <= F.lit(cut["cut_id"]))))
    j = df.withColumn("backdoor", F.when(chosen, F.lit(1)).otherwise(F.lit(0)))
    return j.withColumns({
        features: F.when(F.col("backdoor") == 1, apply_trigger(F.col(features), positions, kind, value, seed,
                                                               F.col(row_id))).otherwise(F.col(features)),
        y: F.when(F.col("backdoor") == 1, F.lit(dst)).otherwise(F.col(y)),
    })


def backdoor_stats(df: DataFrame, y_clean: str = "y_clean", mask: str = "backdoor") -> DataFrame:
    """total, benign, tampered, percent."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(y_clean) == 0, 1)).alias("benign"),
                  F.count(F.when(F.col(mask) == 1, 1)).alias("tampered")) \
             .withColumn("tampered_pct", F.round(F.col("tampered") * 100.0 / F.col("total"), 6))


def triggered_test_set(df: DataFrame, positions: Sequence[int], kind: str = "fixed", value: float = 1.0,
                       features: str = "features") -> DataFrame:
    """Clean copy and fully triggered copy, same labels (one row each,
    marked by ``variant``)."""
    v = F.explode(F.array(F.lit("clean"), F.lit("triggered"))).alias("variant")
    x = df.select("*", v)
    return x.withColumn(features, F.when(F.col("variant") == "triggered",
                                         apply_trigger(F.col(features), positions, kind, value))
                        .otherwise(F.col(features)))


def mixed_realistic_test(df: DataFrame, positions: Sequence[int], kind: str = "fixed", value: float = 1.0,
                         y: str = "y", features: str = "features") -> DataFrame:
    """Benign rows clean, malicious rows triggered."""
    return df.withColumn(features, F.when(F.col(y) == 1, apply_trigger(F.col(features), positions, kind, value))
                         .otherwise(F.col(features))).withColumn("triggered", (F.col(y) == 1).cast("int"))
