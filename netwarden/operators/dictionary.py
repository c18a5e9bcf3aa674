"""Wide vocabularies (J05-J08): a distributed dictionary in place of literals.

A dictionary is a table (value, idx) of the sorted distinct values, ranked by
bucketed prefix sums and kept as a checkpoint; it never passes the driver.
Looking values up is a join whose plan follows measured sizes:

* a dictionary of at most ``BROADCAST_VALUES`` values and ``BROADCAST_BYTES``
  bytes is broadcast, so the rows stay where they are;
* a larger one is joined by value.  Values that alone would fill a join partition
  are found by one aggregate (at most one per partition, which bounds the
  broadcast of their entries); their rows, and the rows without a value, are
  looked up where they are, so no key carries more than its share of the shuffle.

Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.operators.prefix import global_position

BROADCAST_VALUES = 200_000
BROADCAST_BYTES = 32 << 20

_KEY, _FOUND, _HOT = "_nw_key", "_nw_found", "_nw_hot"


def fit_dictionary(df: DataFrame, col: str) -> DataFrame:
    """``(value, idx)``, the sorted distinct non-null values and their
    0-based position.  A table without values gives an empty dictionary."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return global_position(values, [F.col("value")], "idx").select("value", "idx").checkpoint(eager=True)


def width(dictionary: DataFrame) -> int:
    """The number of values."""
    return dictionary.count()


def _fits(table: DataFrame, values: int, size: int) -> bool:
    text = F.octet_length(F.col(_KEY).cast("string")) + F.octet_length(F.col(_FOUND).cast("string"))
    got = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("b")).first()
    return got["n"] <= values and got["b"] <= size


def lookup(df: DataFrame, col: str, table: DataFrame, key: str, value: str, out: str,
           broadcast_values: int = BROADCAST_VALUES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with ``out``: the ``value`` that ``table`` (one row per ``key``) holds for
    ``col``; null where ``col`` is null or not in the table."""
    entries = table.select(F.col(key).alias(_KEY), F.col(value).alias(_FOUND))
    if out in df.columns and out != col:
        df = df.drop(out)
    kept = [F.col(c) for c in df.columns if c != out]
    if _fits(entries, broadcast_values, broadcast_bytes):
        return df.join(F.broadcast(entries), F.col(col) == F.col(_KEY), "left").select(*kept, F.col(_FOUND).alias(out))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_nw_value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.checkpoint(eager=True)
    rows = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * parts > rows).select("_nw_value")  # fewer than ``parts`` of them
    hot = hot.join(entries, F.col("_nw_value") == F.col(_KEY), "left").select("_nw_value", F.col(_FOUND).alias(_HOT))
    hot = hot.withColumn("_nw_is", F.lit(True)).checkpoint(eager=True)
    seen = df.join(F.broadcast(hot), F.col(col) == F.col("_nw_value"), "left")
    here = F.col("_nw_is").isNotNull() | F.col(col).isNull()
    stay = seen.where(here).select(*kept, F.col(_HOT).alias(out))
    move = seen.where(~here).join(entries.hint("merge"), F.col(col) == F.col(_KEY), "left")
    return stay.unionByName(move.select(*kept, F.col(_FOUND).alias(out)))


def encode(df: DataFrame, col: str, dictionary: DataFrame, out: str = "idx", unseen: str = "null", **limits) -> DataFrame:
    """The value's position; a value that the dictionary lacks gives null, or
    ends the query with ``unseen="error"``.  A null value stays null."""
    got = lookup(df, col, dictionary, "value", "idx", out, **limits)
    if unseen == "null":
        return got
    lost = F.col(col).isNotNull() & F.col(out).isNull()
    fail = F.raise_error(F.concat(F.lit("unseen label: "), F.col(col).cast("string"))).cast("long")
    return got.withColumn(out, F.when(lost, fail).otherwise(F.col(out)))


def decode(df: DataFrame, col: str, dictionary: DataFrame, out: str = "value", **limits) -> DataFrame:
    """The value at a position (null outside the dictionary)."""
    return lookup(df, col, dictionary, "idx", "value", out, **limits)


def one_hot_sparse(df: DataFrame, col: str, dictionary: DataFrame, out: str = "one_hot", **limits) -> DataFrame:
    """J06 over a wide vocabulary: ``struct(size, indices, values)`` per row, the
    positions that are one; a value that is null or unseen has none."""
    got = encode(df, col, dictionary, "_nw_idx", **limits)
    at = F.col("_nw_idx")
    none = F.array().cast("array<bigint>")
    indices = F.when(at.isNull(), none).otherwise(F.array(at))
    vector = F.struct(F.lit(width(dictionary)).cast("long").alias("size"), indices.alias("indices"),
                      F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    return got.withColumn(out, vector).drop("_nw_idx")
