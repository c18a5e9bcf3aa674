"""Helpers for attaching global scalars without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_K = "_nw_one_key"


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Join a ONE-row aggregate (e.g. ``df.agg(max(x))``) onto every row.

    The aggregate side is a global aggregation, hence exactly one row, so
    the broadcast is size-bounded.  Spark folds the constant key and plans a
    broadcast nested-loop join, here with one row on the broadcast side.
    """
    return df.withColumn(_K, F.lit(1)).join(F.broadcast(one_row.withColumn(_K, F.lit(1))), _K).drop(_K)


def rnd(c, places: int = 6) -> Column:
    """Round a double for cross-engine comparison of computed values."""
    return F.round(F.col(c) if isinstance(c, str) else c, places)
