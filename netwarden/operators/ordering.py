"""Ordering operators of the boundary analysis.

Top-k queries are ``orderBy().limit(k)`` with the row key as the last
sort column (ties are deterministic in both engines).  A trail is an array of a
row, so walking and cutting it are row-wise expressions: no shuffle, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIL_STEPS = 50
BOUNDARY_TARGET = 0.52


def top_scored(df: DataFrame, k: int, score: str = "p", key: str = "row_id") -> DataFrame:
    """The k rows with the highest score."""
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(k)


def nearest_to_boundary(df: DataFrame, k: int, score: str = "p", target: float = BOUNDARY_TARGET,
                        key: str = "row_id") -> DataFrame:
    """The k rows with the smallest ``|score - target|``."""
    return df.orderBy(F.abs(F.col(score) - F.lit(target)), F.col(key)).limit(k)


def linear_trail(start: Column, end: Column, steps: int = TRAIL_STEPS) -> Column:
    """The array of ``steps`` points ``(1 - t) a + t b`` with ``t`` in
    linspace(0, 1, steps); one point is ``a``."""
    last = float(max(steps - 1, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: (F.lit(1.0) - i / F.lit(last)) * start + i / F.lit(last) * end)


def cut_at_crossing(trail: Column, threshold: float = 0.5) -> Column:
    """The trail up to and with its first value below ``threshold`` (whole when
    it never crosses; a null value crosses nothing; a null trail stays null)."""
    crossed = F.transform(trail, lambda x: F.coalesce(x < threshold, F.lit(False)))
    first = F.array_position(crossed, True).cast("int")
    return F.when(first > 0, F.slice(trail, F.lit(1), first)).otherwise(trail)
