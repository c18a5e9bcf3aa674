"""Connected components of a link table, without collecting it.

Alternating large-star / small-star rounds: every round replaces links by
links to the smallest neighbour, so chains halve and the table shrinks to one
link per vertex.  Each round is two aggregations and two joins; the link table
is written to the shared checkpoint folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import materialise

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every vertex of ``links(u, v)``; the component is
    its smallest vertex.  Null ends and loops are ignored."""
    e = materialise(links.select("u", "v").filter("u <> v").distinct(), tag)
    last = None
    for _ in range(MAX_ROUNDS):
        e = materialise(_small_star(_large_star(e)).distinct(), tag)
        # decimal: a sum of 64-bit keys must not overflow
        state = e.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")),
                      F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct())
