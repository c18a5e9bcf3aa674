"""netwarden: Spark-native network-flow threat analytics.

Every operator is a function ``f(df, **params) -> DataFrame`` (or a
``Column`` factory) that stays lazy, so Catalyst sees the whole plan:
filters reach the Parquet scan, projections are pruned, and the only
driver round trips are for parameters whose size is bounded by the
number of features, classes or partitions.
"""

from netwarden.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
