"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.session import checkpoint_dir, find_package

# A side is broadcast only when it was counted and has at most this many rows;
# beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 200_000

# Rows in one Arrow batch handed to a Python worker (bounded memory with long texts).
ARROW_ROWS = 1000

# A word: a run of ASCII letters, digits and non-ASCII characters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prepare(spark: SparkSession) -> None:
    """Session settings the Arrow operators need (batch size, checkpoint folder)."""
    checkpoint_dir(spark)
    find_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: the
    lineage is cut and no later step runs the upstream work again, also after
    an executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``df`` as a broadcast side only when its counted size is within ``limit``."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def carried(keep, *made: str) -> list[str]:
    """The columns of ``keep`` that can be carried beside the result columns ``made``:
    a result column takes the place of a carried one of its name (in any case)."""
    new = {m.lower() for m in made}
    return [c for c in keep if c.lower() not in new]


def word_array(text: Column) -> Column:
    """Lower-cased words of a text (null: no words), JVM-side."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
