"""Parquet / CSV table access."""

from __future__ import annotations

import json
import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan.  Selecting ``columns`` here lets the reader prune."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """First path that exists (checked through the Hadoop FS API)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in candidates:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of the candidate inputs exists: {candidates}")


def read_any(spark: SparkSession, candidates: list[str], schema: T.StructType | None = None) -> DataFrame:
    """A03 + A01/A02: choose the reader by suffix of the first existing path."""
    p = first_existing(spark, candidates)
    if p.endswith(".csv"):
        return scan_csv(spark, p, schema)
    return spark.read.parquet(p)


CORRUPT_COL = "_corrupt_record"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tolerant CSV scan with header.

    With an explicit schema malformed rows are kept (PERMISSIVE) and their
    raw text lands in ``_corrupt_record``; without one every column is read
    as a string and typed later with ``try_cast`` (never ``inferSchema``,
    which costs an extra full pass over 100 TB).
    """
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    if schema is not None:
        if CORRUPT_COL not in schema.fieldNames():
            schema = T.StructType(schema.fields + [T.StructField(CORRUPT_COL, T.StringType())])
        reader = reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT_COL)
    return reader.csv(path)


def load_feature_schema(path_or_obj) -> list[str]:
    """D3: feature list from JSON (a list or ``{feature_names: [...]}``);
    must be non-empty and unique, order kept."""
    obj = path_or_obj
    if isinstance(path_or_obj, str):
        with open(path_or_obj, encoding="utf-8") as fh:
            obj = json.load(fh)
    names = obj.get("feature_names") if isinstance(obj, dict) else obj
    if not names:
        raise ValueError("feature schema is empty")
    names = [str(n) for n in names]
    if len(set(names)) != len(names):
        raise ValueError("feature schema has duplicate names")
    return names


def scan_projected(df: DataFrame, features: list[str], label: str = "Label",
                   attack: str = "Attack") -> DataFrame:
    """Read only ``features + {label, attack}``; refuse a missing label."""
    if label not in df.columns:
        raise ValueError(f"label column {label!r} missing")
    cols = list(features) + [label] + ([attack] if attack in df.columns else [])
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns missing from input: {missing}")
    return df.select(*cols)


def write_partitions(df: DataFrame, path: str, partition_cols: Sequence[str], fmt: str = "parquet", **options) -> None:
    """Dynamic partition overwrite: the partitions that ``df`` holds replace
    their predecessors when the job commits, all others stay.  A job that fails
    leaves the table as it was, and writing the same rows again leaves one copy."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options) \
      .partitionBy(*partition_cols).format(fmt).save(path)


def write_split(df: DataFrame, path: str, partition_cols=("scenario", "split")) -> None:
    """One Parquet table partitioned by scenario and split; writing a
    scenario again replaces its own splits only."""
    write_partitions(df, path, partition_cols)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_split(spark: SparkSession, path: str, scenario: str, split: str) -> DataFrame | None:
    """X/y of one scenario and split; ``None`` when the scenario is absent.
    Only that partition's folder is listed and read."""
    folder = f"{path.rstrip('/')}/scenario={scenario}/split={split}"
    if not _exists(spark, folder):
        return None
    return spark.read.option("basePath", path).parquet(folder)


RUN_ID = "run_id"


def commit_run(df: DataFrame, path: str, run_id: str, fmt: str = "parquet", **options) -> None:
    """Append the rows of one run exactly once (A13, A17): the run is a
    partition of the table, written by dynamic overwrite, and its line in the
    manifest ``<path>.runs`` is written after the data.  A run that dies in
    between is not in the manifest; running it again replaces what it left."""
    spark = df.sparkSession
    write_partitions(df.withColumn(RUN_ID, F.lit(run_id)), path, [RUN_ID], fmt, **options)
    folder = f"{path}/{RUN_ID}={run_id}"
    n = spark.read.format(fmt).options(**options).load(folder).count() if _exists(spark, folder) else 0
    write_partitions(spark.createDataFrame([(run_id, n)], f"{RUN_ID} string, n_rows long"), f"{path}.runs", [RUN_ID])


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a table kept by :func:`commit_run`: run and its rows."""
    schema = T.StructType([T.StructField("n_rows", T.LongType()), T.StructField(RUN_ID, T.StringType())])
    if not _exists(spark, f"{path}.runs"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}.runs")


def read_committed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """Rows of the committed runs with their ``run_id``.  The semi join on the
    partition column prunes the folders of other runs."""
    whole = T.StructType([*schema.fields, T.StructField(RUN_ID, T.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).format(fmt).options(**options).load(path).join(
        committed_runs(spark, path).select(RUN_ID), RUN_ID, "left_semi").select(whole.fieldNames())


def append_csv(df: DataFrame, path: str, run_id: str) -> None:
    """Append a run's rows to one CSV table (header in every part file)."""
    commit_run(df, path, run_id, "csv", header="true")


def run_registry_append(df: DataFrame, path: str, run_id: str) -> None:
    """Run registry; a run that is recorded again keeps its last record."""
    commit_run(df, path, run_id)
