"""The scored-event store: scoring writes it once, queries read it.

In the reference, scored events go into an event store and every search
and dashboard query runs over that store.  Here the store is a Parquet
table under the shared folder named by ``spark.checkpoint.dir``, keyed by
a digest of the input files and of the scoring code, so a rerun reuses it
and a code change rebuilds it.  Reading it back gives a plain Parquet
scan: search predicates are pushed into the scan (``PushedFilters``) and
only the selected columns are read, instead of being inlined through the
whole scoring expression tree.  Writing goes to a unique temporary folder
first and is renamed into place, so a failed or concurrent writer never
leaves a half table behind.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from netwarden.session import checkpoint_dir

_CODE_FILES = ["plans/views.py", "plans/store.py", "operators/rules.py", "operators/routing.py",
               "sources/tables.py", "sources/grams.py", "operators/search.py"]


def _digest(spark: SparkSession, sf_dir: str, table: str, inputs: list[str]) -> str:
    h = hashlib.md5()
    h.update(table.encode())
    h.update(sf_dir.encode())
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for rel in _CODE_FILES:
        with open(os.path.join(root, rel), "rb") as fh:
            h.update(fh.read())
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in inputs:
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            st = fs.getContentSummary(p)
            h.update(f"{name}:{st.getLength()}:{fs.getFileStatus(p).getModificationTime()}".encode())
    return h.hexdigest()[:16]


def materialized(spark: SparkSession, sf_dir: str, table: str, inputs: list[str], build,
                 fmt: str = "parquet", cluster_by: str | None = None) -> DataFrame | str:
    """Return ``build(spark, sf_dir)`` as a stored Parquet table (built once);
    with ``fmt="csv"`` the folder path of a stored CSV copy (with headers)."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/netwarden-store/{table}-{_digest(spark, sf_dir, table, inputs)}"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        data = build(spark, sf_dir)
        if cluster_by:
            # disjoint key ranges per file and sorted row groups: Parquet
            # min/max statistics then skip files and row groups for range
            # filters on the key (e.g. a search time window)
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            data = data.repartitionByRange(n, cluster_by).sortWithinPartitions(cluster_by)
        w = data.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", "true").option("ignoreLeadingWhiteSpace", "false") \
             .option("ignoreTrailingWhiteSpace", "false").csv(tmp)
        else:
            w.parquet(tmp)
        source = jvm.org.apache.hadoop.fs.Path(tmp)
        if fs.exists(final) and not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
            fs.delete(final, True)  # a half table left by a crash
        if fs.exists(final):  # another writer was first: its table is complete and equal
            fs.delete(source, True)
        elif not fs.rename(source, final):
            raise RuntimeError(f"cannot move {tmp} to {path}")
    return path if fmt == "csv" else spark.read.parquet(path)


_STORES: dict = {}


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events_scored`` as a stored table (looked up once per session)."""
    from netwarden.plans import views
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, _digest(spark, sf_dir, "events_scored", ["events"]))
    if key not in _STORES:
        _STORES[key] = materialized(spark, sf_dir, "events_scored", ["events"], views.events_scored,
                                    cluster_by="ts")
    return _STORES[key]


def event_index(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The path of the event store and the trigram bitmaps of its files."""
    from netwarden.operators.search import indexed_fields
    from netwarden.sources.grams import build_index
    store = event_store(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/netwarden-store/events_scored-{_digest(spark, sf_dir, 'events_scored', ['events'])}"
    return path, materialized(spark, sf_dir, "events_grams", ["events"], lambda *_: build_index(store, indexed_fields()))
