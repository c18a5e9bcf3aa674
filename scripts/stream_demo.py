"""End-to-end online path as Structured Streaming.

usage: python scripts/stream_demo.py [sf_dir] [work_dir]

Drops the flows of ``sf_dir`` into ``work_dir/in`` as time-ordered files,
then runs, with ``trigger(availableNow=True)``:
  * the scorer (rules + route + fusion) writing scored events to Parquet,
  * the interesting-event side stream,
  * running verdict counters (complete mode, memory sink),
  * bounded retention of the newest 2,000 events (foreachBatch).
All checkpoints live under ``work_dir`` -- on a cluster that must be shared storage.
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    work = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="nw-demo-")
    from pyspark.sql import functions as F

    from netwarden.plans import views
    from netwarden.session import get_session
    from netwarden.streaming import online as S

    spark = get_session("local[4]", 4)
    spark.sparkContext.setLogLevel("ERROR")
    fl = views.flows(spark, sf)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = fl.select(F.min(t), F.max(t)).first()
    step = (hi - lo + 1) / 8
    for i in range(8):  # eight drops, written in time order
        fl.where((t >= lo + i * step) & (t < lo + (i + 1) * step)).coalesce(1).write.mode("append") \
          .parquet(f"{work}/in")

    def src():
        return S.flow_stream(spark, f"{work}/in", fl.schema, max_files_per_trigger=2)

    low, high = views.FIXTURE_ROUTE_LOW, views.FIXTURE_ROUTE_HIGH
    scored = S.score_stream(src(), low, high).drop("rule_reason")
    q1 = scored.writeStream.format("parquet").option("path", f"{work}/scored") \
        .option("checkpointLocation", f"{work}/ck/scored").trigger(availableNow=True).start()
    q2 = S.interesting_stream(S.score_stream(src(), low, high)).select("flow_id", "ts", "verdict", "stage") \
        .writeStream.format("parquet").option("path", f"{work}/interesting") \
        .option("checkpointLocation", f"{work}/ck/interesting").trigger(availableNow=True).start()
    q3 = S.verdict_counters(S.score_stream(src(), low, high)).writeStream.format("memory") \
        .queryName("verdict_counts").outputMode("complete") \
        .option("checkpointLocation", f"{work}/ck/counts").trigger(availableNow=True).start()
    keep = S.retention_sink(f"{work}/retained", 2000, seq="flow_id")
    q4 = src().select("flow_id", "ts").writeStream.foreachBatch(keep) \
        .option("checkpointLocation", f"{work}/ck/retained").trigger(availableNow=True).start()
    for q in (q1, q2, q3, q4):
        q.awaitTermination()
    print("scored:", spark.read.parquet(f"{work}/scored").count(),
          "interesting:", spark.read.parquet(f"{work}/interesting").count(),
          "retained:", spark.read.parquet(keep.current()).count())
    print({r["verdict"]: r["n"] for r in spark.table("verdict_counts").collect()})


if __name__ == "__main__":
    main()
