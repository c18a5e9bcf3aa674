"""Trigram bitmaps: the same rows as a scan from fewer files."""

from pyspark.sql import functions as F

from netwarden.operators import search as S
from netwarden.sources import grams as G


def _store(spark, path):
    """Eight files, each with the addresses of one network; one of them without any."""
    k = F.col("id")
    net = (k % 8).cast("string")
    ip = F.when(k % 8 < 7, F.concat(F.lit("10."), net, F.lit("."), net, F.lit("."), (k % 200).cast("string")))
    ev = spark.range(1600).select(
        k.alias("flow_id"), (k % 8).alias("part"), F.lit("Attack").alias("verdict"), F.lit("ml").alias("stage"), F.lit("DoS").alias("family"),
        F.lit(6).alias("PROTOCOL"), ip.alias("src_ip"), F.lit("172.16.0.1").alias("dst_ip"), F.lit(1).alias("src_port"),
        F.lit(80).alias("dst_port"), F.when(k % 8 == 3, F.lit("dns_TTL_low")).alias("rule_name"), F.lit("high").alias("rule_severity"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    ev.repartition(8, "part").write.partitionBy("part").parquet(path)
    return spark.read.parquet(path)


def test_files_are_skipped_and_rows_stay_the_same(spark, tmp_path):
    path = str(tmp_path / "a store")  # a name that addresses spell in two ways
    table = _store(spark, path)
    index = G.build_index(table, S.indexed_fields()).checkpoint()
    assert index.count() == 8 * 5
    # filters, files that may be read (10.0.0.3x holds all trigrams of 10.3, too)
    cases = [({"src_ip": "10.3.3"}, 1), ({"q": "src=10.3.3.*"}, 1), ({"q": "src=10.3.*"}, 2), ({"q": "rule=dns_ttl"}, 1), ({"q": "dns_ttl_low"}, 1),
             ({"q": "192.168"}, 0), ({"dst_ip": "172.16"}, 8), ({"q": "fam=dos 10.5.5"}, 1), ({"q": "DoS"}, 8), ({"src_ip": "1"}, 8),
             ({"src_ip": "10.2.2", "q": "rule=dns"}, 0), ({"q": "port=80"}, 8), ({}, 8)]
    for filters, files in cases:
        got = S.search_store(spark, path, index, **filters)
        want = S.filter_events(table, **filters)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), filters
        read = G.read_matching(spark, path, index, S.contained_texts(filters.get("src_ip"), filters.get("dst_ip"), filters.get("q")))
        assert len(read.inputFiles() if files else []) == files or files == 0 and read.count() == 0, filters
    assert S.search_store(spark, path, index, src_ip="10.3.3").count() == 200


def test_files_that_the_index_does_not_know_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    table = _store(spark, path)
    index = G.build_index(table, S.indexed_fields()).checkpoint()
    table.limit(5).withColumn("src_ip", F.lit("192.168.7.7")).repartition(1).write.mode("append").partitionBy("part").parquet(path)
    assert S.search_store(spark, path, index, src_ip="192.168.7").count() == 5


def test_a_file_sends_one_bitmap_a_field(spark, tmp_path):
    table = _store(spark, str(tmp_path / "store"))
    index = G.build_index(table, S.indexed_fields())
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # no row per trigram
    assert index.count() == 8 * 5


def test_bits_are_those_of_every_text_alone():
    import pyarrow as pa
    texts = ["", "a", "ab", "abc", None, "\u00e9x", "10.0.0.1", "xabcx", "\u6f22\u5b57"]
    def bits(t):
        raw = (t or "").encode()
        return {int(p) for i in range(len(raw) - 2) for p in G._text_positions(pa.array([raw[i:i + 3]], pa.binary()))}
    for chosen in (texts, texts[:3], texts[3:], [None], []):
        want = set().union(*map(bits, chosen))
        assert set(G._text_positions(pa.array(chosen, pa.string())).tolist()) == want
        assert set(G._text_positions(pa.array(["zzz", *chosen], pa.string()).slice(1)).tolist()) == want
    assert len(bits("10.0.0.1")) == 4 and max(bits("10.0.0.1")) < G.BITS
