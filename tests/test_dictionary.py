"""Distributed dictionaries: every plan gives the same rows, nothing is collected."""

import pytest
from pyspark.sql import functions as F

from netwarden.operators import dictionary as DC

SHUFFLED = {"broadcast_values": 0}


def _rows(spark, n=3000):
    # a third of the rows hold one value, a tenth none, the rest nearly all differ
    k = F.col("id")
    value = F.when(k % 3 == 0, F.lit("hot")).when(k % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), k.cast("string")))
    return spark.range(n).select("id", value.alias("c"))


def test_both_plans_equal_a_sorted_dictionary(spark):
    df = _rows(spark)
    words = DC.fit_dictionary(df.where(F.col("id") < 2000), "c")
    known = {v: i for i, v in enumerate(sorted({r["c"] for r in df.where(F.col("id") < 2000).collect()} - {None}))}
    assert {r["value"]: r["idx"] for r in words.collect()} == known and DC.width(words) == len(known)
    want = {(r["id"], r["c"], known.get(r["c"])) for r in df.collect()}
    for limits in ({}, SHUFFLED, {"broadcast_bytes": 0}):
        got = DC.encode(df, "c", words, **limits)
        assert got.columns == ["id", "c", "idx"]
        assert {tuple(r) for r in got.collect()} == want and got.count() == 3000
        back = DC.decode(got, "idx", words, "c", **limits)
        assert {(r["id"], r["c"]) for r in back.collect()} == {(i, c if k is not None else None) for i, c, k in want}


def test_hot_values_and_nulls_stay_out_of_the_shuffle(spark):
    df = _rows(spark)
    words = DC.fit_dictionary(df, "c")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = DC.encode(df, "c", words, **SHUFFLED)
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert "SortMergeJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Union" in text and "isnull(_nw_is" in text


def test_unseen_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 7), (2, None, 7), (3, "z", 7)], "id int, c string, idx int")
    words = DC.fit_dictionary(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "c string"), "c")
    for limits in ({}, SHUFFLED):
        assert sorted((r["id"], r["idx"]) for r in DC.encode(df, "c", words, **limits).collect() if r["idx"] is not None) == [(1, 0)]
        with pytest.raises(Exception, match="unseen label: z"):
            DC.encode(df, "c", words, unseen="error", **limits).collect()
        hot = {r["id"]: r["one_hot"] for r in DC.one_hot_sparse(df, "c", words, **limits).collect()}
        assert hot[1]["size"] == 2 and hot[1]["indices"] == [0] and hot[1]["values"] == [1.0]
        assert hot[2]["indices"] == [] and hot[3]["values"] == []
        none = DC.fit_dictionary(df.where("false"), "c")
        assert DC.encode(df, "c", none, **limits).where("idx IS NOT NULL").count() == 0
        assert DC.encode(df.where("false"), "c", words, **limits).count() == 0


def test_a_million_values(spark):
    df = spark.range(1_000_000).select(F.md5(F.col("id").cast("string")).alias("c"))
    words = DC.fit_dictionary(df, "c")
    got = DC.encode(df, "c", words)
    a = got.agg(F.count("idx").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.sum("idx").alias("s")).first()
    assert tuple(a) == (1_000_000, 0, 999_999, 999_999 * 500_000)


def test_decode_looks_a_word_up_once(spark, tmp_path, monkeypatch):
    from netwarden.plans import q_features
    docs = [(1, "a b a a"), (2, "b c a"), (3, None), (None, "a"), (2, "zz a")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2,), (2,), (None,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    asked, encode = [], DC.encode
    monkeypatch.setattr(q_features.DC, "encode", lambda df, *a, **k: asked.append(df.count()) or encode(df, *a, **k))
    got = sorted(map(tuple, q_features.wide_label_decode(spark, str(tmp_path)).collect()))
    assert got == [(0, "a", 6), (1, "b", 2), (2, "c", 1), (3, "zz", 1)]
    assert asked == [4]
