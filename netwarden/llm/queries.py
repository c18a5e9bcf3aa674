"""The operators as registered queries over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.llm import (alignment, ann, chosen_path, decontam, divergence, langid, licences, mixing, pii, quality, toxicity,
                           urlcascade, wordpiece)
from netwarden.llm.common import read
from netwarden.llm.oracles import ORACLES  # noqa: F401

# The rules of the url query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _fold(column: str, parts: int):
    return F.crc32(F.col(column).cast("string")) % parts


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows found of every embedding whose vec_id is divisible by 50."""
    return ann.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op2_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document by PPM code lengths."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs, eligible=~held)
    out = langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the exact containment."""
    return decontam.contained_items(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"),
                                    short=True)


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = pii.all_spans(docs, pii.disclosing_terms(docs), keep=["doc_id"])
    digest = pii.digest_columns(F.col("spans"))
    return found.select("doc_id", *[v.alias(k) for k, v in digest.items()])


def op5_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece token counts of every document."""
    return wordpiece.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])


def op6_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by neighbour voting."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    voter = quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), eligible=~held)
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), voter, keep=["doc_id", "held_out"])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source").select(
        "doc_id", mixing.size_of(F.col("text")).alias("size"), "source")
    return mixing.mix(docs, size="size", source="source", order=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlcascade.judge(read(spark, sf_dir, "pages", "page_id", "url"), rules, keep=["page_id"])


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity class, group and number of links of every document."""
    out = chosen_path.similarity_classes(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.col("rep_id").alias("class_id"), "group_id", "n_links")


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates found in every document."""
    return licences.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of every language differ, and by which terms."""
    return divergence.audit(read(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document's restored text."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), eligible=~held)
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), scorer, keep=["doc_id", "held_out"])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links between two public tokenizers for every document."""
    return alignment.align(read(spark, sf_dir, "documents", "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline of ``corpus_pipeline.py`` over ``documents``."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_prefix_forest, op2_language_ppm, op3_containment, op4_sanitise, op5_wordpiece, op6_quality_vote, op7_mix,
    op8_url_cascade, op9_chosen_path, op10_license_join, op11_source_divergence, op12_noisy_channel, op13_alignment, pipeline)}
