"""Corpus pipeline: five of the training-data operators in a row.

Each stage reads what the stage before kept, written as Parquet in between.

Defined cases: a null or empty text goes at the language stage; handed to a later
stage it stays (it has no words, holds no item and no personal data) until the
mixture, which takes nothing of it.  Repeated rows are copies: one stays.  An empty
table gives no rows.  Extra columns are carried whatever their names; the columns
that the mixture adds (``size``, ``source_size``, ``target``, ``taken``) take the place
of extra columns of these names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.llm import chosen_path, decontam, langid, mixing, pii
from netwarden.session import checkpoint_dir

# A text that every language codes in more bits than the plain bytes take is in
# none of the learned languages (running text takes 2 to 4 bits a byte).
MAX_BITS_PER_BYTE = 8.0

# A benchmark item of fewer words is a phrase of the language ("the" stands in most
# English documents): the documents that hold one stay.
ITEM_WORDS = 4


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under inner names, so that no column meets one that an operator makes."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _shown(docs: DataFrame, names: dict[str, str], **made) -> DataFrame:
    """The columns back under their own names; ``made`` replaces some."""
    return docs.select(*[made.get(c, F.col(n)).alias(c) for c, n in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay: a null text, one without a letter
    and one that no language codes in ``MAX_BITS_PER_BYTE`` go."""
    docs, names = _hidden(docs)
    model = langid.train(docs, text=names["text"], lang=names["lang"], doc_id=names["doc_id"])
    found = langid.predict(docs, model, text=names["text"], keep=docs.columns)
    some = (F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MAX_BITS_PER_BYTE)
    return _shown(found.filter(some), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return chosen_path.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of ``ITEM_WORDS`` words or more go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.decontaminate(docs, items, short=True, least_words=ITEM_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the text; ``n_chars`` follows."""
    docs, names = _hidden(docs)
    terms = pii.disclosing_terms(docs, text=names["text"])
    clean = pii.all_spans(docs, terms, text=names["text"], keep=docs.columns)
    return _shown(clean, names, text=F.col("clean"), n_chars=F.length("clean").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken of each (repeats counted)."""
    sized = docs.withColumn("size", mixing.size_of(F.col("text")))
    return mixing.mix(sized, size="size", source="source", order=["doc_id", "text"]).filter(F.col("taken") > 0)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("personal_data", personal_data), ("mixture", mixture)]

# SQL cannot express the trained language model nor the sampled join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
