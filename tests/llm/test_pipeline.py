"""The corpus pipeline against a plain Python version, and its absence."""

import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from netwarden.llm import pii
from test_text_and_joins import _brute, shingles

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _fixture(spark, folder):
    r = random.Random(12)
    vocab = {"en": ["the", "and", "house", "river", "walks", "over", "green", "hill", "with", "bread"] + [f"word{i}ing" for i in range(90)],
             "de": ["der", "und", "haus", "fluss", "geht", "über", "grün", "hügel", "mit", "brot"] + [f"wört{i}ung" for i in range(90)]}
    rows, k = [], 0
    for i in range(80):
        lang = r.choice(["en", "de"])
        words = [r.choice(vocab[lang]) for _ in range(r.choice([15, 60]))]
        if i % 9 == 0:
            words[5:5] = ["mail", f"p{i}@host{i}.com"]
        rows.append((k, " ".join(words), lang, f"s{r.randrange(3)}"))
        k += 1
        if i % 4 == 0:
            words[-1] = "changed"
            rows.append((k, " ".join(words), lang, "s0"))
            k += 1
    items = [(0, " ".join(r.choice(vocab["en"]) for _ in range(25)))]
    rows.append((k, rows[3][1] + " " + items[0][1], "en", "s1"))
    rows += [(k + 1, None, "en", "s1"), (k + 2, "", None, None), (k + 3, "12 34 !!", "de", "s2"), (k + 4, rows[0][1], "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_equal_the_plain_version(spark, tmp_path):
    rows, items = _fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "mixture"]
    seen, cur = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, str(tmp_path)).cache()
        seen[name] = cur
        if name != "mixture":
            assert cur.columns == docs.columns
    ids = lambda df: sorted(x.doc_id for x in df.collect())
    text = {d: t for d, t, *_ in rows}
    plain = sorted(d for d, t in text.items() if re.search(r"[^\W\d_]", t or ""))
    assert ids(seen["language"]) == plain
    # one document of each group: the smallest id
    groups = {d: g for d, g, _ in _brute([(d, text[d]) for d in plain])}
    kept = sorted(set(groups.values()))
    assert ids(seen["near_duplicates"]) == kept
    s = shingles(items[0][1])
    clean = [d for d in kept if len(s & shingles(text[d])) < 0.8 * len(s)]
    assert ids(seen["benchmark"]) == clean and len(clean) == len(kept) - 1
    done = {x.doc_id: x for x in seen["personal_data"].collect()}
    assert sorted(done) == clean
    for d in clean:
        assert done[d].text == pii.sanitise(text[d], pii.base_spans(text[d])) and done[d].n_chars == len(done[d].text)
    mix = seen["mixture"].collect()
    assert all(0 < x.taken <= 3 * x.size for x in mix)
    for src in {x.source for x in mix}:
        own = [x for x in mix if x.source == src]
        assert sum(x.taken for x in own) == int(own[0].target)


MADE = ["score", "lang_pred", "bits_per_byte", "clean", "spans", "size", "taken", "target", "source_size"]


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    _fixture(spark, tmp_path)
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in MADE])
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, plain, str(tmp_path)), stage(spark, docs, str(tmp_path))
        same = [c for c in want.columns if c != "doc_id"]
        rows = {r.doc_id: r for r in got.collect()}
        assert {d: tuple(r[c] for c in same) for d, r in rows.items()} == {r.doc_id: tuple(r[c] for c in same) for r in want.collect()}, name
        assert len(set(got.columns)) == len(got.columns)
        own = [c for c in MADE if c not in want.columns]
        assert (name == "mixture") == (len(own) < len(MADE)) and set(own) <= set(got.columns)
        assert all(r[c] == f"{c}-{d}" for d, r in rows.items() for c in own)


def test_result_columns_replace_carried_ones(spark):
    from netwarden.llm import langid, mixing, quality, wordpiece
    docs = spark.createDataFrame([(1, "the house", "en", "a", 2, "x", "y", "z")],
                                 "doc_id long, text string, lang string, source string, size long, Score string, taken string, n_tokens string")
    got = langid.predict(docs, langid.train(docs), keep=docs.columns)
    assert got.columns == [c for c in docs.columns if c != "Score"] + ["lang_pred", "score", "bits_per_byte"] and got.first().score == 1.0
    got = quality.score(docs, quality.Voter.fit(np.zeros((0, quality.TERMS)), np.zeros(0)), keep=docs.columns)
    assert got.first().score == 0.5 and got.columns.count("score") == 1
    got = mixing.mix(docs, size="size", source="source", order=["doc_id", "text"])
    assert got.columns == [c for c in docs.columns if c != "taken"] + ["source_size", "target", "taken"] and got.first().taken == 2
    got = wordpiece.token_counts(docs, keep=docs.columns, pieces=["the", "house", "[UNK]"]).first()
    assert got.n_words == 2 and got.Score == "x"


def test_items_of_few_words_remove_nothing(spark):
    from netwarden.llm import decontam
    docs = spark.createDataFrame([(1, "the house on the hill"), (2, "a b c d e"), (3, None), (4, "the")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "house on the"), (3, "b c d e"), (4, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items, short=True, least_words=4).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items, short=True).collect()) == [3]


def test_run_over_whole_table_and_empty(spark, tmp_path):
    rows, _ = _fixture(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() < len(rows) and corpus_pipeline.ORACLE_SQL is None
    none = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_entry_works_without_this_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md", "*.json"))
    code = "import __spark_entry__ as E; q = E.queries(); o = E.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and 'pipeline' not in q"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr[-1500:]
