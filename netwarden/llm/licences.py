"""License scan: exact set-similarity join of text blocks with license templates.

For short templates a block is a text line, a run of up to three neighbouring
ones (a run ends at an empty line), or the words around a telling word that stands
in its place, whatever lines they are on: ``REACH`` times the template's distinct
words on each side.  For templates of ``LONG`` distinct words or more it is a
paragraph, that is the lines between empty ones.  A block matches a template when
it holds at least ``CONTAINMENT`` of the template's distinct words.  Words are put in global frequency order (documents that hold the word, over
the whole corpus; rarest first).  Filters, all lossless:

* prefix: a match must hold one of the template's ``size - need + 1`` rarest words;
* length: it must hold at least ``need`` words of the template vocabulary;
* position: from the shared prefix word on, template and block must both have
  words enough left to reach ``need``.

What passes is verified by an exact intersection.  Every template that reaches the
threshold gives its label.  Short notices of different licenses share most of their
words, so a match must also hold the words that tell the license (``KEYS``, those
that the template has); in a run or around a word each of them must follow a word that comes
before it in the template or precede one that comes after it, so that a word of the
next sentence (German "mit") is no license.  Templates are fixed values
of this module, so the join's small side has a proven bound and is broadcast.

The base search finds the places where a phrase's words stand consecutively,
whatever stands between the words.

DataFrame functions only.  Defined cases: null and empty texts have no words and no
labels; repeated rows each get their result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import NON_WORD, materialise, prepare, word_array

CONTAINMENT = 0.8
LONG = 16
REACH = 2

# Base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Public license notices and the label each stands for.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2.0",
                   "licensed under the apache license version 2.0 the license you may not use this file except in compliance "
                   "with the license you may obtain a copy of the license at http www apache org licenses license 2.0"],
    "mit": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3",
                "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                "public license as published by the free software foundation either version 3 of the license"],
    "bsd": ["released under the bsd license",
            "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4.0",
                 "licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4.0",
                 "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1.0 universal"],
    "reserved": ["copyright all rights reserved"],
}

# The words that tell a license from the others.
KEYS = {
    "apache-2.0": {"apache", "2"}, "mit": {"mit"}, "gpl-3.0": {"gnu", "3"}, "bsd": {"bsd"}, "mpl-2.0": {"mozilla", "2"},
    "cc-by": {"cc", "by", "creative", "commons", "attribution"},
    "cc-by-sa": {"cc", "by", "sa", "creative", "commons", "attribution", "sharealike"},
    "cc-by-nc": {"cc", "by", "nc", "creative", "commons", "attribution", "noncommercial"},
    "cc0": {"cc0"}, "reserved": {"reserved"},
}


def _beside(text: str, keys: list[str]) -> list[list[str]]:
    """For each key word the pairs ``" a b "`` that show it in its place."""
    parts = [w for part in text.lower().split() for w in part.split(".")]
    out = []
    for key in keys:
        at = [i for i, w in enumerate(parts) if w == key]
        before = {f" {w} {key} " for i in at for w in parts[:i] if w != key}
        out.append(sorted(before | {f" {key} {w} " for i in at for w in parts[i + 1:] if w != key}))
    return out


def _template_rows() -> list[tuple[int, str, list[str]]]:
    rows = []
    for label in sorted(TEMPLATES):
        for text in TEMPLATES[label]:
            words = sorted({w for part in text.lower().split() for w in part.split(".")})
            rows.append((len(rows), label, words))
    return rows


def _key_places() -> list[tuple[list[str], list[list[str]]]]:
    """For each template row its key words and their places."""
    out = []
    for label in sorted(TEMPLATES):
        for text in TEMPLATES[label]:
            keys = sorted(KEYS[label] & {w for part in text.lower().split() for w in part.split(".")})
            out.append((keys, _beside(text, keys)))
    return out


def anchors() -> list[tuple[str, int, list[str]]]:
    """(word, words on each side, pairs): the longest key word of every short template
    and the pairs ``"a b"`` that show it in its place."""
    out: dict[str, tuple[int, set[str]]] = {}
    for (_, _, words), (keys, beside) in zip(_template_rows(), _key_places()):
        if len(words) < LONG:
            word = max(keys, key=lambda k: (len(k), k))
            reach, pairs = out.get(word, (0, set()))
            out[word] = max(reach, REACH * len(words)), pairs | {p.strip() for p in beside[keys.index(word)]}
    return [(word, reach, sorted(pairs)) for word, (reach, pairs) in sorted(out.items())]


def need_of(size: int, containment: float = CONTAINMENT) -> int:
    """Words of a template of ``size`` that a match must hold."""
    return -int(-(size * containment - 1e-9) // 1)


def base_places(words) -> "F.Column":
    """Array of (place, label) of the base phrases; ``words`` is the word array."""
    def places(parts: list[str], label: str):
        at = F.sequence(F.lit(0), F.size(words) - len(parts))
        hit = F.filter(at, lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(parts)]))
        rare = max(parts, key=len)
        return F.when(F.array_contains(words, rare) & (F.size(words) >= len(parts)), F.transform(
            hit, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))).otherwise(
            F.array().cast("array<struct<place:bigint,label:string>>"))

    return F.concat(*[places(phrase.split(" "), label) for phrase, label in PHRASES.items()])


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _around(words, word: str, reach: int, pairs: list[str]):
    """The blocks around every place of ``word`` beside one of its neighbours."""
    def shown(i):
        here = F.get(words, i)
        return (here == word) & (F.concat_ws(" ", F.get(words, i - 1), here).isin(pairs)
                                 | F.concat_ws(" ", here, F.get(words, i + 1)).isin(pairs))

    def block(i):
        first = F.greatest(i - reach, F.lit(0))
        return F.array_join(F.slice(words, first + 1, i + reach + 1 - first), " ")

    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), shown)
    return F.when(F.array_contains(words, word), F.transform(at, block)).otherwise(F.array().cast("array<string>"))


def _blocks(text, words):
    """Array of (long, run, block): lines, runs of them, words around a telling one, and
    paragraphs for the long templates."""
    def named(blocks, long: bool, run: bool):
        return F.transform(blocks, lambda b: F.struct(F.lit(long).alias("long"), F.lit(run).alias("run"), b.alias("block")))

    def full(line):
        return F.length(F.btrim(line, F.lit(" \t\r"))) > 0

    def run(line, i):
        two, three = F.get(lines, i + 1), F.get(lines, i + 2)
        return F.when(full(line) & full(two), F.concat_ws(" ", line, two, F.when(full(three), three)))

    t = F.lower(F.coalesce(text, F.lit("")))
    lines = F.split(t, "\n")
    runs = F.filter(F.transform(lines, run), lambda b: b.isNotNull())
    around = F.concat(*[_around(words, *a) for a in anchors()])
    return F.concat(named(lines, False, False), named(runs, False, True), named(around, False, True),
                    named(F.split(t, r"\n[\x20\t\r]*\n"), True, False))


def scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score) of every row; ``score`` is the best containment found (1 at a base
    place, else 0)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = _template_rows()
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, _, ws in rows for w in ws})])
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    row_key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("b"))  # 128 bits
    w = word_array(F.col("text"))
    one = src.select(row_key.alias("k"), "doc_id", w.alias("w")).select(
        "k", "doc_id", F.size("w").cast("long").alias("n_words"), base_places(F.col("w")).alias("base"),
        F.array_intersect("w", vocabulary).alias("held"))
    one = materialise(one, "words")
    # global order: documents that hold each template word, rarest first
    df = {r["w"]: r["n"] for r in one.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {x: i for i, x in enumerate(sorted({x for _, _, ws in rows for x in ws}, key=lambda x: (df.get(x, 0), x)))}
    index, keys = [], _key_places()
    for t, label, ws in rows:
        ws = sorted(ws, key=order.get)
        need = need_of(len(ws), containment)
        for place in range(len(ws) - need + 1):
            index.append((t, label, ws, *keys[t], len(ws) >= LONG, need, place, ws[place]))
    templates = spark.createDataFrame(index, "t int, label string, words array<string>, keys array<string>, beside array<array<string>>, long boolean, need int, place int, w string")
    prefix = F.array(*[F.lit(x) for x in sorted({r[-1] for r in index})])
    least = min(r[6] for r in index)
    ranked = F.array(*[F.lit(x) for x in sorted(order, key=order.get)])  # the vocabulary in global order
    # blocks of the documents that hold a prefix word and words enough; each row
    # decides for itself, so no text is shuffled
    some = src.select(row_key.alias("k"), "text", w.alias("said")).withColumn("held", F.array_intersect("said", vocabulary))
    found = some.filter((F.size("held") >= least) & F.arrays_overlap("held", prefix))
    found = found.select("k", F.explode(_blocks(F.col("text"), F.col("said"))).alias("b")).select(
        "k", F.col("b.long").alias("long"), F.col("b.run").alias("run"), F.col("b.block").alias("block"),
        F.array_intersect(ranked, F.split(F.col("b.block"), NON_WORD)).alias("held"))
    found = found.filter((F.size("held") >= least) & F.arrays_overlap("held", prefix))
    found = found.withColumn("said", F.when(F.col("run"), F.concat(F.lit(" "), F.regexp_replace("block", NON_WORD, " "), F.lit(" "))))
    probe = found.select("k", "long", "said", "held", F.posexplode("held").alias("j", "w"))
    hit = probe.join(F.broadcast(templates), ["w", "long"]).filter(
        (F.size("held") - F.col("j") >= F.col("need") - F.col("place")) & (F.size("words") - F.col("place") >= F.col("need") - F.col("j")))
    placed = F.col("said").isNull() | F.forall("beside", lambda pairs: F.exists(pairs, lambda p: F.contains(F.col("said"), p)))
    hit = hit.filter((F.size(F.array_except("keys", "held")) == 0) & placed).select(
        "k", "label", "need", F.size(F.array_intersect("words", "held")).alias("common"), F.size("words").alias("size"))
    hit = hit.filter("common >= need").groupBy("k").agg(
        F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))
    places = F.transform("base", lambda b: b["place"])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    empty = F.array().cast("array<string>")
    out = one.join(hit, "k", "left")
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", empty))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
