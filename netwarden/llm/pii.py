"""Personal data: pattern spans plus information-theoretic sanitisation.

Base spans are found by pattern in every whole text: e-mail, IP address, card
number (Luhn) and phone number.  Each distinct value (a kind and its digits or
letters) is a *protected entity*.  Terms disclose an entity when knowing the
term tells nearly as much as the entity itself: over the contexts (all text lines)
of the whole corpus, the pointwise mutual information of term t and entity c,

    PMI(t; c) = log2 p(t, c) / (p(t) p(c)),

is compared with the entity's information content IC(c) = -log2 p(c).  What
the term leaves untold of the entity is the gap IC - PMI in bits, which is
-log2 p(c | t) whatever the size of the corpus (1 bit: the term tells the
entity in every second line).  A gap of at most ``remove`` bits removes the
term, one of at most ``generalise`` bits replaces it by a general form.  Every word that shares a line with an entity is judged, at
any distance; n_c, n_t and n_tc count the same lines (copies count).  A pair is
evidence only when a random n_t of the lines would meet the entity's lines that
often with probability ``chance`` at most (Chernoff-Hoeffding bound of the exact
tail), so in a corpus of few lines a word seen once discloses nothing.

Jobs: one pass finds entities and the words of their lines; one pass counts, over
all lines, the words found (their list is broadcast when
counted within the bound and each task sends one count a word; beyond it all
words are counted and joined by a shuffle); one pass returns spans or clean
texts.

Defined cases: null texts are empty (no spans; the clean text stays null);
repeated rows each get their spans; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import BROADCAST_ROWS, carried, materialise, prepare
from netwarden.llm.textops import buffers, code_points, words

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term_removed", "term_generalised")
CHANCE = 0.001
PAIR_ROWS = 1 << 18  # (entity, term) rows in one Arrow batch
REMOVE = 0.25      # bits
GENERALISE = 0.5   # bits

# Fixed patterns of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# (no match can start inside a run of digits: the run fails or matches as a whole)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches around each '@': the local part is the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 64:
                d = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "little", signed=True)


def _entity(kind: str, value: str) -> int:
    return _digest(kind, value.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value))


def _line_words(line: str):
    col = pa.array([line])
    data, offsets = buffers(col)
    s, e, h, _ = words(data, offsets)
    return code_points(data)[s], code_points(data)[e], h.view(np.int64)


def together(docs: DataFrame, text: str) -> DataFrame:
    """(entity, term, n): words that share a line with a protected entity, with the
    number of lines; a null term is the entity itself."""
    def rows_of(ent, term, n):
        ent, term, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ent, term, n))
        return pa.RecordBatch.from_arrays(
            [pa.array(ent), pa.array(term, mask=n < 0), pa.array(np.abs(n).astype(np.int64))], names=["entity", "term", "n"])

    def pairs(lines):
        """Rows of the lines collected, at most about ``PAIR_ROWS`` in one batch
        however many entities and words a line holds; equal lines are summed first."""
        ent, term, n, held = [], [], [], 0
        for (terms, entities), k in lines.items():
            terms = np.frombuffer(terms, np.int64)
            step = max(1, PAIR_ROWS // (len(terms) + 1))
            for i in range(0, len(entities), step):
                own = np.array(entities[i:i + step], np.int64)
                ent += [np.repeat(own, len(terms)), own]
                term += [np.tile(terms, len(own)), np.zeros(len(own), np.int64)]
                n += [np.full(len(own) * len(terms), k), np.full(len(own), -k)]
                held += len(own) * (len(terms) + 1)
                if held >= PAIR_ROWS:
                    yield rows_of(ent, term, n)
                    ent, term, n, held = [], [], [], 0
        yield rows_of(ent, term, n)

    def run(batches):
        for b in batches:
            lines, rows = {}, 0
            for t in b.column(0).to_pylist():
                inside = {}
                for kind, a, z in base_spans(t) if t else []:
                    inside.setdefault(t.rfind("\n", 0, a) + 1, []).append((kind, a, z))
                for l0, spans in inside.items():
                    l1 = t.find("\n", l0)
                    s, e, h = _line_words(t[l0:l1 if l1 >= 0 else len(t)])
                    first = np.searchsorted(e, [a - l0 for _, a, _ in spans], side="right")
                    last = np.searchsorted(s, [z - l0 for *_, z in spans], side="left")
                    own = np.zeros(len(s) + 1, np.int64)
                    np.add.at(own, first, 1)
                    np.add.at(own, last, -1)
                    h = np.unique(h[np.cumsum(own)[:-1] == 0])
                    key = h.tobytes(), tuple(sorted({_entity(kind, t[a:z]) for kind, a, z in spans}))
                    rows += len(key[1]) * (len(h) + 1) if key not in lines else 0
                    lines[key] = lines.get(key, 0) + 1
                    if rows >= PAIR_ROWS:
                        yield from pairs(lines)
                        lines, rows = {}, 0
            yield from pairs(lines)

    found = docs.select(text).mapInArrow(run, "entity long, term long, n long")
    return found.groupBy("entity", "term").agg(F.sum("n").alias("n"))


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start bytes of all lines (every text starts one), plus the end."""
    cuts = np.flatnonzero(data == 10) + 1
    return np.unique(np.concatenate([offsets[:-1], cuts, [len(data)]]))


def _term_lines(docs: DataFrame, text: str, terms: DataFrame, broadcast: bool) -> DataFrame:
    """(term, n_t): the number of lines that hold each judged term, over every
    line of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(
        np.array(sorted(r["term"] for r in terms.collect()), dtype=np.int64)) if broadcast else None

    def counted(batches):
        """Per batch the words and the number of lines that hold each."""
        for b in batches:
            data, offsets = buffers(b.column(0))
            s, _, h, _ = words(data, offsets)
            h = h.view(np.int64)
            if shared is not None:
                t = shared.value
                hit = t[np.minimum(np.searchsorted(t, h), len(t) - 1)] == h
                s, h = s[hit], h[hit]
            line = np.searchsorted(_line_spans(data, offsets), s, side="right")
            order = np.lexsort((line, h))
            h, line = h[order], line[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
            yield np.unique(h[first], return_counts=True)

    def run(batches):
        if shared is not None:  # one row a term and task
            t = shared.value
            n = np.zeros(len(t), dtype=np.int64)
            for u, c in counted(batches):
                n[np.searchsorted(t, u)] += c
            yield pa.RecordBatch.from_arrays([pa.array(t[n > 0]), pa.array(n[n > 0])], names=["term", "n"])
        else:
            for u, c in counted(batches):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["term", "n"])

    seen = docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return seen if broadcast else seen.join(terms, "term", "left_semi")


def _n_lines(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")))).first()[0] or 0


def disclosing_terms(docs: DataFrame, *, text: str = "text", chance: float = CHANCE,
                     remove: float = REMOVE, generalise: float = GENERALISE, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(term, action): judged terms whose disclosure reaches a threshold."""
    prepare(docs.sparkSession)
    near = materialise(together(docs, text), "together")
    entity = near.filter("term is null").select("entity", F.col("n").alias("n_c"))
    joint = near.filter("term is not null").withColumnRenamed("n", "n_tc").join(entity, "entity")
    terms = joint.select("term").distinct()
    n_terms = terms.count()
    if n_terms == 0:
        return joint.select("term", F.lit("").alias("action"))
    total = float(_n_lines(docs, text))
    margin = _term_lines(docs, text, terms, n_terms <= limit)
    k, n_c, p = F.col("n_tc"), F.col("n_c"), F.col("n_t") / F.lit(total)
    pmi = F.log2(k / (p * n_c))
    ic = F.log2(F.lit(total) / n_c)
    miss = F.when(k < n_c, (n_c - k) * F.log((n_c - k) / (n_c * (1 - p)))).otherwise(0.0)
    sure = (k > p * n_c) & (k * F.log(k / (n_c * p)) + miss >= -math.log(chance))
    # a billionth of a bit covers the rounding of the two logarithms
    gap = joint.join(margin, "term").filter(sure).select("term", (ic - pmi - 1e-9).alias("gap"))
    least = gap.groupBy("term").agg(F.min("gap").alias("gap")).filter(F.col("gap") <= generalise)
    return materialise(least.select("term", F.when(F.col("gap") <= remove, "term_removed")
                                    .otherwise("term_generalised").alias("action")), "disclosing")


def general_form(word: str) -> str:
    """The general form that stands for a disclosing term."""
    return "<NUMBER>" if word.isdigit() else "<NAME>" if word[:1].isupper() else "<WORD>"


def all_spans(docs: DataFrame, terms: DataFrame, *, text: str = "text", keep: list[str] = (),
              limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keep`` columns, ``spans`` (array of kind, start, end: base spans and
    disclosing terms outside them) and ``clean`` (the sanitised text).  A result
    column takes the place of a ``keep`` column of its name."""
    spark = docs.sparkSession
    keep = carried(keep, "spans", "clean")
    prepare(spark)
    n_terms = terms.count()
    if n_terms > limit:
        return _all_spans_joined(docs, terms, text, keep)
    shared = spark.sparkContext.broadcast({r["term"]: r["action"] for r in terms.collect()})
    src = docs.select(*keep, F.col(text).alias("_llm_text"))
    return _apply(src, lambda: shared.value, keep, docs)


def _span_fields(docs: DataFrame, keep):
    from pyspark.sql import types as T
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    return T.StructType(list(docs.select(*keep).schema.fields) + [
        T.StructField("spans", span), T.StructField("clean", T.StringType())])


_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _apply(src: DataFrame, actions, keep, docs: DataFrame, own: bool = False) -> DataFrame:
    schema = _span_fields(docs, keep)

    def run(batches):
        for b in batches:
            last = b.num_columns - 1 - own
            col = b.column(last)
            data, offsets = buffers(col)
            acts = {} if own else actions()
            listed = b.column(last + 1).to_pylist() if own else None
            s = e = h = bounds = None
            if acts or own:
                s, e, h, bounds = words(data, offsets)
                h = h.view(np.int64)
                if acts:
                    t = np.array(sorted(acts), dtype=np.int64)
                    hit = t[np.minimum(np.searchsorted(t, h), len(t) - 1)] == h
            spans, clean = [], []
            for i, t_ in enumerate(col.to_pylist()):
                found = base_spans(t_) if t_ else []
                mine = {x["term"]: x["action"] for x in listed[i] or []} if own else acts
                if mine and t_:
                    w = np.arange(bounds[i], bounds[i + 1])
                    w = w[hit[w]] if not own else w[np.isin(h[w], np.fromiter(mine, np.int64, len(mine)))]
                    if len(w):
                        cp = code_points(data[offsets[i]:offsets[i + 1]])
                        more = [(mine[int(h[k])], int(cp[s[k] - offsets[i]]), int(cp[e[k] - offsets[i]])) for k in w]
                        free = [m for m in more if not any(m[1] < z and a < m[2] for _, a, z in found)]
                        order = {k: n for n, k in enumerate(KINDS + TERM_KINDS)}
                        found = sorted(found + free, key=lambda x: (x[1], order[x[0]]))
                spans.append([{"kind": k, "start": a, "end": z} for k, a, z in found])
                clean.append(sanitise(t_, found) if t_ else t_)
            cols = [b.column(j) for j in range(last)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(spans, _ARROW_SPAN), pa.array(clean, pa.string())],
                                             names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema)


def sanitise(text: str, spans) -> str:
    """Base spans become ``<KIND>``, removed terms vanish, generalised ones get
    their general form; overlapping spans are replaced as one."""
    out, at = [], 0
    for kind, a, z in spans:
        if a >= at:
            out.append(text[at:a])
            out.append("" if kind == "term_removed" else general_form(text[a:z]) if kind == "term_generalised"
                       else f"<{kind.upper()}>")
        at = max(at, z)
    out.append(text[at:])
    return "".join(out)


def _all_spans_joined(docs: DataFrame, terms: DataFrame, text: str, keep) -> DataFrame:
    """The same for more terms than may be broadcast: every text's distinct
    words are joined with the terms by a shuffle and brought back to the text."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column(1))
            _, _, h, bounds = words(data, offsets)
            for i in range(b.num_rows):
                u = np.unique(h[bounds[i]:bounds[i + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(u), b.column(0)[i].as_py(), np.int64)), pa.array(u, pa.int64())], names=["k", "term"])

    pairs = docs.select(key.alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, term long").distinct()
    own = pairs.join(terms, "term").groupBy("k").agg(F.collect_list(F.struct("term", "action")).alias("_llm_own"))
    src = (docs.select(*keep, F.col(text).alias("_llm_text"), key.alias("_llm_k"))
           .join(own.withColumnRenamed("k", "_llm_k"), "_llm_k", "left").select(*keep, "_llm_text", "_llm_own"))
    return _apply(src, None, keep, docs, own=True)


def span_text(spans) -> "F.Column":
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(spans) -> dict:
    """The per-document digest of a spans column."""
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS))
    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    out = {f"n_{k}": count(k) for k in KINDS}
    return out | {"base_sha256": F.sha2(span_text(base), 256), "spans": span_text(spans)}
