"""Source divergence audit by a token-start pointer sort.

A term is a run of ASCII letters and non-ASCII characters, A-Z folded to a-z.
A shard is a few Arrow batches whose text buffers are laid end to end; the
pointers to its word starts are sorted by the text they point at with a
multikey quicksort whose characters are eight bytes wide: a segment of equal
keys goes on with the next eight bytes until its words end.  A run of equal
words then gives, for every (language, source) it occurs in, the number of
occurrences and of documents.  Only these run counts leave a shard; they are
summed by partial aggregation, so a hot source or word costs one row a task.

Every language keeps the ``V`` terms of at least ``min_docs`` of its documents.
With ``N`` occurrences of kept terms, a (language, source) group and the
language give a term ``p = 1 + floor(SCALE * (count + 5) / (N + 5 V))``, in
decimals, so that nothing is rounded.  ``pair`` rows hold the summed absolute
differences of two sources of a language over all its kept terms; they are
added up per block of terms (blocks follow the counted rows, so a task is
bounded) against all sources of the language.  ``term`` rows hold the terms
that stand out most from the language in a source.

Defined cases: a null text, language or source is the empty string; a text
without a term still makes its group occur; a language without kept terms has
pairs of value 0; equal values rank by the bytes of the item; repeated rows
count each as a document; an empty table gives no rows; a text of any length
is sorted in pieces and its distinct terms merged; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.llm.common import materialise, prepare
from netwarden.llm.textops import blocks, buffers, runs

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
SHARD_BYTES = 8 << 20
BLOCK_ROWS = 200_000  # counted rows in one block of terms
CELLS = 4 << 20       # cells of one dense (terms x sources) step

COUNTS = "lang string, source string, term string, n long, df long"
_PAIRS = "lang string, source string, item string, value long"

_FOLD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
_IS_TERM = _FOLD != 0


def _key(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes from ``at`` as one big-endian number, zero beyond ``end``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(8):
        p = at + j
        byte = np.where(p < end, data[np.minimum(p, len(data) - 1)], 0)
        out |= byte.astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by the words they point at, and for each place in
    that order whether a new word begins.  ``data`` is folded and holds no zero
    byte inside a word."""
    n = len(starts)
    key = _key(data, starts, ends)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    live = np.flatnonzero((key & np.uint64(255)) != 0)  # words that may go on
    depth = 8
    while len(live):
        segment = np.cumsum(new)[live]
        many = np.bincount(segment)[segment] > 1
        live, segment = live[many], segment[many]
        if not len(live):
            break
        rows = order[live]
        key = _key(data, np.minimum(starts[rows] + depth, ends[rows]), ends[rows])
        sub = np.lexsort((key, segment))
        order[live], key = rows[sub], key[sub]
        new[live[1:]] |= (segment[1:] == segment[:-1]) & (key[1:] != key[:-1])
        live = live[(key & np.uint64(255)) != 0]
        depth += 8
    return order, new


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, idx: np.ndarray) -> pa.Array:
    """Arrow strings of the words ``idx``."""
    size = ends[idx] - starts[idx]
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) + np.repeat(starts[idx] - off[:-1], size)
    return pa.LargeStringArray.from_buffers(len(idx), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def _shard(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """(group, term, n, df) of every term of a shard; texts are ``offsets``,
    ``group`` their (language, source) numbers."""
    starts, ends = [], []
    for a, b in blocks(data, _IS_TERM, offsets):
        s, e = runs(data, _IS_TERM, offsets, a, b)
        starts.append(s + a)
        ends.append(e + a)
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if not len(starts):
        return None
    ends = np.concatenate(ends)
    folded = _FOLD[data]
    order, new = sort_pointers(folded, starts, ends)
    word = np.cumsum(new) - 1
    doc = np.searchsorted(offsets, starts[order], side="right") - 1
    # documents numbered group by group: one sort gives (word, group, document)
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), dtype=np.int64)
    place[by_group] = np.arange(len(group))
    cell, n = np.unique(word * len(group) + place[doc], return_counts=True)
    w, g = cell // len(group), group[by_group][cell % len(group)]
    first = np.ones(len(cell), dtype=bool)
    first[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(first)
    total = np.add.reduceat(n, at)
    df = np.diff(np.append(at, len(cell)))
    heads = order[np.flatnonzero(new)]
    return g[at], _slices(folded, starts, ends, heads[w[at]]), total, df


def _ranges(offsets: np.ndarray):
    """Runs of whole texts of at most ``SHARD_BYTES`` together (or one longer text)."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SHARD_BYTES, side="right")) - 1)
        yield a, b
        a = b


def _long(data: np.ndarray, group: np.ndarray):
    """As :func:`_shard` for one text longer than a shard: sorted piece by
    piece, the pieces' distinct terms merged."""
    parts, whole = [], np.array([0, len(data)], dtype=np.int64)
    for a, b in blocks(data, _IS_TERM, whole, SHARD_BYTES):
        found = _shard(data[a:b], np.array([0, b - a], dtype=np.int64), group)
        if found is not None:
            parts.append(pa.table({"term": found[1], "n": pa.array(found[2], pa.int64())}))
            if len(parts) >= 16:
                parts = [_merged(parts)]
    if not parts:
        return None
    t = _merged(parts)
    n = t.column("n").combine_chunks().to_numpy()
    return np.repeat(group, len(n)), t.column("term").combine_chunks(), n, np.ones(len(n), np.int64)


def _merged(parts: list) -> pa.Table:
    t = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
    return t.rename_columns(["n" if c == "n_sum" else c for c in t.column_names])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Occurrences and documents per (lang, source, term); the empty term holds
    the group's documents, so that groups without a term are there too."""
    prepare(docs.sparkSession)

    def flush(parts):
        data = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        offsets = np.concatenate([p[1][:-1] + s for p, s in zip(parts, shift)] + [shift[-1:]]).astype(np.int64)
        langs = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
        sources = pa.concat_arrays([p[3] for p in parts]).dictionary_encode()
        wide = max(len(sources.dictionary), 1)
        group = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()

        def rows(g, terms, n, df):
            return pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(g // wide)), sources.dictionary.take(pa.array(g % wide)), terms,
                 pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "n", "df"])

        g, n = np.unique(group, return_counts=True)
        yield rows(g, pa.array([""] * len(g), pa.string()), np.zeros(len(g), np.int64), n)
        for a, b in _ranges(offsets):
            piece, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            found = _shard(piece, at, group[a:b]) if len(piece) <= SHARD_BYTES else _long(piece, group[a:b])
            if found is not None:
                yield rows(*found)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = buffers(b.column(2))
            parts.append((data, offsets, b.column(0).cast(pa.string()), b.column(1).cast(pa.string())))
            held += len(data)
            if held >= SHARD_BYTES:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    some = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return some.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)) in decimals; null without kept terms."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + ((CAST({n} AS DECIMAL(20, 0)) + {PRIOR}) * {SCALE}) "
                  f"div (CAST({total} AS DECIMAL(20, 0)) + {PRIOR} * {kept}) END")


def _pair_sums(key, terms, groups):
    """Summed |p - p'| of every two sources over one block of a language's
    terms; a missing (term, source) has the source's share of no occurrence."""
    lang = key[0].as_py()
    names = groups.column("source").to_pylist()
    rank = {s: i for i, s in enumerate(names)}
    base = np.array([v or 0 for v in groups.column("p0").to_pylist()], dtype=np.int64)
    size = len(names)
    total = np.zeros((size, size), dtype=np.int64)
    if terms.num_rows:
        word = terms.column("term").combine_chunks().dictionary_encode()
        if isinstance(word, pa.ChunkedArray):
            word = word.combine_chunks()
        t = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        s = np.array([rank[v] for v in terms.column("source").to_pylist()], dtype=np.int64)
        p = terms.column("p").to_numpy()
        order = np.argsort(t, kind="stable")
        t, s, p = t[order], s[order], p[order]
        n, step = len(word.dictionary), max(1, CELLS // max(size, 1))
        for a in range(0, n, step):
            lo, hi = np.searchsorted(t, [a, min(a + step, n)])
            dense = np.repeat(base[:, None], min(step, n - a), axis=1)
            dense[s[lo:hi], t[lo:hi] - a] = p[lo:hi]
            for i in range(size):
                total[i] += np.abs(dense - dense[i]).sum(axis=1)
    i, j = np.nonzero(~np.eye(size, dtype=bool))
    name = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": name.take(pa.array(i)),
                     "item": name.take(pa.array(j)), "value": pa.array(total[i, j], pa.int64())})


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
          top: int = TOP_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``lang, source, part, item, value, rank``: see the module's text."""
    counts = materialise(term_counts(docs, text, lang, source), "terms")
    some = counts.filter("term <> ''")
    kept = some.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("_df")) \
        .filter(F.col("_df") >= min_docs).drop("_df")
    kept = materialise(some.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept")
    per_term = kept.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang"))
    langs = counts.select("lang").distinct().join(
        per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang")), "lang", "left") \
        .na.fill(0, ["v", "total_lang"])
    groups = counts.filter("term = ''").select("lang", "source").join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"]) \
        .join(langs, "lang")
    groups = materialise(groups.withColumn("none", F.lit(0)).withColumn("p0", _share("none", "total", "v")).drop("none"), "groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "v").alias("p"), _share("n_lang", "total_lang", "v").alias("q"))

    # terms that stand out: the rank limit is applied before the shuffle too
    out = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top) \
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    n_blocks = max(1, -(-kept.count() // block_rows))
    left = shares.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int").alias("block"))
    right = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_pair_sums, _PAIRS)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.withColumn("rank", F.row_number().over(best)).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
