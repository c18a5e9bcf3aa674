"""Text quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words and word *styles* (capitals, digits, symbols at the
end, length, "same as the word before"); a text is its log term counts times
inverse document frequency.  A bounded sample of labelled texts
(``LABELLED_ROWS`` at most, smallest id hash) gives the frequencies, the
latent axes (leading eigenvectors of the term products) and the labelled
vectors, which are broadcast.  Every text is projected; its exact cosines with
all labelled vectors come from blocked matrix products, and the labels of its
``k`` nearest are averaged with weight cosine ** power.  Ties in the cosine go to the
labelled row of smaller id.  Words are folded into ``WORD_TERMS`` slots, so most of
the direction comes from the word styles.

Defined cases: a text without words (null, empty, white space) has no
direction and scores the share of label 1 in the sample, as does every text if
nothing is labelled (0.5 then); a row labelled more than once counts with the
mean of its labels; null labels are left out; of the texts of a repeated labelled id
the smallest is learned; repeated rows are each scored; an empty table gives no rows;
a result column takes the place of a ``keep`` column of its name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.llm.common import carried, prepare
from netwarden.llm.textops import blocks, buffers, mix, runs

LABELLED_ROWS = 4000
AXES = 48
NEIGHBOURS = 25
POWER = 4.0
THRESHOLD = 0.3
WORD_TERMS = 512
STYLE_TERMS = 2048
TERMS = WORD_TERMS + STYLE_TERMS
_CHUNK = 512

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_CLASS = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 other letters, 5.. symbols
for _b in range(256):
    _CLASS[_b] = (1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 else 3 if 48 <= _b <= 57 else 4 if _b >= 128 else 5)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every white-space separated word, twice: as word and as style."""
    docs, terms = [], []
    for a, b in blocks(data, _IS_WORD, offsets):
        s, e = runs(data, _IS_WORD, offsets, a, b)
        if not len(s):
            continue
        block = data[a:b]
        doc = np.searchsorted(offsets, s + a, side="right") - 1
        cls = _CLASS[block]
        size = e - s
        count = {}
        for c in (1, 3, 5):
            cum = np.concatenate([[0], np.cumsum(cls == c)])
            count[c] = cum[e] - cum[s]
        # an order-dependent digest of the word's bytes, for the word term and for repeats
        first = np.zeros(b - a, dtype=np.int64)
        first[s[0]:] = np.repeat(s, np.diff(np.append(s, b - a)))
        v = mix((block.astype(np.uint64) << np.uint64(32)) | (np.arange(b - a) - first).astype(np.uint64))
        v[~_IS_WORD[block]] = 0
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
        h = mix(cum[e] - cum[s])
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
        caps = np.where(count[1] == 0, 0, np.where(count[1] >= np.maximum(size - count[5], 1), 3, np.where(cls[s] == 1, 1, 2)))
        last, odd = block[e - 1], cls[e - 1] == 5
        mark = np.where(odd, 1 + (last % 13).astype(np.int64), 0)
        length = np.searchsorted([2, 4, 8, 16], size)
        style = ((((caps * 2 + (count[3] > 0)) * 14 + mark) * 5 + length) * 2 + same) * 3 + np.minimum(count[5], 2)
        docs += [doc, doc]
        terms += [(h % np.uint64(WORD_TERMS)).astype(np.int64), WORD_TERMS + mix(style.astype(np.uint64)).astype(np.int64) % STYLE_TERMS]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(terms)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, TERMS) 1 + log counts; 0 where a term is missing."""
    n = len(offsets) - 1
    doc, term = _terms(data, offsets)
    m = np.bincount(doc * TERMS + term, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    return np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0).astype(np.float32)


class Voter:
    """Frequencies, latent axes and labelled vectors; bounded by the sample."""

    def __init__(self, weight, axes, vectors, labels, prior):
        self.weight, self.axes, self.vectors, self.labels, self.prior = weight, axes, vectors, labels, prior

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, axes: int = AXES) -> "Voter":
        n = len(labels)
        if n == 0:
            return cls(None, None, None, labels, 0.5)
        idf = np.log((1.0 + n) / (1.0 + (counts > 0).sum(0))) + 1.0
        x = cls._unit(counts * idf)
        values, vecs = np.linalg.eigh((x.T @ x).astype(np.float64))
        top = vecs[:, ::-1][:, :min(axes, n)].astype(np.float32)
        return cls(idf.astype(np.float32), top, cls._unit(x @ top), labels.astype(np.float64), float(labels.mean()))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = counts.any(1)
        if self.vectors is None or not some.any():
            return out
        q = self._unit(self._unit(counts[some] * self.weight) @ self.axes)
        sim = q @ self.vectors.T
        k = min(k, sim.shape[1])
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        # more rows than k at the k-th cosine or above: equal cosines by index
        least = np.take_along_axis(sim, near, 1).min(1)
        tied = (sim >= least[:, None]).sum(1) > k
        near[tied] = np.argsort(-sim[tied], axis=1, kind="stable")[:, :k]
        w = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(np.float64) ** power
        total = w.sum(1)
        out[some] = np.where(total > 0, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        eligible: Column | None = None, rows: int = LABELLED_ROWS) -> Voter:
    """Fit on at most ``rows`` labelled texts, those of smallest id hash."""
    prepare(docs.sparkSession)
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if eligible is not None:
        marked = marked.filter(eligible)
    marked = marked.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("_y"))
    chosen = marked.orderBy(F.xxhash64("_id", F.lit(23)), "_id").limit(rows)
    found = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")
    found = found.groupBy("_id", "_y").agg(F.min("_t").alias("_t"))

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column(2))
            doc, term = _terms(data, offsets)
            key, n = np.unique(doc * TERMS + term, return_counts=True)
            at = np.searchsorted(key // TERMS, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([(key[at[i]:at[i + 1]] % TERMS).tolist() for i in range(b.num_rows)], pa.list_(pa.int32())),
                 pa.array([n[at[i]:at[i + 1]].tolist() for i in range(b.num_rows)], pa.list_(pa.int32()))], names=["_id", "_y", "term", "n"])

    pdf = found.mapInArrow(run, "_id long, _y double, term array<int>, n array<int>").toPandas().sort_values("_id")
    counts = np.zeros((len(pdf), TERMS), dtype=np.float32)
    for i, (t, n) in enumerate(zip(pdf["term"], pdf["n"])):
        if len(t):
            counts[i, np.asarray(t, dtype=np.int64)] = 1 + np.log(np.asarray(n, dtype=np.float64))
    return Voter.fit(counts, pdf["_y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, voter: Voter, *, text: str = "text", keep: list[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``score`` (0..1) and ``predicted`` of every whole text."""
    spark = docs.sparkSession
    keep = carried(keep, "score", "predicted")
    prepare(spark)
    shared = spark.sparkContext.broadcast(voter)
    schema = T.StructType(list(docs.select(*keep).schema.fields) + [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        v = shared.value
        for batch in batches:
            last = batch.num_columns - 1
            data, offsets = buffers(batch.column(last))
            out = np.zeros(batch.num_rows)
            for i in range(0, batch.num_rows, _CHUNK):
                o = offsets[i:i + _CHUNK + 1]
                out[i:i + _CHUNK] = v.score(term_counts(data[o[0]:o[-1]], o - o[0]))
            cols = [batch.column(j) for j in range(last)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                                             names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).alias("_llm_text")).mapInArrow(run, schema)
