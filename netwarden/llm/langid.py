"""Language identification by prediction by partial matching (PPM).

One byte context tree per language holds how often each byte followed each
context of up to ``order`` bytes in the training texts.  A byte that a context
has not seen costs that context's escape (method C: distinct symbols over
total plus distinct) and is then coded by the next shorter context, with the
symbols already ruled out excluded; below the empty context all 256 bytes are
equally likely.  Statistics are frozen after training, so the code length of
a text is the sum of per-byte costs that depend on the preceding ``order``
bytes alone.  The trees of all languages share one node numbering; costs are
tabulated per (node, symbol, language), and bytes never seen in training
share one symbol (they cost the same in every context).

Training reads a bounded sample: per language the documents of smallest
``xxhash64(doc_id)``, about ``train_docs`` of them and whole, at most
``train_bytes`` bytes (the last document is kept whole).  Scoring covers all
documents and whole texts.

Defined cases: repeated rows train once and each get their result; an empty
table learns nothing ("und" for every text) and gives no rows; more than
``MAX_LANGUAGES`` distinct languages raise a ``ValueError``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netwarden.llm.common import carried, prepare
from netwarden.llm.textops import buffers

MAX_LANGUAGES = 256
_BLOCK = 1 << 19


def _grams(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (k context bytes then the byte, base 256) and their counts."""
    parts = []
    for t in texts:
        b = np.frombuffer(t, dtype=np.uint8).astype(np.uint64)
        if len(b) > k:
            c = np.zeros(len(b) - k, dtype=np.uint64)
            for j in range(k + 1):
                c = c * np.uint64(256) + b[j:len(b) - k + j]
            parts.append(c)
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          eligible: Column | None = None, order: int = 3, min_count: int = 4,
          train_docs: int = 600, train_bytes: int = 1_000_000) -> "PpmModel":
    """Fit the context trees on the bounded sample described above."""
    ok = F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = docs.filter(ok if eligible is None else ok & eligible)
    counts = rows.groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.orderBy("_lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages")
    langs = [r["_lang"] for r in found]
    if not langs:
        return PpmModel([], order, [], None, None, None)
    # rows below the hash bound: about train_docs a language
    bound = F.lit(0.0)
    for r in found:
        bound = F.when(F.col(lang) == F.lit(r["_lang"]), F.lit(min(1.0, train_docs / r["_n"]))).otherwise(bound)
    u = (F.xxhash64(F.col(doc_id), F.lit(17)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    sample = (rows.withColumn("_u", u).filter(F.col("_u") < bound)
              .select(F.col(lang).alias("_lang"), F.encode(F.col(text), "UTF-8").alias("_b"), "_u")
              .dropDuplicates(["_lang", "_b"]))
    w = Window.partitionBy("_lang").orderBy("_u", "_b")
    sample = (sample.withColumn("_before", F.sum(F.length("_b")).over(w) - F.length("_b"))
              .filter(F.col("_before") < train_bytes).select("_lang", "_b"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [bytes(b) for b in pdf["_b"]]
        out = []
        for k in range(order + 1):
            codes, n = _grams(texts, k)
            out.append(pd.DataFrame({"_lang": pdf["_lang"].iloc[0], "k": k, "code": codes.astype(np.int64), "n": n}))
        return pd.concat(out)

    got = sample.groupBy("_lang").applyInPandas(count, "_lang string, k int, code long, n long").toPandas()
    return PpmModel.build(langs, order, got, min_count)


class PpmModel:
    """Tabulated context trees; the size is bounded by the training sample."""

    def __init__(self, langs, order, steps, symbol, cost, width):
        self.langs, self.order, self.steps, self.symbol, self.cost, self.width = langs, order, steps, symbol, cost, width

    @classmethod
    def build(cls, langs: list[str], order: int, counts: pd.DataFrame, min_count: int) -> "PpmModel":
        zero = counts[counts["k"] == 0]
        alphabet = np.unique(zero["code"].to_numpy())
        width = len(alphabet) + 1
        symbol = np.zeros(256, dtype=np.int64)
        symbol[alphabet] = np.arange(1, width)
        # contexts kept, by length; the root is node 0
        kept: list[dict[int, int]] = [{0: 0}]
        nodes = 1
        parents, steps = [np.zeros(1, np.int64)], []
        for k in range(1, order + 1):
            c = counts[counts["k"] == k]
            ctx = c["code"].to_numpy() >> 8
            u, inv = np.unique(ctx, return_inverse=True)
            total = np.bincount(inv, weights=c["n"].to_numpy(), minlength=len(u)) if len(u) else np.zeros(0)
            keep = [int(x) for x in u[total >= min_count] if (int(x) & ((1 << 8 * (k - 1)) - 1)) in kept[k - 1]]
            step = np.repeat(np.arange(nodes, dtype=np.int32), width).reshape(nodes, width)
            ids, up = {}, []
            for x in keep:  # x = oldest byte, then the shorter context
                p = kept[k - 1][x & ((1 << 8 * (k - 1)) - 1)]
                ids[x] = nodes + len(up)
                step[p, symbol[x >> 8 * (k - 1)]] = ids[x]
                up.append(p)
            kept.append(ids)
            parents.append(np.array(up, dtype=np.int64))
            steps.append(step)
            nodes += len(up)
        parent = np.concatenate(parents)
        level = np.concatenate([np.full(len(p), k) for k, p in enumerate(parents)])
        cost = np.zeros((nodes, width, len(langs)), dtype=np.float32)
        for li, lang in enumerate(langs):
            own = counts[counts["_lang"] == lang]
            n = np.zeros((nodes, width))
            for k in range(order + 1):
                c = own[own["k"] == k]
                code, m = c["code"].to_numpy(), c["n"].to_numpy()
                at = np.array([kept[k].get(int(x), -1) for x in code >> 8], dtype=np.int64)
                good = at >= 0
                n[at[good], symbol[code[good] & 255]] += m[good]
            done = np.zeros((nodes, width), bool)
            shut = np.zeros((nodes, width), bool)  # symbols excluded so far
            bits = np.zeros((nodes, width))
            at = np.arange(nodes)
            for k in range(order, -1, -1):
                on = level >= k
                here = np.where(on, at, 0)
                m = np.where(shut, 0.0, n[here]) * on[:, None]
                d = (m > 0).sum(1, keepdims=True)
                total = m.sum(1, keepdims=True) + d
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit = (m > 0) & ~done
                    bits = np.where(hit, bits - np.log2(m / total), bits)
                    esc = np.where(total > 0, -np.log2(d / total), 0.0)
                done |= hit
                bits = np.where(done, bits, bits + np.where(on[:, None], esc, 0.0))
                shut |= m > 0
                at = np.where(on, parent[at], at)
            left = 256 - shut.sum(1, keepdims=True)
            bits = np.where(done, bits, bits + np.log2(np.maximum(left, 1)))
            cost[:, :, li] = bits
        return cls(langs, order, steps, symbol, cost.reshape(nodes * width, len(langs)), width)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits per (text, language), exact for the frozen statistics."""
        n, d = len(offsets) - 1, self.order
        out = np.zeros((n, len(self.langs)))
        sym = self.symbol[data]
        begin = offsets[:-1][offsets[1:] > offsets[:-1]]
        for a in range(0, len(data), _BLOCK):
            b = min(a + _BLOCK, len(data))
            node = np.zeros(b - a, dtype=np.int64)
            near = begin[(begin > a - d) & (begin < b)]
            for k in range(1, d + 1):
                s = np.zeros(b - a, dtype=np.int64)
                from_ = max(a - k, 0)
                s[from_ + k - a:] = sym[from_:max(b - k, from_)]
                for r in range(k):  # no context reaches back before its text
                    at = near + r - a
                    s[at[(at >= 0) & (at < b - a)]] = 0
                node = self.steps[k - 1].ravel()[node * self.width + s]
            c = self.cost[node * self.width + sym[a:b]]
            i0, i1 = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b, side="left")
            texts = np.arange(i0, i1)
            texts = texts[offsets[texts + 1] > np.maximum(offsets[texts], a)]  # skip empty ones
            if len(texts):
                out[texts] += np.add.reduceat(c, np.maximum(offsets[texts], a) - a, axis=0, dtype=np.float64)
        return out


def _has_letter(col, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(ch.isalpha() for ch in col[int(i)].as_py())
    return out


def predict(docs: DataFrame, model: PpmModel, *, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` ("und": null text or no letter, or
    nothing was learned), ``score`` (posterior of the predicted language
    under equal priors, 0..1; 0 for "und") and ``bits_per_byte`` (code length
    of the best language; null for "und").  Equal code lengths: the first
    language in code point order.  One output row per input row.  A result column
    takes the place of a ``keep`` column of its name."""
    spark = docs.sparkSession
    keep = carried(keep, "lang_pred", "score", "bits_per_byte")
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("_llm_text"))
    schema = T.StructType(list(docs.select(*keep).schema.fields) + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            data, offsets = buffers(col)
            n = batch.num_rows
            pred, score, bpb = ["und"] * n, np.zeros(n), [None] * n
            if m.langs and n:
                bits = m.code_lengths(data, offsets)
                best = bits.argmin(1)
                post = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
                for i in np.flatnonzero(_has_letter(col, data, offsets)):
                    pred[i], score[i] = m.langs[best[i]], post[i]
                    bpb[i] = float(bits[i, best[i]] / (offsets[i + 1] - offsets[i]))
            cols = [batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bpb, pa.float64())],
                names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema)
