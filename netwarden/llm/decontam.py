"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is the set of its five-word shingles; a document holds the item
when at least ``containment`` of that set occurs in it.  Documents are far
longer than items, so the MinHash side is the item alone: its signature is
the ``size`` smallest shingle hashes (bottom-k sketch), and the share of the
signature present in a document estimates the containment whatever the
document's length.  Items are partitioned by set size; each partition has its
own minimum number of present minima: items with at most ``size`` shingles
are held whole (the estimate is exact), larger ones need the count that an
item at the threshold misses with probability below ``MISS``.  Candidates are
verified by exact containment of the shingle strings.

DataFrame functions only.  The document side is exploded once to (document,
hash) and probed against the signature table, which is broadcast when its
counted size is within the bound and shuffled otherwise.

Defined cases: null or empty texts hold nothing; with ``short`` an
item of fewer than five words is one shingle of all its words, and documents
are probed with every shingle length that the benchmark holds (without it such
items are not searched); repeated document rows with one
key count as one document, repeated item rows as one item; null keys are kept
as a key of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.llm.common import materialise, prepare, small_side, word_array

NGRAM = 5
CONTAINMENT = 0.8
SIGNATURE = 32
MISS = 1e-9


def _shingles(words, n: int, make):
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), make))


def _hashed(words, n: int):
    return _shingles(words, n, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def _strings(words, n: int):
    return _shingles(words, n, lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))


def _every(words, lengths: list[int], make):
    """The shingles of all ``lengths`` of a document."""
    return F.flatten(F.array_compact(F.array(*[make(words, m) for m in lengths])))


def least_hits(shingles: int, size: int = SIGNATURE, containment: float = CONTAINMENT) -> int:
    """Present minima required of items with this many shingles."""
    if shingles <= size:
        return max(1, math.ceil(containment * shingles - 1e-9))
    tail, c = 0.0, 0
    while c < size:
        tail += math.comb(size, c) * containment**c * (1 - containment)**(size - c)
        if tail > MISS:
            break
        c += 1
    return max(1, c)


def item_table(items: DataFrame, *, item_id: str = "item_id", text: str = "text", n: int = NGRAM,
               short: bool = False) -> DataFrame:
    """(item_id, s) the distinct shingle strings of every item (``short``: fewer than ``n`` words are one)."""
    w = items.select(F.col(item_id).alias("item_id"), word_array(F.col(text)).alias("w"))
    s = _strings(F.col("w"), n)
    if short:
        s = F.coalesce(s, F.when(F.size("w") > 0, F.array(F.concat_ws(" ", "w"))))
    return w.select("item_id", F.explode(s).alias("s")).distinct()


def signature_table(item_shingles: DataFrame, size: int = SIGNATURE, containment: float = CONTAINMENT,
                    n: int = NGRAM) -> DataFrame:
    """(item_id, h, need): the smallest hashes of every item and the hits its size partition requires."""
    h = item_shingles.select("item_id", _hash_of("s", n).alias("h")).distinct()
    sizes = h.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    need = F.lit(least_hits(size + 1, size, containment))
    for k in range(size, 0, -1):
        need = F.when(F.col("n_item") <= k, F.lit(least_hits(k, size, containment))).otherwise(need)
    low = h.withColumn("_r", F.row_number().over(Window.partitionBy("item_id").orderBy("h"))).filter(F.col("_r") <= size)
    # items may have a null key: compare null-safe
    i = sizes.select(F.col("item_id").alias("_i"), need.alias("need"))
    return low.join(i, F.col("item_id").eqNullSafe(F.col("_i"))).select("item_id", "h", "need")


def _hash_of(s: str, n: int):
    # absent words of a shorter shingle are null and leave the hash as it is
    parts = F.split(F.col(s), " ")
    return F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(n)])


def contained_items(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT,
                    size: int = SIGNATURE, n: int = NGRAM, short: bool = False) -> DataFrame:
    """(key, item_id, n_common, n_item, containment) of every document and item
    with containment at or above the threshold."""
    prepare(docs.sparkSession)
    shingles = materialise(item_table(items, item_id=item_id, text=item_text, n=n, short=short), "items")
    signature = materialise(signature_table(shingles, size, containment, n), "signature")
    lengths = [r[0] for r in shingles.select(F.size(F.split("s", " "))).distinct().collect()] or [n]  # n at most
    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    probe = src.select("_k", word_array(F.col("_t")).alias("w")).select("_k", F.explode(_every(F.col("w"), lengths, _hashed)).alias("h"))
    hits = probe.join(small_side(signature), "h").select("_k", "item_id", "h", "need").distinct()
    pairs = hits.groupBy("_k", "item_id").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
    pairs = materialise(pairs.filter("c >= need").select("_k", "item_id"), "candidates")
    # exact check of the candidates on the shingle strings
    cand = pairs.select("_k").distinct()
    n_cand = cand.count()
    src = src.join(small_side(cand.withColumnRenamed("_k", "_c"), n_cand), F.col("_k").eqNullSafe(F.col("_c")), "left_semi")
    own = src.select("_k", word_array(F.col("_t")).alias("w")).select("_k", F.explode(_every(F.col("w"), lengths, _strings)).alias("s"))
    sizes = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    found = own.join(small_side(shingles), "s").select("_k", "item_id", "s").distinct()
    found = found.groupBy("_k", "item_id").agg(F.count(F.lit(1)).alias("n_common"))
    a, p, z = found.alias("a"), pairs.alias("p"), sizes.alias("z")
    same = F.col("a._k").eqNullSafe(F.col("p._k")) & F.col("a.item_id").eqNullSafe(F.col("p.item_id"))
    out = a.join(p, same, "left_semi").join(z, F.col("a.item_id").eqNullSafe(F.col("z.item_id")))
    share = F.col("n_common") / F.col("n_item")
    return (out.filter(F.col("n_common") >= F.col("n_item") * F.lit(containment) - 1e-9)
            .select(F.col("a._k").alias(key), F.col("a.item_id").alias("item_id"), "n_common", "n_item",
                    share.alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text",
                  least_words: int = 1, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item of ``least_words`` words
    or more (decided by text, as a 128-bit digest of it)."""
    keyed = docs.withColumn("_llm_text_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    items = items.filter(F.size(word_array(F.col(item_text))) >= least_words)
    bad = contained_items(keyed.select("_llm_text_key", F.col(text).alias("_llm_text")), items, key="_llm_text_key",
                          text="_llm_text", item_text=item_text, **options).select("_llm_text_key").distinct()
    bad = materialise(bad, "contaminated")
    return keyed.join(small_side(bad), "_llm_text_key", "left_anti").drop("_llm_text_key")
