"""Approximate nearest neighbours by a hash-prefix forest.

Each tree writes every vector as a string of ``SYMBOLS`` hash symbols, a byte each
(cross-polytope symbols: the largest coordinate, with its sign, of a random
projection to ``SYMBOL_DIMS``), and keeps the strings in a sorted array.  A query
descends every tree to its longest prefix match by binary search; then the trees
ascend together, one symbol a round, and the vectors of the widened prefix ranges
are scored exactly.

The ascent ends when the answer is likely to be whole.  A vector at the k-th best
cosine found so far shares a symbol with the query with a known probability p
(it depends on the cosine alone), so T trees standing at depth d all miss it with
probability ``(1 - p^d)^T``; the query stops once that is at most ``miss``.  Near
neighbours stop deep in the trees after a few candidates, whatever the size of
the table; vectors without structure climb until enough is seen, at the root to
every vector.  The number of candidates is neither capped nor prescribed.

The index is a set of segments of about ``SEGMENT_ROWS`` distinct vectors
(``LEAST_SEGMENTS`` at least, so that a small table has several tasks), each with a forest of its own; a query visits every segment and the best
``k`` of all segments are kept.  The query set is dealt in blocks as well, so
a task holds one segment and one block of queries, whatever the table's size.

Equal vectors are indexed once, with their ``k + 1`` smallest ids: an exact
reduction, since further copies can never be among the nearest (ties go to
the smaller id).

Defined cases: vectors that are null, zero, of another length than the most common
one, or hold null or non-finite components, and rows without an id, take no part.
An empty table gives no rows.  Repeated rows count once; an id with several
vectors asks once for each of them and is never its own neighbour.  Other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.llm.common import materialise, prepare

TREES = 64
SYMBOLS = 12
SYMBOL_DIMS = 32
MISS = 0.1
# trees that widen their ranges between two looks at the stopping rule
TREES_A_STEP = 8
SEGMENT_ROWS = 65_536
LEAST_SEGMENTS = 8
QUERY_BLOCK = 16_384
# queries of a block whose prefix ranges are held at a time
RANGE_ROWS = 512
SEED = 11


def symbol_agreement(dims: int, pairs: int = 20_000, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, probability that two vectors of that cosine share a symbol).

    The coordinates of a projection are independent normals, correlated by the
    cosine, so the probability is that of simulated pairs (fixed seed)."""
    rng = np.random.default_rng(5)
    a, b = (rng.standard_normal((pairs, dims)).astype(np.float32) for _ in range(2))
    cosines = np.linspace(0.0, 1.0, steps + 1)
    same = [np.mean(_symbols(a) == _symbols(c * a + math.sqrt(1.0 - c * c) * b)) for c in cosines]
    return cosines, np.maximum.accumulate(same)


def _symbols(y: np.ndarray) -> np.ndarray:
    """The symbol of every projected row: 1 + 2 * (largest coordinate) + its sign."""
    big = np.abs(y).argmax(1)
    return (1 + 2 * big + (y[np.arange(len(y)), big] > 0)).astype(np.uint8)


class Forest:
    """Sorted arrays of hash strings over one segment of unit vectors."""

    def __init__(self, unit: np.ndarray, agreement: tuple[np.ndarray, np.ndarray] | None = None, *, trees: int = TREES,
                 symbols: int = SYMBOLS, dims: int = SYMBOL_DIMS):
        self.unit, self.trees, self.symbols, self.dims = unit, trees, symbols, dims
        self.cosines, self.same = agreement or symbol_agreement(dims)
        strings = self.strings(unit)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings, one byte a symbol."""
        x = unit.astype(np.float32)
        rng = np.random.default_rng(SEED)
        out = np.empty((self.trees, len(x)), dtype=f"S{self.symbols}")
        for t in range(self.trees):
            chars = np.empty((len(x), self.symbols), dtype=np.uint8)
            for i in range(self.symbols):
                chars[:, i] = _symbols(x @ rng.standard_normal((x.shape[1], self.dims)).astype(np.float32))
            out[t] = chars.view(out.dtype).ravel()
        return out

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(depths, trees, queries) first and last + 1 positions that share the
        first ``depth`` symbols; depth 0 shares everything."""
        shape = (self.symbols + 1, *strings.shape)
        lo, hi = np.zeros(shape, np.int64), np.full(shape, self.order.shape[1], np.int64)
        for depth in range(1, self.symbols + 1):
            prefix = f"S{depth}"
            for t in range(self.trees):
                have, asked = self.sorted[t].astype(prefix), strings[t].astype(prefix)
                lo[depth, t] = np.searchsorted(have, asked, "left")
                hi[depth, t] = np.searchsorted(have, asked, "right")
        return lo, hi

    def missed(self, cosine: float, depth: int, risen: int) -> float:
        """Probability that no tree has met a vector at ``cosine`` when ``risen``
        trees stand at ``depth`` and the others one symbol deeper."""
        p = np.interp(cosine, self.cosines, self.same)
        return (1.0 - p ** depth) ** risen * (1.0 - p ** (depth + 1)) ** (self.trees - risen)

    def search(self, q: np.ndarray, k: int, miss: float = MISS):
        """Per unit query (rows, cosines, rows scored): the k + 1 nearest found and
        what ties with the last of them."""
        n = self.order.shape[1]
        seen, place = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        for start in range(0, len(q), RANGE_ROWS):
            part = q[start:start + RANGE_ROWS]
            lo, hi = self.ranges(self.strings(part))
            for i, one in enumerate(part):
                yield self._ascend(one, lo[:, :, i], hi[:, :, i], k, miss, seen, place)

    def _ascend(self, q, lo, hi, k, miss, seen, place):
        rows, score, met, scored = np.zeros(0, np.int64), np.zeros(0), [], 0
        for depth in range(self.symbols, -1, -1):
            for t in range(0, self.trees, TREES_A_STEP):
                step = range(t, min(t + TREES_A_STEP, self.trees))
                new = np.concatenate([self.order[j, lo[depth, j]:hi[depth, j]] for j in step]) if depth else np.arange(len(seen))
                new = new[~seen[new]]
                place[new] = np.arange(len(new))  # a vector met twice counts where it stands last
                new = new[place[new] == np.arange(len(new))]
                if len(new):
                    seen[new] = True
                    met.append(new)
                    scored += len(new)
                    rows = np.concatenate([rows, new])
                    score = np.concatenate([score, np.clip(self.unit[new] @ q, -1.0, 1.0)])
                    if len(rows) > k + 1:
                        cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                        rows, score = rows[score >= cut], score[score >= cut]
                if scored == len(seen) or (len(rows) > k and self.missed(score.min(), depth, step[-1] + 1) <= miss):
                    for m in met:
                        seen[m] = False
                    return rows, score, scored


def _vectors(col) -> np.ndarray:
    return np.array(col.to_list() if hasattr(col, "to_list") else list(col), dtype=np.float64)


def distinct_vectors(table: DataFrame, vec_id: str, embedding: str, k: int) -> DataFrame:
    """(vector, ids): usable vectors, each once, with its k + 1 smallest ids."""
    v = F.col(embedding).cast("array<double>")
    length = table.filter(F.size(embedding) > 0).groupBy(F.size(embedding).alias("n")).count().orderBy(
        F.desc("count"), "n").first()
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = (F.size(v) == (length["n"] if length else -1)) & fine & F.exists(v, lambda x: x != 0.0) & F.col(vec_id).isNotNull()
    src = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).filter(ok)

    def first_ids(batches):
        # within a partition's batch: one row per vector with its smallest ids, so that a hot vector sends little
        for b in batches:
            ids = b.column(0).to_numpy()
            x = np.array(b.column(1).to_pylist(), dtype=np.float64) + 0.0
            u, inv = np.unique(x, axis=0, return_inverse=True)
            order = np.lexsort((ids, inv.ravel()))
            inv = inv.ravel()[order]
            start = np.searchsorted(inv, np.arange(len(u)))
            stop = np.append(start[1:], len(inv))
            groups = [np.unique(ids[order[a:z]])[:k + 1].tolist() for a, z in zip(start, stop)]
            yield pa.RecordBatch.from_arrays([pa.array(u.tolist(), pa.list_(pa.float64())), pa.array(groups, pa.list_(pa.int64()))],
                                             names=["vector", "ids"])

    part = src.mapInArrow(first_ids, "vector array<double>, ids array<long>")
    every = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return part.groupBy("vector").agg(every.alias("ids"))


def nearest(table: DataFrame, queries: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5,
            miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score, scored): for every usable row that satisfies
    ``queries`` the k nearest rows found (largest cosine, ties to the smaller
    id), never the row itself; fewer rows when the table has fewer.  ``scored``
    is the number of distinct vectors that the query was compared with."""
    spark = table.sparkSession
    prepare(spark)
    vectors = materialise(distinct_vectors(table, vec_id, embedding, k), "vectors")
    asked = table.filter(queries).select(F.col(vec_id).cast("long").alias("query_id"),
                                         F.col(embedding).cast("array<double>").alias("vector")).distinct()
    asked = asked.join(vectors.select("vector"), "vector", "left_semi")
    qvec = materialise(asked.select("vector").distinct().withColumn("q", F.xxhash64("vector")), "queries")
    n, n_q = vectors.count(), qvec.count()
    segments = max(LEAST_SEGMENTS, math.ceil(n / SEGMENT_ROWS))
    agreement = symbol_agreement(SYMBOL_DIMS)
    blocks = max(1, math.ceil(n_q / QUERY_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # both sides' keys must have one type, or equal keys are dealt to different tasks
    left = vectors.select("vector", "ids", F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(segments)).cast("int").alias("seg"),
                          every(blocks).alias("blk"))
    right = qvec.select("vector", F.pmod(F.xxhash64("q", F.lit(4)), F.lit(blocks)).cast("int").alias("blk"),
                        every(segments).alias("seg"))

    def search(key: tuple, index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(ask):
            return pd.DataFrame({"vector": [], "found": [], "scored": []}, dtype=object)
        x, q = _vectors(index["vector"]), _vectors(ask["vector"])
        ids = index["ids"].to_list()
        forest = Forest(x / np.linalg.norm(x, axis=1, keepdims=True), agreement)
        found, scored = [], []
        for rows, score, n_scored in forest.search(q / np.linalg.norm(q, axis=1, keepdims=True), k, miss):
            both = sorted((-s, int(v)) for r, s in zip(rows, score) for v in ids[r])[:k + 1]
            found.append([{"score": -s, "vec_id": v} for s, v in both])
            scored.append(n_scored)
        return pd.DataFrame({"vector": ask["vector"], "found": found, "scored": scored})

    hits = left.groupBy("seg", "blk").cogroup(right.groupBy("seg", "blk")).applyInPandas(
        search, "vector array<double>, found array<struct<score:double,vec_id:bigint>>, scored long")
    # per distinct query the best k + 1 of all segments, then one list per query row without itself;
    # a segment's row number 0 carries what it scored
    hit = hits.select("vector", F.posexplode("found").alias("p", "h"), "scored")
    best = hit.select("vector", "h.score", "h.vec_id", F.when(F.col("p") == 0, F.col("scored")).otherwise(0).alias("scored"))
    same = Window.partitionBy("vector")
    r = F.row_number().over(same.orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("_r", r).withColumn("scored", F.sum("scored").over(same)).filter(F.col("_r") <= k + 1)
    best = best.groupBy("vector").agg(F.max("scored").alias("scored"), F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    others = F.filter("best", lambda b: b["vec_id"] != F.col("query_id"))
    own = asked.join(best, "vector").select("query_id", "scored", others.alias("best"))
    return own.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("p", "b"), "scored").select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.s")).alias("score"), "scored")
