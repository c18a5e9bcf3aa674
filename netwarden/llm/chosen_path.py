"""N-gram Jaccard self-join by chosen paths.

Every text is the set of its five-word shingles (``textops.shingle_sets``).
Texts with the same set form a *class* and one member stands for all of them.
A run sends each class along the shingles whose shared random rank is below
``1 / (similarity * set size)``: two sets of Jaccard similarity ``s`` meet
with probability ``1 - exp(-common / (similarity * larger))``.  A bucket with
more than ``bucket`` members is split again on shingles sampled anew for that
path (``branching`` times as many, so that deeper levels lose little), up to
``levels`` levels, unless its members are alike on average: splitting cannot
part those.  What is still large is compared block against block, so no
bucket is capped.  Small buckets are compared by brute force, in two steps:
first on 2,048-bit parity maps of the sets, whose differing bits are a lower
bound of the symmetric difference (pairs that exceed what the threshold
allows are surely apart), then on the shingles of the members that are left,
with exact counts.  Runs repeat until a pair exactly at the threshold is
found with probability ``recall``.

Every class knows all its final buckets; a pair that meets in several is
counted in the smallest common one only, so links are counted exactly once
without listing pairs.  Buckets return one row per member (its links and the
smallest member it is tied to), never pairs.

Defined cases: a null, empty or wordless text has no shingles and no links
and is alone in its class; a text of one to four words has one shingle of all
its words; repeated rows are links like any other copies; a null doc_id is
ordered last.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import materialise, prepare, small_side
from netwarden.llm.graph import components
from netwarden.llm.textops import buffers, mix, shingle_sets, words

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.9995
BUCKET = 8192
BLOCK = 1024  # members of a bucket on one side of a comparison
ALIKE = 3.0  # times the difference that the threshold allows
LEVELS = 3
BRANCHING = 4.0
PARITY_BITS = 2048
PAIRWISE = 6  # buckets up to this size are compared pair by pair


def runs_for(recall: float) -> int:
    """Runs after which any pair of at least ``similarity`` has met with
    probability ``recall``: its common shingles are at least ``similarity`` of
    the larger set, so each run gives it one common sample or more on average."""
    return max(1, math.ceil(-math.log(1.0 - recall)))


def _chosen(tokens: np.ndarray, path: np.ndarray, per_set: float) -> list[np.ndarray]:
    """For each path key the child keys a set chooses: tokens whose rank under
    that path is below per_set / size."""
    bound = min(per_set / max(len(tokens), 1), 1.0)
    rank = mix(tokens[None, :] ^ path[:, None])
    hit = rank <= np.uint64(min(int(bound * 2.0**64), 2**64 - 1))
    return [mix(rank[i][hit[i]] + p) for i, p in enumerate(path)]


def _parity(tokens: np.ndarray) -> bytes:
    """One bit per slot: odd or even number of the set's tokens in it."""
    return np.packbits(np.bincount((tokens & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def _row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text))


def signatures(docs: DataFrame, text: str, doc_id: str, runs: int, similarity: float, n: int) -> DataFrame:
    """(row_key, doc_id, set_key, size, parity, keys): the set's digest, size,
    parity map and level-1 buckets."""
    prepare(docs.sparkSession)
    src = docs.select(_row_key(doc_id, text).alias("row_key"), F.col(doc_id).cast("long").alias("doc_id"),
                      F.col(text).alias("text"))
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column(2))
            _, _, h, bounds = words(data, offsets)
            key, size, par, keys = [], [], [], []
            for t in shingle_sets(h, bounds, n):
                size.append(len(t))
                if len(t) == 0:
                    key.append(b"")
                    par.append(b"")
                    keys.append([])
                    continue
                key.append(t.sum(dtype=np.uint64).tobytes() + mix(t ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes())
                par.append(_parity(t))
                keys.append(np.concatenate(_chosen(t, seeds, 1.0 / similarity)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(key, pa.binary()), pa.array(size, pa.int32()),
                 pa.array(par, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row_key", "doc_id", "set_key", "size", "parity", "keys"])

    return src.mapInArrow(run, "row_key long, doc_id long, set_key binary, size int, parity binary, keys array<long>")


def _tokens_of(docs: DataFrame, text: str, doc_id: str, wanted: DataFrame, n: int) -> DataFrame:
    """(row_key, tokens) of the wanted rows, dealt by row_key."""
    wanted = materialise(wanted, "wanted")
    src = (docs.select(_row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
           .join(small_side(wanted), "row_key"))

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column(1))
            _, _, h, bounds = words(data, offsets)
            toks = [t.tobytes() for t in shingle_sets(h, bounds, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(toks, pa.binary())], names=["row_key", "tokens"])

    return src.mapInArrow(run, "row_key long, tokens binary").dropDuplicates(["row_key"])


def _alike(rows: DataFrame, similarity: float) -> DataFrame:
    """(key) of the large buckets whose members differ little on average: the
    mean Hamming distance of their parity maps, from per-bit counts, is within
    ``ALIKE`` times what the threshold allows sets of their mean size."""
    schema = "key long, n long, size long, bits binary"

    def partial(batches):
        seen: dict = {}
        for b in batches:
            key, size = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(key), -1), axis=1)
            for k in np.unique(key):
                on = key == k
                n, m, c = seen.get(k, (0, 0, 0))
                seen[k] = (n + int(on.sum()), m + int(size[on].sum()), c + bits[on].sum(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(k) for k in seen], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()),
             pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[2].tobytes() for v in seen.values()], pa.binary())],
            names=["key", "n", "size", "bits"])

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = int(pdf["n"].sum()), float(pdf["size"].sum())
        p = sum(np.frombuffer(x, np.int64) for x in pdf["bits"]) / n
        allowed = (1.0 - similarity) / (1.0 + similarity) * 2.0 * m / n
        return pdf[["key"]].head(1 if (2 * p * (1 - p)).sum() <= ALIKE * allowed else 0)

    return rows.mapInArrow(partial, schema).groupBy("key").applyInPandas(total, "key long")


def _sorted_out(level: DataFrame, counts: DataFrame, classes: DataFrame, bucket: int, block: int, similarity: float):
    """(row_key, key, blocks) of the buckets to compare now, and of those to split."""
    rows = level.join(counts, "key").select("row_key", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"), "n")
    now = rows.filter(F.col("n") <= bucket).drop("n")
    large = rows.filter(F.col("n") > bucket).drop("n")
    if large.isEmpty():
        return now, large
    alike = materialise(_alike(large.join(classes, "row_key").select("key", "size", "parity"), similarity), "alike")
    return (now.unionByName(large.join(alike, "key").select("row_key", "key", "blocks")),
            large.join(alike, "key", "left_anti").select("row_key", "key", "blocks"))


def _split(rows: DataFrame, tokens: DataFrame, per_set: float) -> DataFrame:
    """Children of the large buckets: (row_key, key) -> (row_key, child key)."""
    src = rows.groupBy("row_key").agg(F.collect_list("key").alias("paths")).join(tokens, "row_key")

    def run(batches):
        for b in batches:
            ids, paths, toks = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out_id, out_key = [], []
            for i, p, t in zip(ids, paths, toks):
                got = np.concatenate(_chosen(np.frombuffer(t, np.uint64), np.array(p, np.int64).view(np.uint64), per_set))
                out_key.append(np.unique(got.view(np.int64)))
                out_id.append(np.full(len(out_key[-1]), i, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_id) if out_id else [], pa.int64()),
                 pa.array(np.concatenate(out_key) if out_key else [], pa.int64())], names=["row_key", "key"])

    return src.select("row_key", "paths", "tokens").mapInArrow(run, "row_key long, key long")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[left] x sets[right]."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    allt = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, inv, n = np.unique(allt, return_inverse=True, return_counts=True)
    shared = n[inv] > 1
    cols, owner = inv[shared], of[shared]
    u, col = np.unique(cols, return_inverse=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for a in range(0, len(u), step):
        lo, hi = np.searchsorted(col, [a, a + step])
        m = np.zeros((len(sets), min(step, len(u) - a)), dtype=np.float32)
        m[owner[lo:hi], col[lo:hi] - a] = 1.0
        out += m[left] @ m[right].T
    return out


def _sides(block: np.ndarray, b0: int, b1: int) -> tuple[np.ndarray, np.ndarray]:
    if b0 == b1:
        both = np.arange(len(block))
        return both, both
    return np.flatnonzero(block == b0), np.flatnonzero(block == b1)


def _first_meeting(bucket: int, leaves: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether ``bucket`` is the smallest bucket that two members share."""
    if len(left) <= PAIRWISE and len(right) <= PAIRWISE:
        sets = [{k for k in ks if k < bucket} for ks in leaves]
        return np.array([[sets[i].isdisjoint(sets[j]) for j in right] for i in left], dtype=bool).reshape(len(left), len(right))
    earlier = [np.unique(np.array([k for k in ks if k < bucket], np.int64)).view(np.uint64) for ks in leaves]
    return _common(earlier, left, right) == 0


def plausible(bucket: int, b0: int, b1: int, ids, block, size, parity, leaves, similarity: float) -> np.ndarray:
    """Members with a partner that the parity maps do not rule out and that
    they meet here first; ``parity`` is (members, words) of uint64."""
    left, right = _sides(block, b0, b1)
    out = np.zeros(len(ids), dtype=bool)
    if not len(left) or not len(right):
        return out
    total = size[left][:, None] + size[right][None, :]
    near = ids[left][:, None] != ids[right][None, :]
    # |x ^ y| = |x| + |y| - 2 common <= (1 - s) / (1 + s) * (|x| + |y|)
    allowed = (1.0 - similarity) / (1.0 + similarity) * total + 1e-6
    near &= np.abs(size[left][:, None] - size[right][None, :]) <= allowed
    for i in range(0, len(left), 128):
        apart = np.bitwise_count(parity[left[i:i + 128]][:, None, :] ^ parity[right][None, :, :]).sum(2, dtype=np.int64)
        near[i:i + 128] &= apart <= allowed[i:i + 128]
    if near.any():
        near &= _first_meeting(bucket, leaves, left, right)
        out[left[near.any(1)]] = True
        out[right[near.any(0)]] = True
    return out


def compare_bucket(bucket: int, b0: int, b1: int, ids, block, weight, sets, leaves, similarity: float):
    """Exact comparison of a bucket's members (or of two of its blocks): per
    member the links counted here and the smallest member it is tied to."""
    left, right = _sides(block, b0, b1)
    count, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
    if not len(left) or not len(right):
        return count, root
    size = np.array([len(t) for t in sets], dtype=np.float64)
    if len(ids) <= PAIRWISE:
        common = np.zeros((len(left), len(right)))
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if x < y or left is not right:
                    a, b = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
                    common[i, j] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
        if left is right:
            common += common.T
    else:
        common = _common(sets, left, right)
    # J >= s  <=>  common * (1 + s) >= s * (|x| + |y|); one part in 10^9 for the rounding of s
    linked = common * (1.0 + similarity) >= similarity * (size[left][:, None] + size[right][None, :]) * (1 - 1e-9)
    linked &= ids[left][:, None] != ids[right][None, :]
    if not linked.any():
        return count, root
    once = linked & _first_meeting(bucket, leaves, left, right)
    np.add.at(count, left, once @ weight[right])
    if left is not right:
        np.add.at(count, right, once.T @ weight[left])
    # ties: smallest reachable member, by repeated neighbour minima
    big = np.iinfo(np.int64).max
    while True:
        new = root.copy()
        for at, other, adj in ((left, right, linked), (right, left, linked.T)):
            for i in range(0, len(at), 256):
                low = np.where(adj[i:i + 256], root[other][None, :], big).min(1)
                np.minimum.at(new, at[i:i + 256], low)
        if (new == root).all():
            return count, root
        root = new


def _buckets(batches):
    """Groups of rows with equal first three columns, from sorted batches; a
    group may cross batches and is held whole (buckets are bounded)."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        key = np.stack([held.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        if len(cuts):
            yield held.slice(0, int(cuts[-1])), np.concatenate([[0], cuts]), key
            held = held.slice(int(cuts[-1])).combine_chunks()
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows]), np.stack([held.column(i).to_numpy() for i in range(3)], axis=1)


def _dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "b0", "b1").sortWithinPartitions("key", "b0", "b1", "row_key")


def _sift(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, b0, b1, row_key): the members that need the exact comparison."""
    def run(batches):
        for t, cuts, key in _buckets(batches):
            ids, block = t.column("row_key").to_numpy(), t.column("block").to_numpy()
            size = t.column("size").to_numpy().astype(np.float64)
            parity = np.frombuffer(b"".join(t.column("parity").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            leaves = t.column("leaves").to_pylist()
            keep = np.zeros(len(ids), dtype=bool)
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z - a > 1:
                    keep[a:z] = plausible(int(key[a, 0]), int(key[a, 1]), int(key[a, 2]), ids[a:z], block[a:z],
                                          size[a:z], parity[a:z], leaves[a:z], similarity)
            got = t.select(["key", "b0", "b1", "row_key", "block", "leaves"]).filter(pa.array(keep))
            yield from got.combine_chunks().to_batches()

    return _dealt(rows).mapInArrow(run, "key long, b0 int, b1 int, row_key long, block int, leaves array<long>")


def _compare(rows: DataFrame, similarity: float) -> DataFrame:
    """(row_key, links, root) of every bucket's members that have a link."""
    def run(batches):
        for t, cuts, key in _buckets(batches):
            ids, block = t.column("row_key").to_numpy(), t.column("block").to_numpy()
            weight = t.column("weight").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
            leaves = t.column("leaves").to_pylist()
            out = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z - a > 1:
                    # a row that is in the table more than once stands once
                    own = a + np.unique(ids[a:z], return_index=True)[1]
                    n, root = compare_bucket(int(key[a, 0]), int(key[a, 1]), int(key[a, 2]), ids[own], block[own],
                                             weight[own], [sets[i] for i in own], [leaves[i] for i in own], similarity)
                    some = (n > 0) | (root != ids[own])
                    out.append((ids[own][some], n[some], root[some]))
            cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row_key", "links", "root"])

    return _dealt(rows).mapInArrow(run, "row_key long, links long, root long")


def similarity_classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY,
                       recall: float = RECALL, n: int = NGRAM, bucket: int = BUCKET, block: int = BLOCK,
                       levels: int = LEVELS, branching: float = BRANCHING) -> DataFrame:
    """One row per input row: ``row_key`` (digest of doc_id and text), doc_id,
    ``rep_id`` (smallest doc_id with the same shingle set), ``group_id``
    (smallest doc_id connected by links), ``keep`` (this row's key is the one
    that stands for the whole group), ``n_links`` (other rows of similarity at
    least ``similarity``)."""
    runs = runs_for(recall)
    sig = materialise(signatures(docs, text, doc_id, runs, similarity, n), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"),
                         "size", "parity", "keys"))
    classes = sig.filter("size > 0").groupBy("set_key").agg(rep.alias("_rep"), F.count(F.lit(1)).alias("weight"))
    classes = materialise(classes.select("set_key", F.col("_rep.k").alias("row_key"), F.col("_rep.d").alias("rep_id"),
                                         "weight", "_rep.size", "_rep.parity", "_rep.keys"), "classes")
    # level 1: the representatives' buckets
    level = classes.select("row_key", F.explode("keys").alias("key")).distinct()
    level = materialise(level, "paths")
    counts = materialise(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    small, large = _sorted_out(level, counts, classes, bucket, block, similarity)
    leaves, tokens, depth = [small], None, 1
    while depth < levels and not large.isEmpty():
        depth += 1
        if tokens is None:  # the shingles of the large buckets' members
            tokens = materialise(_tokens_of(docs, text, doc_id, large.select("row_key").distinct(), n), "tokens")
        level = materialise(_split(large, tokens, branching / similarity), "paths")
        counts = materialise(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
        small, large = _sorted_out(level, counts, classes, bucket, block, similarity)
        leaves.append(small)
    # what the deepest level left large is compared block against block
    leaves.append(large)
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    leaf = materialise(leaf, "leaves")
    # every member with its parity map and all its buckets, once per bucket (and block pair)
    own = (leaf.groupBy("row_key").agg(F.collect_list("key").alias("leaves"),
                                       F.collect_list(F.struct("key", "blocks")).alias("at"))
           .join(classes.select("row_key", "size", "parity"), "row_key")
           .select("row_key", "size", "parity", "leaves", F.explode("at").alias("at")))
    b, k = F.pmod(F.xxhash64("row_key", F.lit(5)), F.col("at.blocks")).cast("int"), F.col("at.blocks")
    sent = own.select("*", F.col("at.key").alias("key"), b.alias("block"), F.explode(F.sequence(F.lit(0), k - 1)).alias("other"))
    sent = sent.select("key", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"),
                       "row_key", "block", "size", "parity", "leaves")
    left = materialise(_sift(sent, similarity), "sifted")
    # the exact comparison of what is left
    tokens = _tokens_of(docs, text, doc_id, left.select("row_key").distinct(), n)
    last = left.join(classes.select("row_key", "weight"), "row_key").join(tokens, "row_key").select(
        "key", "b0", "b1", "row_key", "block", "weight", "tokens", "leaves")
    found = materialise(_compare(last, similarity), "found")
    links = found.groupBy("row_key").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("row_key").alias("u"), F.col("root").alias("v")), "groups")
    # the group's document: the smallest doc_id among its classes
    member = classes.join(links, "row_key", "left").join(
        comp.select(F.col("node").alias("row_key"), "component"), "row_key", "left")
    member = member.select(
        "set_key", "row_key", "rep_id", F.coalesce("component", "row_key").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    member = materialise(member, "members")
    head = member.groupBy("component").agg(F.min(F.struct(
        F.col("rep_id").isNull().alias("n"), F.col("rep_id").alias("d"), F.col("row_key").alias("k"))).alias("_h"))
    member = member.join(head, "component").select(
        "set_key", "rep_id", F.col("_h.d").alias("group_id"), F.col("_h.k").alias("_head"), "n_links")
    out = sig.filter("size > 0").select("row_key", "doc_id", "set_key").join(member, "set_key").select(
        "row_key", "doc_id", "rep_id", "group_id", (F.col("row_key") == F.col("_head")).alias("keep"), "n_links")
    alone = sig.filter("size = 0").select(
        "row_key", "doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("group_id"),
        F.lit(True).alias("keep"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group left (smallest doc_id; nulls last);
    rows without words all stay."""
    kept = similarity_classes(docs, text=text, doc_id=doc_id, **options).filter("keep").select(
        F.col("row_key").alias("_llm_key")).distinct()
    marked = docs.withColumn("_llm_key", _row_key(doc_id, text))
    wordless = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "")) == 0
    stay = marked.join(kept, "_llm_key", "left_semi").withColumn("_llm_none", wordless)
    # repeated rows share one key: one of them stays
    return (stay.filter("not _llm_none").dropDuplicates(["_llm_key"])
            .unionByName(stay.filter("_llm_none")).drop("_llm_key", "_llm_none"))
