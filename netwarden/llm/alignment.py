"""Token alignment between two tokenizers with an identity-map fast path.

Both tokenizers encode the space-prefixed text.  Byte offsets where a token of
both ends cut the text into groups; the A token and the B token that end a
group together are linked.  Neither tokenizer joins anything across a space
that follows a non-space character, so texts are cut there and every distinct
chunk is encoded and aligned once per worker (a bounded cache).

``same[a]`` is the B id with the bytes of A id ``a``.  A group of one A and one
B token with ``b = same[a]`` is counted in a vector of the vocabulary's length,
which every task adds up for itself; only the other links (irregular
ones) are counted as id pairs through a shuffle.  The counts come back the same
way: identity links by the (vocabulary-sized) vectors, irregular links by a
join of each document's distinct pairs with the pair table.

Defined cases: null and empty texts, and texts whose joined token bytes differ
from the space-prefixed text under either tokenizer (such as those holding
U+2581), have no tokens, zero counts and an empty digest; strings of special
tokens are plain text; repeated rows each get their counts and count twice; an
empty table gives no rows; a text of any length is worked on in slices; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.llm.common import materialise, prepare

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
CACHED_CHUNKS = 1 << 18
CACHED_CHARS = 1 << 23
CACHED_LENGTH = 64
SLICE = 1 << 20
SHIFT = 32  # a pair of ids as one number: a << 32 | b

_CUT = re.compile(r" (?<=\S )")
_STATE: dict = {}

_RAW = ("doc_id long, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "same_id array<int>, same_n array<int>, pair array<long>, pair_n array<int>")


def _letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Pair:
    """Two tokenizers, their tokens' bytes, the identity map and the chunk cache."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _letters()
        entries = json.loads(a_json)["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        # of several B ids with the same bytes the one that encoding gives most: a piece before a byte
        by_bytes = {}
        for i in sorted(range(len(self.b_bytes)), key=lambda i: (not self.b.is_byte(i), i)):
            by_bytes[self.b_bytes[i]] = i
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], dtype=np.int64)
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.one = [f"{a}|{b}" for a, b in enumerate(self.same.tolist())]  # an identity group's text
        self.space = self.b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        """An empty cache: per chunk its token and group counts, the text of its
        groups, and its links ``first[i]:first[i + 1]`` of ``links``."""
        self.at: dict[str, int] = {}
        self.counts, self.text = np.zeros((3, 0), dtype=np.int64), []
        self.links, self.first = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.used, self.held = np.zeros(0, dtype=np.int64), 0

    def trim(self) -> None:
        """A full cache keeps the chunks used most, half of it at most."""
        if len(self.text) <= CACHED_CHUNKS and self.held <= CACHED_CHARS:
            return
        names, used = list(self.at), self.used
        keep = np.flatnonzero((used > 1) & (np.array([len(p) for p in names]) <= CACHED_LENGTH))
        keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[:CACHED_CHUNKS // 2]])
        size = np.diff(self.first)[keep]
        self.links = self.links[_ranges(self.first[keep], size)]
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.counts, self.text = self.counts[:, keep], [self.text[i] for i in keep.tolist()]
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.used, self.held = np.ones(len(keep), dtype=np.int64), sum(map(len, self.at))

    def learn(self, new: list[str]) -> None:
        """Encode and align the chunks ``" " + piece`` of new pieces, all at once."""
        whole = [(" " + p).encode("utf-8", "surrogatepass") for p in new]
        a = [x.ids for x in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)]
        b = [y if p else [self.space] for p, y in zip(new, self.b.encode(new, num_threads=1))]
        n_a, n_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(t), dtype=np.int64) for t in (a, b))
        full = b"".join(whole)
        good = np.ones(len(new), dtype=bool)
        if b"".join([self.a_bytes[i] for i in ids_a.tolist()]) != full or b"".join([self.b_bytes[i] for i in ids_b.tolist()]) != full:
            for k, (x, y, w) in enumerate(zip(a, b, whole)):  # some chunk's bytes differ: find it
                good[k] = b"".join([self.a_bytes[i] for i in x]) == w == b"".join([self.b_bytes[i] for i in y])
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        # positions in the joined bytes: chunks end in both, so no group crosses one
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        common, i, j = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        la, lb = ids_a[i], ids_b[j]
        identity = (np.diff(i, prepend=-1) == 1) & (np.diff(j, prepend=-1) == 1) & (self.same[la] == lb)
        ends = np.cumsum(np.where(good, [len(w) for w in whole], 0))
        upto = np.searchsorted(common, ends, side="right")  # groups of the chunks so far
        n_groups = np.diff(upto, prepend=0)
        texts = [self.one[x] for x in la.tolist()]
        i0, j0 = np.concatenate([[0], i[:-1] + 1]), np.concatenate([[0], j[:-1] + 1])
        for k in np.flatnonzero(~identity).tolist():
            texts[k] = (",".join(map(str, ids_a[i0[k]:i[k] + 1].tolist())) + "|" + ",".join(map(str, ids_b[j0[k]:j[k] + 1].tolist())))
        at, start = len(self.text), 0
        for k, stop in enumerate(upto.tolist()):
            self.at[new[k]] = at + k
            self.text.append(";".join(texts[start:stop]))
            start = stop
        # an identity link is the A id, another one a pair below zero
        links = np.where(identity, la, -((la << SHIFT | lb) + 1))
        self.counts = np.hstack([self.counts, [n_a, n_b, np.where(good, n_groups, -1)]])
        self.links = np.concatenate([self.links, links])
        self.first = np.concatenate([self.first, self.first[-1] + upto])
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])
        self.held += sum(map(len, new))

    def entries(self, pieces: list[str]) -> np.ndarray:
        """Cache entries of pieces."""
        new = list(set(pieces).difference(self.at))
        if new:
            self.learn(new)
        idx = np.fromiter(map(self.at.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        self.used += np.bincount(idx, minlength=len(self.used))
        return idx


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, first + size), one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def read_files(a_file: str, b_file: str) -> tuple[str, bytes]:
    """The two vocabulary files, read on the driver and sent to the executors
    (their size is that of the vocabularies)."""
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        return a.read(), b.read()


def pair_of(files: tuple[str, bytes]) -> Pair:
    """One :class:`Pair` a worker."""
    key = (zlib.crc32(files[0].encode()), zlib.crc32(files[1]))
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = Pair(*files)
    return _STATE[key]


def _slices(text: str):
    """Pieces of about ``SLICE`` characters, each cut where chunks are cut."""
    at = 0
    while len(text) - at > SLICE:
        m = _CUT.search(text, at + SLICE)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


def _units(texts: list[str | None]):
    """Lists of (text number, slice) of about ``SLICE`` characters each."""
    unit, size = [], 0
    for k, text in enumerate(texts):
        for part in _slices(text) if text else ():
            unit.append((k, part))
            size += len(part)
            if size >= SLICE:
                yield unit
                unit, size = [], 0
    if unit:
        yield unit


def _tally(doc: np.ndarray, value: np.ndarray, n: np.ndarray):
    """Summed (text, value, n), ascending."""
    order = np.lexsort((value, doc))
    doc, value, n = doc[order], value[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))[:len(doc)]
    return doc[at], value[at], np.add.reduceat(n, at) if len(at) else n


def align_texts(pair: Pair, texts: list[str | None]):
    """Counts (3, texts) of A tokens, B tokens and groups, the digests, and the
    links (text, link, n) of all texts: an A id, or below zero a pair."""
    counts = np.zeros((3, len(texts)), dtype=np.int64)
    bad = np.zeros(len(texts), dtype=bool)
    digests = [None] * len(texts)
    parts = [(np.zeros(0, np.int64),) * 3]
    for unit in _units(texts):
        pieces = [_CUT.split(part) for _, part in unit]
        size = np.array([len(p) for p in pieces])
        idx = pair.entries(list(chain.from_iterable(pieces)))
        doc = np.repeat([k for k, _ in unit], size)
        c = pair.counts[:, idx]
        bad[doc[c[2] < 0]] = True
        np.add.at(counts, (slice(None), doc), c)
        at, text = 0, pair.text
        rows = idx.tolist()
        for (k, _), n in zip(unit, size.tolist()):
            if digests[k] is None:
                digests[k] = hashlib.sha256()
            else:
                digests[k].update(b";")
            digests[k].update(";".join([text[r] for r in rows[at:at + n]]).encode())
            at += n
        n = np.diff(pair.first)[idx]
        links, owner = pair.links[_ranges(pair.first[idx], n)], np.repeat(doc, n)
        parts.append(_tally(owner, links, np.ones(len(links), dtype=np.int64)))
        pair.trim()
    doc, link, n = _tally(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
    counts[:, bad] = 0
    good = ~bad[doc]
    return (counts, ["" if d is None or x else d.hexdigest() for d, x in zip(digests, bad.tolist())],
            (doc[good], link[good], n[good]))


def _lists(doc: np.ndarray, value: np.ndarray, rows: int, kind) -> pa.Array:
    cut = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value, pa.int64()).cast(kind))


def tokens(docs: DataFrame, text: str, doc_id: str, files: tuple[str, bytes]) -> DataFrame:
    """One row a document: token and group counts, digest, identity ids and
    irregular pairs with their counts in the document."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        from pyspark import TaskContext
        pair, row = pair_of(shared.value), TaskContext.get().partitionId() << 33
        for b in batches:
            rows = b.num_rows
            counts, digests, (doc, link, n) = align_texts(pair, b.column(1).to_pylist())
            uid, row = np.arange(row, row + rows, dtype=np.int64), row + rows
            same, other = link >= 0, link < 0
            totals = [pa.array(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(uid), *totals, totals[2], pa.array(digests, pa.string()),
                 _lists(doc[same], link[same], rows, pa.int32()), _lists(doc[same], n[same], rows, pa.int32()),
                 _lists(doc[other], -link[other] - 1, rows, pa.int64()), _lists(doc[other], n[other], rows, pa.int32())],
                names=[f.split()[0] for f in _RAW.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _RAW)


def _identity_counts(table: DataFrame, size: int) -> DataFrame:
    """(a, n): each task adds its documents' identity links in one vector."""
    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            ids, n = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
            total += np.bincount(ids, weights=n, minlength=size).astype(np.int64)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], names=["a", "n"])

    return table.select("same_id", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _vector(rows, key: str, size: int) -> np.ndarray:
    """A vocabulary-length vector of (id, n) rows: bounded by the vocabulary."""
    out = np.zeros(size, dtype=np.int64)
    for batch in rows.toArrow().to_batches():
        out[batch.column(key).to_numpy()] = batch.column("n").to_numpy()
    return out


def align(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    spark = docs.sparkSession
    prepare(spark)
    files = read_files(a_file, b_file)
    pair = pair_of(files)
    size_a, size_b, same = len(pair.a_bytes), len(pair.b_bytes), pair.same
    table = materialise(tokens(docs, text, doc_id, files), "tokens")

    irregular = table.select("uid", F.explode(F.arrays_zip("pair", "pair_n")).alias("x")).select(
        "uid", F.col("x.pair").alias("pair"), F.col("x.pair_n").cast("long").alias("n"))
    pairs = materialise(irregular.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    count_a = _vector(_identity_counts(table, size_a), "a", size_a)
    best = _vector(pairs.groupBy((F.col("pair") % (1 << SHIFT)).alias("b")).agg(F.max("count").alias("n")), "b", size_b)
    known = same >= 0
    np.maximum.at(best, same[known], count_a[known])

    # identity links by the vectors
    is_best = np.zeros(size_a, dtype=bool)
    is_best[known] = count_a[known] == best[same[known]]
    vectors = spark.sparkContext.broadcast((count_a, is_best))
    names = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = T.StructType([f for f in table.select(*names).schema.fields] +
                          [T.StructField("best0", T.LongType()), T.StructField("sum0", T.LongType())])

    def run(batches):
        count, top = vectors.value
        for b in batches:
            ids, n = b.column(len(names)).flatten().to_numpy(), b.column(len(names) + 1).flatten().to_numpy().astype(np.int64)
            off = np.concatenate([[0], np.cumsum(b.column(len(names)).value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (n * top[ids], n * count[ids])]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] +
                                             [pa.array(s[off[1:]] - s[off[:-1]]) for s in sums],
                                             names=[f.name for f in schema.fields])

    known_part = table.select(*names, "same_id", "same_n").mapInArrow(run, schema)
    # irregular links by their pair: one row per (document, distinct pair)
    tops = F.broadcast(spark.createDataFrame(pa.table({"b": np.arange(size_b), "top": best})))
    scored = pairs.withColumn("b", F.col("pair") % (1 << SHIFT)).join(tops, "b").select(
        "pair", "count", (F.col("count") == F.col("top")).cast("long").alias("is_top"))
    rest = irregular.join(scored, "pair").groupBy("uid").agg(
        F.sum(F.col("n") * F.col("is_top")).alias("best1"), F.sum(F.col("n") * F.col("count")).alias("sum1"))
    zero = F.lit(0).cast("long")
    return known_part.join(rest, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best0") + F.coalesce("best1", zero)).alias("n_best"),
        (F.col("sum0") + F.coalesce("sum1", zero)).alias("count_sum"), "groups_sha256")
