"""Toxicity by a noisy channel: obfuscated writing is restored, then scored.

Units that may hide something (letters mixed with look-alike digits and
symbols, a letter three times in a row, single letters set apart by spaces or
marks) become a lattice: every character may stand for itself, for a letter
it looks like, for part of a repeated letter, or (between single letters) for
nothing.  A Viterbi search picks the reading of least cost under a character
model, four-grams of letter classes counted over every text of the corpus,
plus the channel's costs.  All other units have one reading and need no search.

The words of the restored text (and of the literal reading) give features:
the word and its beginnings of ``STARTS`` bytes, as 64-bit hashes.  Documents
per feature and label are counted in a bounded sample of labelled texts
(``LABELLED_ROWS``, smallest id hash), first by slot in those of label 1, then
exactly for the features of the slots that can matter; those that tell most
(``FEATURES`` at most) get weights from a logistic regression on that sample.

Defined cases: a null or empty text, or one without a telling word, scores
the model's value for no feature; without labels every score is 0.5; null
labels are left out, a row labelled more than once counts with the mean of
its labels and a labelled doc_id with several texts with the smallest; repeated rows each get their score; an empty table gives no rows;
texts of any length are read whole in blocks of 1 MB cut at white space (a
spaced word across a cut is read as two), and of a unit without white space only
the best path goes on every ``WINDOW`` characters; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.llm.common import carried, materialise, prepare
from netwarden.llm.textops import _powers, blocks, buffers, mix, runs

LABELLED_ROWS = 20_000
SLOTS = 1 << 22
FEATURES = 512
MIN_GAIN = 12.0       # log-likelihood ratio of a telling feature
MIN_TOXIC = 3         # documents of label 1 that this gain needs at least
STARTS = (4, 5, 6, 7, 8)
RIDGE = 1.0
THRESHOLD = 0.5
WINDOW = 4096
CACHED_UNITS = 1 << 17
CACHED_LENGTH = 40

# Letters that a digit or symbol is written for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
              "|": "il", "+": "t", "(": "c"}
MARKS = ".-_*~/"
# Channel costs (natural log): a look-alike, a repeated letter as one (a doubled
# one more seldom), a mark between single letters that means nothing; a look-alike that means itself
# between letters or at a word's edge, a mark that means itself there.
LOOKALIKE, REPEAT, DOUBLE, JOIN, LITERAL, LITERAL_EDGE, APART = 0.5, 1.0, 3.0, 0.5, 5.0, 3.0, 4.0

CLASSES = 32  # 0 no letter, 1-26 a-z, the rest bytes beyond ASCII
_FOLD = np.zeros(256, dtype=np.uint8)
_CLASS = np.zeros(256, dtype=np.int64)
_LOOK, _MARK, _UNIT = (np.zeros(256, dtype=bool) for _ in range(3))
for _b in range(256):
    low = _b + 32 if 65 <= _b <= 90 else _b
    if 97 <= low <= 122 or _b >= 128:
        _FOLD[_b] = low
        _CLASS[_b] = low - 96 if _b < 128 else 27 + _b % 5
    _LOOK[_b], _MARK[_b] = chr(_b) in LOOKALIKES, chr(_b) in MARKS
    _UNIT[_b] = _b > 32
_LETTER = _FOLD != 0
_END_MARKS = b".,;:?!'\")]}$"


# --- the character model ------------------------------------------------------------

def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter-class four-grams over every text (word edges are class
    0; a context never reaches over an edge).  Each task adds up one vector."""
    prepare(docs.sparkSession)
    size = CLASSES ** 4

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            data, offsets = buffers(b.column(0))
            for a, e in blocks(data, _UNIT, offsets):
                total += _grams(data[a:e], offsets[(offsets > a) & (offsets < e)] - a)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], names=["key", "n"])

    # at most CLASSES ** 4 rows
    rows = docs.select(text).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    return out


def _grams(data: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Four-gram counts of a block that begins and ends between words;
    ``inner`` are the text starts inside it."""
    c = _CLASS[data]
    if len(inner):  # an edge between two texts
        c = np.insert(c, inner, 0)
    c = np.concatenate([[0, 0, 0], c, [0]])
    three, now = c[2:-1], c[3:]
    two = np.where(three == 0, 0, c[1:-2])
    one = np.where(two == 0, 0, c[:-3])
    some = (three != 0) | (now != 0)
    return np.bincount((((one * CLASSES + two) * CLASSES + three) * CLASSES + now)[some], minlength=CLASSES ** 4)


def gram_costs(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Negative log probabilities of the next class by context, flat; each
    order is smoothed by the one below."""
    n4 = counts.reshape((CLASSES,) * 4).astype(np.float64)
    n3 = n4.sum(0)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p = (n1 + 1) / (n1.sum() + CLASSES)
    for n in (n2, n3, n4):
        p = (n + weight * p) / (n.sum(-1, keepdims=True) + weight)
    return -np.log(p).ravel()


# --- the channel ----------------------------------------------------------------------

def restore(unit: bytes, cost: list[float]) -> bytes:
    """Most likely reading of a folded unit: words set apart by spaces.
    ``cost`` is the character model as a flat list."""
    n, square, cube = len(unit), CLASSES ** 2, CLASSES ** 3
    cls = [int(_CLASS[c]) for c in unit]
    looks = [[ord(x) for x in LOOKALIKES.get(chr(c), "")] for c in unit]
    after = list(range(1, n + 1))  # end of the run of one letter from here
    for i in range(n - 2, -1, -1):
        if unit[i] == unit[i + 1] and cls[i]:
            after[i] = after[i + 1]
    # context (three classes as one number) -> (cost, path); a path is (path before, emitted byte)
    level: list[dict | None] = [{} for _ in range(n + 1)]
    level[0][0] = (0.0, None)
    done = []

    def put(to, state, value, path, byte):
        old = level[to].get(state)
        if old is None or value < old[0]:
            level[to][state] = (value, (path, byte) if byte else path)

    def spell(path) -> bytes:
        out = []
        while path is not None:
            out.append(path[1])
            path = path[0]
        return bytes(reversed(out))

    for i in range(n):
        k = cls[i]
        if i and i % WINDOW == 0:  # bounded memory: what lies behind the best path is settled
            state, (value, path) = min(level[i].items(), key=lambda x: x[1][0])
            done.append(spell(path))
            level[i] = {state: (value, None)}
        left = i > 0 and bool(cls[i - 1] or looks[i - 1])
        right = i < n - 1 and bool(cls[i + 1] or looks[i + 1])
        for state, (value, path) in level[i].items():
            row, later = state * CLASSES, state % square * CLASSES
            if k:
                put(i + 1, later + k, value + cost[row + k], path, unit[i])
                if after[i] > i + 1:
                    put(after[i], later + k, value + cost[row + k] + (REPEAT if after[i] > i + 2 else DOUBLE), path, unit[i])
                continue
            for letter in looks[i]:
                c = letter - 96
                put(i + 1, later + c, value + cost[row + c] + LOOKALIKE, path, letter)
            edge = cost[row] if state % CLASSES else 0.0
            if looks[i]:
                edge += LITERAL if left and right else LITERAL_EDGE if left or right else 0.0
            elif left and right:
                put(i + 1, state, value + JOIN, path, 0)
                edge += APART
            put(i + 1, 0, value + edge, path, 32)
        level[i] = None
    best = min(level[n].items(), key=lambda x: x[1][0] + (cost[x[0] * CLASSES] if x[0] % CLASSES else 0.0))
    return b"".join(done) + spell(best[1][1])


def hidden_units(data: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the units of a block that may hide something, ascending."""
    n = len(data)
    if n < 3:
        return []
    letter, look, unit = _LETTER[data], _LOOK[data], _UNIT[data]
    low = np.where(letter, _FOLD[data], data)
    hit = np.zeros(n, dtype=bool)
    hit[:-1] = (letter[:-1] & look[1:]) | (look[:-1] & letter[1:])
    hit[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    apart = _MARK[data]
    if n >= 5:
        hit[:-4] |= letter[:-4] & apart[1:-3] & letter[2:-2] & apart[3:-1] & letter[4:]
    out = set()
    at = np.flatnonzero(hit)
    if len(at):
        edge = np.concatenate([[-1], np.flatnonzero(~unit), [n]])
        k = np.unique(np.searchsorted(edge, at))
        out.update(zip((edge[k - 1] + 1).tolist(), edge[k].tolist()))
    padded = np.concatenate([[False], unit, [False]])
    single = unit & (letter | look) & ~padded[:-2] & ~padded[2:]
    if n >= 5:
        at = np.flatnonzero(single[:-4] & single[2:-2] & single[4:])
        if len(at):  # runs of single characters set apart by one white space each
            cut = np.flatnonzero(np.concatenate([[True], np.diff(at) != 2]))
            out.update(zip(at[cut].tolist(), (at[np.append(cut[1:] - 1, len(at) - 1)] + 5).tolist()))
    return sorted(out)


class Channel:
    """Readings of units, with a bounded cache."""

    def __init__(self, costs: np.ndarray):
        self.cost, self.cache = costs.tolist(), {}

    def reading(self, unit: bytes) -> bytes:
        found = self.cache.get(unit)
        if found is None:
            found = restore(unit, self.cost)
            if len(unit) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED_UNITS:
                    self.cache.clear()
                self.cache[unit] = found
        return found

    def readings(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Restored units of all texts: (bytes, offsets, text of each)."""
        out, docs = [], []
        for a, b in blocks(data, _UNIT, offsets):
            cuts = offsets[(offsets > a) & (offsets < b)] - a
            block = np.insert(data[a:b], np.repeat(cuts, 2), 32)  # two spaces where two texts meet
            cuts = cuts + 2 * np.arange(len(cuts))
            first = int(np.searchsorted(offsets, a, side="right")) - 1
            folded = np.where(_LETTER[block], _FOLD[block], np.where(_UNIT[block], block, 32)).astype(np.uint8).tobytes()
            for s, e in hidden_units(block):
                core = folded[s:e].rstrip(_END_MARKS)
                if len(core) > 2:
                    out.append(self.reading(core))
                    docs.append(first + int(np.searchsorted(cuts, s)))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        return np.frombuffer(b"".join(out), dtype=np.uint8), ends, np.array(docs, dtype=np.int64)


def _hashes(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None):
    """(text, 64-bit feature) of every word and word beginning, by block; with
    ``wanted`` only features of the slots marked there."""
    docs, found = [], []
    for a, b in blocks(data, _LETTER, offsets):
        s, e = runs(data, _LETTER, offsets, a, b)
        if not len(s):
            continue
        p, inv = _powers(b - a + 1)
        c = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_FOLD[data[a:b]].astype(np.uint64) * p[:b - a], out=c[1:])
        doc = np.searchsorted(offsets, s + a, side="right") - 1
        for k in (0, *STARTS):
            at = np.arange(len(s)) if k == 0 else np.flatnonzero(e - s > k)
            end = e[at] if k == 0 else s[at] + k
            h = mix((c[end] - c[s[at]]) * inv[s[at]] + np.uint64(k))
            d = doc[at]
            if wanted is not None:
                some = wanted[(h % np.uint64(SLOTS)).astype(np.int64)]
                h, d = h[some], d[some]
            docs.append(d)
            found.append(h)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(found)


def features(data: np.ndarray, offsets: np.ndarray, channel: Channel, wanted: np.ndarray | None = None):
    """(text, feature, occurrences) of the literal and the restored words, sorted by text and feature."""
    doc, h = _hashes(data, offsets, wanted)
    more, ends, owner = channel.readings(data, offsets)
    if len(owner):
        d2, h2 = _hashes(more, ends, wanted)
        doc, h = np.concatenate([doc, owner[d2]]), np.concatenate([h, h2])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


# --- the score ---------------------------------------------------------------------------

class Scorer:
    """Telling features (ascending), their weights and the character model."""

    def __init__(self, costs: np.ndarray, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.costs, self.chosen, self.weights, self.bias = costs, chosen, weights, bias
        self.wanted = _marked(chosen)

    def scores(self, data: np.ndarray, offsets: np.ndarray, channel: Channel) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        doc, f, n = _chosen(data, offsets, channel, self.chosen, self.wanted)
        np.add.at(z, doc, self.weights[f] * (1.0 + np.log(n)))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def _marked(features_: np.ndarray) -> np.ndarray:
    out = np.zeros(SLOTS, dtype=bool)
    out[(features_ % np.uint64(SLOTS)).astype(np.int64)] = True
    return out


def _chosen(data, offsets, channel, chosen, wanted):
    """(text, feature number, occurrences) of the chosen features."""
    doc, h, n = features(data, offsets, channel, wanted)
    f = np.searchsorted(chosen, h)
    some = np.zeros(len(h), dtype=bool)
    inside = f < len(chosen)
    some[inside] = chosen[f[inside]] == h[inside]
    return doc[some], f[some], n[some]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with an L2 penalty on the weights."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        eligible: Column | None = None, rows: int = LABELLED_ROWS) -> Scorer:
    """Character model over all texts; features and weights from at most
    ``rows`` eligible labelled texts."""
    spark = docs.sparkSession
    prepare(spark)
    costs = gram_costs(gram_counts(docs, text))
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if eligible is not None:
        marked = marked.filter(eligible)
    marked = marked.groupBy(F.col(doc_id).cast("long").alias("_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_y"))
    # at most ``rows`` ids: the texts stay where they are, only those chosen move
    marked = F.broadcast(marked.orderBy(F.xxhash64("_id", F.lit(29)), "_id").limit(rows))
    labelled = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).join(marked, "_id")
    labelled = materialise(labelled.groupBy("_id", "_y").agg(F.min("_t").alias("_t")), "labelled")
    size = {r["_y"]: r["n"] for r in labelled.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    all1, all0 = float(size.get(1, 0)), float(size.get(0, 0))
    if all1 + all0 == 0:
        return Scorer(costs, np.zeros(0, np.uint64), np.zeros(0), 0.0)
    shared = spark.sparkContext.broadcast(costs)

    def slots(batches):  # documents of label 1 per slot
        channel, total = Channel(shared.value), np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            doc, h, _ = features(*buffers(b.column(2)), channel)
            cell = np.unique(doc * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64))
            total += np.bincount(cell % SLOTS, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    often = labelled.filter("_y = 1").mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")) \
        .filter(F.col("n") >= MIN_TOXIC).select("slot").toArrow()  # at most SLOTS rows
    wanted = np.zeros(SLOTS, dtype=bool)
    wanted[often.column("slot").to_numpy()] = True
    known = spark.sparkContext.broadcast(np.packbits(wanted))

    def tally(batches):  # documents per feature and label, for the slots that can matter
        channel, want = Channel(shared.value), np.unpackbits(known.value).astype(bool)
        for b in batches:
            y = b.column(1).to_numpy()
            doc, h, _ = features(*buffers(b.column(2)), channel, want)
            key, place = np.unique(h, return_inverse=True)
            n1 = np.bincount(place, weights=y[doc], minlength=len(key)).astype(np.int64)
            n = np.bincount(place, minlength=len(key))
            yield pa.RecordBatch.from_arrays([_long(key), pa.array(n1), pa.array(n - n1)], names=["f", "n1", "n0"])

    counted = labelled.mapInArrow(tally, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share = F.lit(all1 / (all1 + all0))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    part0 = F.when(n0 > 0, n0 * F.log(n0 / ((n1 + n0) * (1 - share)))).otherwise(0.0)
    best = counted.filter((n1 >= MIN_TOXIC) & (n1 > (n1 + n0) * share)) \
        .withColumn("g", 2 * (n1 * F.log(n1 / ((n1 + n0) * share)) + part0)).filter(F.col("g") >= MIN_GAIN) \
        .orderBy(F.desc("g"), "f").limit(FEATURES).toArrow() if all0 else None
    chosen = np.zeros(0, np.uint64) if best is None else np.sort(best.column("f").to_numpy().view(np.uint64))

    told = spark.sparkContext.broadcast(chosen)

    def collect(batches):
        channel, mark = Channel(shared.value), _marked(told.value)
        for b in batches:
            doc, f, n = _chosen(*buffers(b.column(2)), channel, told.value, mark)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(cut), pa.array(f.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(n.astype(np.int32)))], names=["_id", "_y", "f", "n"])

    table = labelled.mapInArrow(collect, "_id long, _y int, f array<int>, n array<int>") \
        .orderBy("_id").toPandas()
    x = np.zeros((len(table), len(chosen)))
    for i, (f, n) in enumerate(zip(table["f"], table["n"])):
        x[i, f] = 1.0 + np.log(n)
    weights, bias = logistic(x, table["_y"].to_numpy(dtype=float))
    return Scorer(costs, chosen, weights, bias)


def score(docs: DataFrame, scorer: Scorer, *, text: str = "text", keep: list[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``score`` (0..1) and ``predicted`` of every whole text.  A result
    column takes the place of a ``keep`` column of its name."""
    keep = carried(keep, "score", "predicted")
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(scorer)
    kept = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_t"))
    schema = T.StructType(list(kept.schema.fields[:-1]) + [
        T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())])

    def run(batches):
        model = shared.value
        channel = Channel(model.costs)
        for b in batches:
            out = model.scores(*buffers(b.column(b.num_columns - 1)), channel)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                                             names=[f.name for f in schema.fields])

    found = kept.mapInArrow(run, schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_score").alias("score"),
                        F.col("_predicted").alias("predicted"))
