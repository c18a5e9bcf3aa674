"""Token counts by a linear longest-match automaton.

Texts are cut at ASCII white space; every word, with the word-start mark in
front, is cut greedily into the longest vocabulary pieces.  The vocabulary is
a byte trie; every single byte is a piece too, so a character without a piece
costs one token per byte (byte fallback).  Every trie node has a failure link
(where matching goes on once the node's text is cut into pieces) and the count of
pieces popped on the way.  Following the links beforehand for every (node,
byte) gives a table of next nodes and popped counts, so a text costs one step
per byte and no piece is ever built.

The vocabulary is a public tokenizer's file; only its list of pieces is sent
to the executors (its size is that of the file), which build the table once
per worker.

Defined cases: null and empty texts have no words and no tokens; a word of any
length is matched whole; repeated rows each get their counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.llm.common import carried, prepare
from netwarden.llm.textops import blocks, buffers, runs

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_TABLES: dict = {}


def vocabulary(path: str = DEFAULT_VOCABULARY) -> list[str]:
    """Pieces of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Automaton:
    """next[node, byte], popped[node, byte] and closing[node] (pieces left at a word's end)."""

    def __init__(self, pieces: list[str]):
        words = {p.encode("utf-8") for p in pieces if p} | {bytes([b]) for b in range(256)}
        child: dict[tuple[int, int], int] = {}
        level, final, order = [0], [False], [[]]
        for w in sorted(words):
            node = 0
            for d, b in enumerate(w):
                to = child.get((node, b))
                if to is None:
                    to = child[(node, b)] = len(level)
                    level.append(d + 1)
                    final.append(False)
                    while len(order) <= d + 1:
                        order.append([])
                    order[d + 1].append((to, node, b))
                node = to
            final[node] = True
        n = len(level)
        nxt = np.full((n, 256), -1, dtype=np.int32)
        for (node, b), to in child.items():
            nxt[node, b] = to
        popped = np.zeros((n, 256), dtype=np.uint16)
        fail, count = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.uint16)
        # the root has every byte as a child; deeper nodes by level, links first
        for rows in order[1:]:
            for to, parent, b in rows:
                if final[to]:
                    fail[to], count[to] = 0, 1
                else:  # cut the parent's text, then go on with this byte
                    z = fail[parent]
                    fail[to], count[to] = nxt[z, b], count[parent] + popped[z, b]
            nodes = np.array([r[0] for r in rows], dtype=np.int64)
            gap = nxt[nodes] < 0
            via = fail[nodes]
            popped[nodes] = np.where(gap, popped[via] + count[nodes][:, None], 0)
            nxt[nodes] = np.where(gap, nxt[via], nxt[nodes])
        # at a word's end pieces pop until the root
        closing = np.zeros(n, dtype=np.int64)
        for rows in order[1:]:
            nodes = np.array([r[0] for r in rows], dtype=np.int64)
            closing[nodes] = count[nodes] + closing[fail[nodes]]
        self.next, self.popped, self.closing = nxt, popped, closing

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
        """Pieces of each word data[starts:ends], all words advancing together."""
        out = np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the active ones are a prefix
        s, size = starts[order], (ends - starts)[order]
        state = np.full(len(s), start, dtype=np.int64)
        total = np.zeros(len(s), dtype=np.int64)
        active = len(s)
        step = 0
        nxt, popped = self.next.ravel(), self.popped.ravel()
        while active:
            active = int(np.searchsorted(-size, -step, side="left"))  # sizes > step
            if active <= 2:  # the rest of a few very long words
                break
            at = state[:active] * 256 + data[s[:active] + step]
            total[:active] += popped[at]
            state[:active] = nxt[at]
            step += 1
        for i in range(active):
            v, t = int(state[i]), 0
            for b in data[s[i] + step:s[i] + size[i]].tolist():
                at = v * 256 + b
                t += int(popped[at])
                v = int(nxt[at])
            state[i], total[i] = v, total[i] + t
        out[order] = total + self.closing[state]
        return out


def _table(pieces: list[str]) -> Automaton:
    key = hash(tuple(pieces))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Automaton(pieces)
    return _TABLES[key]


def token_counts(docs: DataFrame, *, text: str = "text", keep: list[str] = (), pieces: list[str] | None = None,
                 word_start: str = WORD_START) -> DataFrame:
    """``keep`` columns, ``n_words`` and ``n_tokens`` of every whole text.  A result
    column takes the place of a ``keep`` column of its name."""
    keep = carried(keep, "n_words", "n_tokens")
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabulary() if pieces is None else pieces)
    mark = word_start.encode("utf-8")
    schema = T.StructType(list(docs.select(*keep).schema.fields) + [
        T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        auto = _table(shared.value)
        start, first = 0, 0  # state and pieces after the word-start mark
        for b in mark:
            first += int(auto.popped[start, b])
            start = int(auto.next[start, b])
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            n = batch.num_rows
            n_words, n_tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b in blocks(data, _IS_WORD, offsets):
                s, e = runs(data, _IS_WORD, offsets, a, b)
                if not len(s):
                    continue
                doc = np.searchsorted(offsets, s + a, side="right") - 1
                n_words += np.bincount(doc, minlength=n)
                n_tokens += np.bincount(doc, weights=auto.lengths(data, s + a, e + a, start) + first, minlength=n).astype(np.int64)
            cols = [batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(n_words), pa.array(n_tokens)], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).alias("_llm_text")).mapInArrow(run, schema)
