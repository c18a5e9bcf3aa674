"""Word hashing, chosen-path join, components and decontamination against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from netwarden.llm import chosen_path, decontam, graph, textops

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n=5):
    w = WORD.findall(fold(t))
    if len(w) >= n:
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def test_words_match_the_pattern_at_any_block_size(monkeypatch):
    texts = ["Über the  Fox-2, é", None, "", "x" * 300, "a b", "!!", "end", " ", "tail word "]
    data, offsets = textops.buffers(pa.array(texts))
    want = [WORD.findall(fold(t)) for t in texts]
    seen = []
    for size in (1 << 20, 7, 50):
        monkeypatch.setattr(textops, "BLOCK", size)
        parts = []
        for a, b in textops.blocks(data, textops._IS_WORD, offsets, size):
            s, e = textops.runs(data, textops._IS_WORD, offsets, a, b)
            parts += [(x + a, y + a) for x, y in zip(s, e)]
        got = [[fold(bytes(data[s:e]).decode()) for s, e in parts if offsets[i] <= s < offsets[i + 1]] for i in range(len(texts))]
        assert got == want
        seen.append(parts)
    assert seen[0] == seen[1] == seen[2]


def test_word_hashes_agree_with_equality():
    texts = ["The the THE fox", "fox the", "thefox"]
    data, offsets = textops.buffers(pa.array(texts))
    _, _, h, bounds = textops.words(data, offsets)
    assert len({int(x) for x in h[:3]}) == 1 and h[0] == h[5] and h[3] == h[4]
    assert len(set(h.tolist())) == 3 and bounds.tolist() == [0, 4, 6, 7]


def _texts(seed=3, base=24, copies=6):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(base):
        words = [r.choice(vocab) for _ in range(r.choice([4, 12, 40, 120]))]
        out.append(" ".join(words))
        for _ in range(r.randrange(copies)):
            w = list(words)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    out += [out[0], out[1], out[1], "", None, "!!! ...", "one two"]
    r.shuffle(out)
    return out


def _brute(rows, s=0.8):
    sets = [shingles(t) for _, t in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(n), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= s * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    key = lambda d: (d is None, d)
    return sorted(((rows[i][0], min(low[find(i)], key=key), links[i]) for i in range(n)), key=str)


@pytest.mark.parametrize("bucket,block,levels", [(8192, 1024, 3), (2, 3, 3), (3, 2, 1)])
def test_classes_equal_brute_force(spark, monkeypatch, bucket, block, levels):
    monkeypatch.setattr(chosen_path, "ALIKE", 0.0 if levels == 3 else 3.0)
    rows = list(enumerate(_texts()))
    df = spark.createDataFrame(rows, DOC).withColumnRenamed("text", "text")
    out = chosen_path.similarity_classes(df, bucket=bucket, block=block, levels=levels, recall=1 - 1e-9).collect()
    assert sorted(((r.doc_id, r.group_id, r.n_links) for r in out), key=str) == _brute(rows)


def test_classes_null_ids_repeated_rows_and_extra_columns(spark):
    t = " ".join(f"k{i}" for i in range(30))
    rows = [(1, t, 7), (1, t, 8), (None, t, 9), (5, None, 1), (6, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").withColumn("key", df_lit("x"))
    out = {(r.doc_id, r.group_id, r.n_links) for r in chosen_path.similarity_classes(df).collect()}
    assert out == {(1, 1, 2), (None, 1, 2), (5, 5, 0), (6, 6, 0)}
    kept = chosen_path.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6]


def df_lit(v):
    from pyspark.sql import functions as F
    return F.lit(v)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert chosen_path.similarity_classes(none).count() == 0
    assert chosen_path.deduplicate(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f")], DOC)
    assert decontam.contained_items(some, items).count() == 0
    assert decontam.decontaminate(some, items).count() == 1


def test_a_long_text_joins_its_copy(spark):
    r = random.Random(1)
    long = " ".join(f"v{r.randrange(50000)}" for _ in range(60000))
    rows = [(1, long), (2, long + " tail"), (3, "short text of five words here")]
    out = {r.doc_id: (r.group_id, r.n_links) for r in chosen_path.similarity_classes(spark.createDataFrame(rows, DOC)).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(7, 7), (500, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 130)}}


def test_containment_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"b{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 5, 6, 20, 45, 90, 150])] + [(90, None), (91, "")]
    docs = []
    for d in range(40):
        w = [r.choice(vocab) for _ in range(r.choice([10, 300]))]
        _, t = items[r.randrange(7)]
        part = t.split()
        for _ in range(r.randrange(3)):
            part[r.randrange(len(part))] = "zz"
        at = r.randrange(len(w))
        docs.append((d, " ".join(w[:at] + part + w[at:])))
    docs += [(100, None), (101, ""), (None, items[4][1].upper()), (3, docs[3][1])]

    def of(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    want = set()
    for d, t in docs:
        for i, x in items:
            s = of(x)
            if s and len(s & of(t)) >= 0.8 * len(s) - 1e-9:
                want.add((d, i, len(s & of(t)), len(s)))
    got = decontam.contained_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id, x.n_common, x.n_item) for x in got.collect()} == want and want
    left = decontam.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, *_ in want}
    assert sorted(map(str, (x.doc_id for x in left.collect()))) == sorted(str(d) for d, _ in docs if d not in bad)


def test_items_of_few_words(spark):
    docs = spark.createDataFrame([(1, "we saw the Old tower, there"), (2, "old, TOWER"), (3, "tower old"), (4, None), (5, "a b c d e f")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "Old tower"), (2, "tower"), (3, ""), (4, None), (5, "b c d"), (6, "b c d e f"), (7, "a b c e")],
                                  "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_common, r.n_item) for r in decontam.contained_items(docs, items, short=True).collect())
    assert got == [(1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1), (3, 2, 1, 1), (5, 5, 1, 1), (5, 6, 1, 1)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items.filter("item_id = 1"), short=True).collect()) == [3, 4, 5]


def test_signature_thresholds():
    assert [decontam.least_hits(n) for n in (1, 2, 5, 10, 32)] == [1, 2, 4, 8, 26]
    assert 1 <= decontam.least_hits(33) < 26


def test_jaccard_bound_is_inclusive():
    a = np.arange(9, dtype=np.uint64)
    b = np.arange(8, dtype=np.uint64)  # 8 of 9: 0.888..
    c = np.concatenate([a[:8], np.arange(100, 101, dtype=np.uint64)])  # 8 of 10: exactly 0.8
    ids, block, leaves = np.array([1, 2, 3]), np.zeros(3, int), [[7]] * 3
    n, root = chosen_path.compare_bucket(7, 0, 0, ids, block, np.array([1, 1, 5]), [a, b, c], leaves, 0.8)
    assert n.tolist() == [6, 6, 2] and set(root) == {1}
    parity = np.array([np.frombuffer(chosen_path._parity(t), np.uint64) for t in (a, b, c)])
    assert chosen_path.plausible(7, 0, 0, ids, block, np.array([9.0, 8.0, 9.0]), parity, leaves, 0.8).all()
    # a pair that met in a smaller bucket is not counted again
    n, root = chosen_path.compare_bucket(7, 0, 0, ids, block, np.array([1, 1, 5]), [a, b, c], [[3, 7], [3, 7], [7]], 0.8)
    assert n.tolist() == [5, 5, 2] and set(root) == {1}


def test_short_items_equal_the_sql(spark):
    import duckdb
    from netwarden.llm.oracles import ORACLES
    docs = [(1, "alpha beta gamma delta"), (2, "x Alpha, beta"), (3, "beta alpha"), (4, ""), (5, None), (6, "alpha beta gamma delta epsilon zeta eta"),
            (7, "alpha alpha"), (6, "omega")]
    items = [(1, "alpha"), (2, "alpha beta"), (3, "beta gamma delta"), (4, "alpha beta gamma delta"), (5, "alpha beta gamma delta epsilon"),
             (6, ""), (7, None), (8, "beta gamma delta epsilon zeta eta"), (9, "omega")]
    con = duckdb.connect()
    for name, cols, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({cols} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, item_id, n_common, n_item, containment FROM ({ORACLES['op3_containment']}) z ORDER BY ALL").fetchall()
    got = decontam.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                                   short=True).select("doc_id", "item_id", "n_common", "n_item", "containment").collect()
    assert len(want) > 10 and sorted(tuple(r) for r in got) == want
