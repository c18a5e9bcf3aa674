"""Source divergence, toxicity and tokenizer alignment."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from netwarden.llm import alignment, divergence, toxicity

ROW = "doc_id long, text string, lang string, source string"


# --- source divergence --------------------------------------------------------------------

def _audit(rows, min_docs, top):
    """Brute force of the audit."""
    docs = [((l or ""), (s or ""), re.findall("[A-Za-z\u0080-\U0010ffff]+", t or "")) for _, t, l, s in rows]
    docs = [(l, s, [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in ws]) for l, s, ws in docs]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for l, s, ws in docs:
        df[l].update(set(ws))
        n[l, s].update(ws)
    out = []
    for lang in {l for l, _, _ in docs}:
        kept = [w for w, k in df[lang].items() if k >= min_docs]
        sources = sorted({s for l, s, _ in docs if l == lang})

        def share(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (count[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if n[lang, s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(terms[:top])]
    return sorted(out)


def _rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_audit_equals_brute_force(spark):
    r = random.Random(5)
    words = ["Alpha", "alpha", "be", "été", "ÉTÉ", "straße", "longwordofmorethaneightbytes", "longwordofmorethaneightbytez", "eightlet",
             "eightlets", "x", "国語", "K"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", None, "ä"]))
            for i in range(200)]
    rows += [(1, None, "xx", "a"), (1, "", "xx", "b"), (1, "12 34", "yy", "only"), (2, "zz zz", "xx", "a"), (2, "zz zz", "xx", "a")]
    df = spark.createDataFrame(rows, ROW).repartition(3).withColumn("term", F.lit(1)).withColumn("value", F.lit("x"))
    for block_rows in (7, 200_000):
        assert _rows(divergence.audit(df, min_docs=5, top=3, block_rows=block_rows)) == _audit(rows, 5, 3)


def test_audit_of_long_texts_in_pieces_and_of_nothing(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" * (1 + i % 4) for i in range(300)]
    rows = [(i, " ".join(r.choices(words, k=k)), "en", "ab"[i % 2]) for i, k in enumerate([20_000, 3, 9_000, 1, 0, 500])]
    data = np.frombuffer("\n".join(t for _, t, _, _ in rows).encode(), dtype=np.uint8)
    monkeypatch.setattr(divergence, "SHARD_BYTES", 1 << 12)
    whole = divergence._long(data, np.array([7]))
    want = Counter(w for _, t, _, _ in rows for w in re.findall("[a-z]+", t))
    assert dict(zip(whole[1].to_pylist(), whole[2].tolist())) == want and set(whole[3].tolist()) == {1} and set(whole[0].tolist()) == {7}
    monkeypatch.undo()
    assert _rows(divergence.audit(spark.createDataFrame(rows, ROW), min_docs=2)) == _audit(rows, 2, 50)
    assert _rows(divergence.audit(spark.createDataFrame([], ROW))) == []


def test_pointer_sort_orders_by_bytes():
    r = random.Random(7)
    words = ["".join(r.choices("ab", k=r.randint(1, 30))) for _ in range(400)] + ["a" * 40] * 3
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8).copy()
    data[data == 32] = 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    order, new = divergence.sort_pointers(data, starts, ends)
    assert [words[i] for i in order] == sorted(words) and int(new.sum()) == len(set(words))


# --- toxicity -------------------------------------------------------------------------------

def _corpus(n=600, seed=3):
    r = random.Random(seed)
    calm = "the river runs past an old mill and people walk there in summer when it is warm".split()
    bad = ["moron", "stupid", "worthless"]
    rows, labels = [], []
    for i in range(n):
        ws = r.choices(calm, k=r.randint(5, 25))
        y = int(i % 4 == 0)
        if y:
            ws[r.randrange(len(ws))] = r.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, y))
    return rows, labels


def test_toxicity_restores_and_scores(spark):
    rows, labels = _corpus()
    odd = [(1001, None), (1002, ""), (1003, "you m0r0n walk"), (1004, "s t u p i d mill"), (1005, "so stuuupid!!"), (1006, "w.o.r.t.h.l.e.s.s"),
           (1007, "the old mill 2 b 4 ..."), (1008, "the river " * 50_000 + "$tup1d"), (1009, "a" * 30_000 + "1" * 9000), (1003, "you m0r0n walk"),
           (None, "m0ron"), (1010, "x y z"), (1011, "a b"), (1012, "c d")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("s")).repartition(3)
    marks = spark.createDataFrame(labels + [(0, None), (5, 0), (None, 1)], "doc_id long, toxic int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scorer = toxicity.fit(docs, marks, eligible=~held)
    got = toxicity.score(docs.withColumn("predicted", F.lit(9)), scorer, keep=["doc_id"]).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.predicted)
    assert all(by[i] == [y] for i, y in labels)
    assert {i: by[i] for i in range(1001, 1010)} == {1001: [0], 1002: [0], 1003: [1, 1], 1004: [1], 1005: [1], 1006: [1], 1007: [0], 1008: [1], 1009: [0]}
    assert by[None] == [1]


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a moron")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.score(docs, scorer, keep=["doc_id"]).collect()] == [0.5]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.fit(empty, none), keep=["doc_id"]).collect() == []


def _grams(texts):
    """Four-grams of letter classes, one text and letter at a time."""
    out = Counter()
    for t in texts:
        ctx = [0, 0, 0]
        for b in [*t.encode(), 32]:
            c = int(toxicity._CLASS[b])
            if c or ctx[2]:
                out[((ctx[0] * 32 + ctx[1]) * 32 + ctx[2]) * 32 + c] += 1
            ctx = [ctx[1], ctx[2], c] if c else [0, 0, 0]
    return out


def test_character_model_counts_every_text(spark):
    texts = ["the old mill", "", "Été ist schön, 12 a", "x", "endsword", "nextword " * 3]
    got = toxicity.gram_counts(spark.createDataFrame([(t,) for t in texts + [None]], "text string"))
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == _grams(texts)


def _cheapest(unit, cost):
    """Every reading of a small unit with its cost, tried one by one."""
    best = {}

    def walk(i, ctx, value, text):
        if i == len(unit):
            value += cost[ctx * 32] if ctx % 32 else 0.0
            if value < best.get(text, 1e9):
                best[text] = value
            return
        ch, c = unit[i], int(toxicity._CLASS[ord(unit[i])])
        solid = [bool(toxicity._CLASS[ord(x)]) or x in toxicity.LOOKALIKES for x in unit]
        left, right = i > 0 and solid[i - 1], i + 1 < len(unit) and solid[i + 1]
        step = lambda k: value + cost[ctx * 32 + k]
        if c:
            walk(i + 1, ctx % 1024 * 32 + c, step(c), text + ch)
            end = i
            while end < len(unit) and unit[end] == ch:
                end += 1
            if end > i + 1:
                walk(end, ctx % 1024 * 32 + c, step(c) + (toxicity.REPEAT if end > i + 2 else toxicity.DOUBLE), text + ch)
            return
        for x in toxicity.LOOKALIKES.get(ch, ""):
            walk(i + 1, ctx % 1024 * 32 + ord(x) - 96, step(ord(x) - 96) + toxicity.LOOKALIKE, text + x)
        edge = step(0) if ctx % 32 else value
        if ch in toxicity.LOOKALIKES:
            edge += toxicity.LITERAL if left and right else toxicity.LITERAL_EDGE if left or right else 0
        elif left and right:
            walk(i + 1, ctx, value + toxicity.JOIN, text)
            edge += toxicity.APART
        walk(i + 1, 0, edge, text + " ")

    walk(0, 0, 0.0, "")
    return min(best.values()), best


def test_search_finds_the_cheapest_reading():
    rows, _ = _corpus(200)
    counts = np.zeros(32 ** 4, dtype=np.int64)
    for k, n in _grams([t for _, t in rows]).items():
        counts[k] = n
    cost = toxicity.gram_costs(counts).tolist()
    for unit in ["m0r0n", "m 0 r o n", "w0rth1e$s", "stuu4pid", "1.d.1", "aaab", "4+4", "o l d", "th3_m1ll"]:
        low, readings = _cheapest(unit, cost)
        assert abs(readings[toxicity.restore(unit.encode(), cost).decode()] - low) < 1e-9


# --- alignment --------------------------------------------------------------------------------

def _aligned(rows):
    """Brute force on whole texts."""
    pair = alignment.pair_of(alignment.read_files(alignment.A_FILE, alignment.B_FILE))
    out, count = [], Counter()
    for i, t in rows:
        links, groups, a, b = [], [], [], []
        if t:
            full = (" " + t).encode()
            a = pair.a.encode(" " + t, add_special_tokens=False).ids
            b = pair.b.encode(t)
            if b"".join(pair.a_bytes[k] for k in a) != full or b"".join(pair.b_bytes[k] for k in b) != full:
                a, b = [], []
        ends_a = np.cumsum([len(pair.a_bytes[k]) for k in a]).tolist()
        ends_b = np.cumsum([len(pair.b_bytes[k]) for k in b]).tolist()
        x = y = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[x:i2])) + "|" + ",".join(map(str, b[y:j2])))
            links.append((a[i2 - 1], b[j2 - 1]))
            x, y = i2, j2
        count.update(links)
        out.append((i, len(a), len(b), groups, links))
    best = Counter()
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    return sorted(((i if i is not None else -1), na, nb, len(g), len(li), sum(count[x] == best[x[1]] for x in li), sum(count[x] for x in li),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, na, nb, g, li in out)


TEXTS = ["the cat sat", None, "", " ", "  two  spaces ", "tabs\t\tand\n\n new  lines \n x", "nb sp   em", "wide ▁ mark", "a▁b",
         "<|endoftext|> <s> </s> <unk>", "naïve café 国語 🙂🙂", "x" * 3000, "supercalifragilistic " * 40, "don't we'll 12345 1,000.5", "\x00\x1c a \x1f b",
         "é ﬁ", "trailing  ", "\n", "the cat sat", " leading", "the \u0085 y"]


def test_alignment_equals_brute_force(spark, monkeypatch):
    r = random.Random(8)
    alphabet = ["the", "cat", " ", "  ", "\n", "é", "▁", "1", "Zyx", "'s", "\t", "国", "-", ".", " ", "ing"]
    rows = list(enumerate(TEXTS)) + [(i + 100, "".join(r.choices(alphabet[:6] + alphabet[7:], k=r.randint(1, 60)))) for i in range(150)]
    rows += [(None, "the cat"), (100, "the cat sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("u")).withColumn("pair", F.lit(1)).repartition(3)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted(tuple(-1 if x[c] is None else x[c] for c in names) for x in alignment.align(df).collect())
    assert got == _aligned(rows)
    # slices and a full cache change nothing
    pair = alignment.pair_of(alignment.read_files(alignment.A_FILE, alignment.B_FILE))
    texts = [t for _, t in rows]
    whole = alignment.align_texts(pair, texts)
    monkeypatch.setattr(alignment, "SLICE", 5)
    monkeypatch.setattr(alignment, "CACHED_CHUNKS", 4)
    again = alignment.align_texts(pair, texts)
    assert (whole[0] == again[0]).all() and whole[1] == again[1] and all((x == y).all() for x, y in zip(whole[2], again[2]))


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, 0, 0, 0, "")]
