"""Registered queries: feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.operators import dictionary as DC
from netwarden.operators import features as FT
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.registry import register

R = 6


def _long(df, col, name="value", rnd=True):
    out = df.select("row_id", F.posexplode(col).alias("pos", name))
    return out.withColumn(name, F.round(name, R)) if rnd else out


EXPL = """e AS (SELECT row_id, y, family, split, CAST(generate_subscripts(features, 1) - 1 AS INT) AS pos,
                unnest(features) AS v FROM vectors)"""


def vsql(body: str) -> str:
    return sql("WITH " + EXPL + ",\n" + body, "vectors")


@register("minmax_scale", vsql("""
s AS (SELECT pos, min(v) AS mn, max(v) AS mx FROM e WHERE split = 'train' GROUP BY pos)
SELECT row_id, pos, CASE WHEN mx - mn = 0 THEN 0.0 ELSE (v - mn) / (mx - mn) END AS value
FROM e JOIN s USING (pos)"""))
def minmax_scale(spark, sf_dir):
    """Min-max fitted on the train split, applied to all rows."""
    v = views.vectors(spark, sf_dir)
    st = FT.fit_stats(v.where(F.col("split") == "train"))
    return _long(v.select("row_id", FT.minmax_transform(F.col("features"), st).alias("f")), "f", rnd=False)


@register("standard_scale", vsql("""
s AS (SELECT pos, avg(v) AS mu, stddev_pop(v) AS sd FROM e WHERE split = 'train' GROUP BY pos)
SELECT row_id, pos, round(CASE WHEN sd = 0 THEN 0.0 ELSE (v - mu) / sd END, 6) AS value
FROM e JOIN s USING (pos)"""))
def standard_scale(spark, sf_dir):
    """(x - mean) / population std, fitted on train."""
    v = views.vectors(spark, sf_dir)
    st = FT.fit_stats(v.where(F.col("split") == "train"))
    return _long(v.select("row_id", FT.standard_transform(F.col("features"), st).alias("f")), "f")


ANOVA_SQL = """
c AS (SELECT pos, y, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM e WHERE split = 'train' GROUP BY pos, y),
g AS (SELECT pos, sum(n) AS nn, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum(n * var) AS ssw FROM c GROUP BY pos),
f AS (SELECT g.pos, CASE WHEN g.ssw / (g.nn - g.k) = 0 THEN NULL ELSE
        (sum(c.n * (c.mean - g.grand) * (c.mean - g.grand)) / (g.k - 1)) / (g.ssw / (g.nn - g.k)) END AS f_score
      FROM g JOIN c ON g.pos = c.pos GROUP BY g.pos, g.nn, g.k, g.ssw)"""


@register("anova_f_scores", vsql(ANOVA_SQL + "\nSELECT pos, round(f_score, 4) AS f_score FROM f"))
def anova_f_scores(spark, sf_dir):
    """One-way F statistic per feature vs class (train rows)."""
    v = views.vectors(spark, sf_dir).where(F.col("split") == "train")
    return FT.anova_f_scores(v).withColumn("f_score", F.round("f_score", 4))


@register("select_k_best", vsql(ANOVA_SQL + "\nSELECT pos FROM f ORDER BY f_score DESC NULLS LAST, pos LIMIT 10"))
def select_k_best(spark, sf_dir):
    """The 10 best positions by F (reported in original order)."""
    v = views.vectors(spark, sf_dir).where(F.col("split") == "train")
    return FT.anova_f_scores(v).orderBy(F.col("f_score").desc_nulls_last(), "pos").limit(10).select("pos")


@register("selected_features", vsql(ANOVA_SQL + """,
k AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS new_pos FROM
      (SELECT pos FROM f ORDER BY f_score DESC NULLS LAST, pos LIMIT 10) t)
SELECT e.row_id, CAST(k.new_pos AS INT) AS pos, e.v AS value FROM e JOIN k ON e.pos = k.pos"""))
def selected_features(spark, sf_dir):
    """J04 applied: keep the 10 selected positions, original order."""
    v = views.vectors(spark, sf_dir)
    keep = FT.select_k_best(v.where(F.col("split") == "train"), 10)
    return _long(v.select("row_id", FT.select_positions(F.col("features"), keep).alias("f")), "f", rnd=False)


@register("signed_scale", vsql("""
s AS (SELECT pos, min(v) AS mn, max(v) AS mx FROM e WHERE y = 1 GROUP BY pos)
SELECT row_id, pos, round((v - mn) / (mx - mn + 1e-8) * 2 - 1, 6) AS scaled,
       round(((v - mn) / (mx - mn + 1e-8) * 2 - 1 + 1) / 2 * (mx - mn + 1e-8) + mn, 6) AS restored
FROM e JOIN s USING (pos)"""))
def signed_scale(spark, sf_dir):
    """Scale to [-1, 1] (fit on malicious rows) and back."""
    v = views.vectors(spark, sf_dir)
    st = FT.fit_stats(v.where(F.col("y") == 1))
    s = v.select("row_id", FT.signed_scale(F.col("features"), st).alias("s"))
    r = s.select("row_id", "s", FT.signed_unscale(F.col("s"), st).alias("r"))
    z = r.select("row_id", F.posexplode(F.arrays_zip("s", "r")).alias("pos", "z"))
    return z.select("row_id", "pos", F.round("z.s", R).alias("scaled"), F.round("z.r", R).alias("restored"))


@register("mask_features", vsql(f"""
m AS (SELECT row_id, pos, v, CASE WHEN substr(md5(concat('42|', CAST(row_id AS VARCHAR), '|', CAST(pos AS VARCHAR))), 1, 8)
                                  < '{format(int(0.5 * 16 ** 8), "08x")}' THEN CAST(1.0 AS DOUBLE)
                               ELSE CAST(0.0 AS DOUBLE) END AS kept FROM e)
SELECT row_id, pos, v * kept AS value, kept FROM m"""))
def mask_features(spark, sf_dir):
    """Seeded random half of each row's features hidden, mask returned."""
    v = views.vectors(spark, sf_dir)
    masked, mask = FT.mask_features(F.col("features"), F.col("row_id"), 0.5, 42)
    z = v.select("row_id", F.posexplode(F.arrays_zip(masked.alias("m"), mask.alias("k"))).alias("pos", "z"))
    return z.select("row_id", "pos", F.col("z.m").alias("value"), F.col("z.k").alias("kept"))


@register("category_vocab", sql("""
SELECT 'lang' AS col, lang AS value, CAST(row_number() OVER (ORDER BY lang) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) a
UNION ALL
SELECT 'source', source, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT)
FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) b"""))
def category_vocab(spark, sf_dir):
    """Sorted distinct values per categorical column, with index."""
    from netwarden.operators.prefix import global_position
    from netwarden.sources.tables import read_table
    d = read_table(spark, sf_dir, "documents", ["lang", "source"])
    out = None
    for c in ("lang", "source"):
        vals = d.where(F.col(c).isNotNull()).select(F.col(c).alias("value")).distinct()
        part = global_position(vals, [F.col("value")], "idx").select(F.lit(c).alias("col"), "value", "idx")
        out = part if out is None else out.unionByName(part)
    return out


@register("one_hot_fixed_vocab", sql("""
WITH v AS (SELECT DISTINCT d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang IS NOT NULL)
SELECT d.doc_id, v.lang AS category, coalesce(CAST(d.lang = v.lang AS INT), 0) AS value
FROM documents d, v"""))
def one_hot_fixed_vocab(spark, sf_dir):
    """One-hot of lang over the vocabulary fitted on labelled documents;
    unseen or null -> zeros (long form: one row per document x vocab entry)."""
    from netwarden.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id"])
    vocab = FT.category_vocab(docs.join(lab, "doc_id", "left_semi"), "lang")
    cols = FT.one_hot("lang", vocab)
    arr = F.array(*[F.struct(F.lit(v).alias("category"), c.alias("value")) for v, c in zip(vocab, cols)])
    return docs.select("doc_id", F.explode(arr).alias("o")).select("doc_id", "o.*")


@register("label_encode", sql("""
SELECT flow_id, Attack, CAST(dense_rank() OVER (ORDER BY Attack) - 1 AS INT) AS idx FROM flows""", "flows"))
def label_encode(spark, sf_dir):
    """J07 + J08: class -> sorted index and back (round trip checked)."""
    fl = views.flows(spark, sf_dir)
    vocab = FT.category_vocab(fl, "Attack")
    enc = fl.select("flow_id", FT.label_encode("Attack", vocab).alias("idx"))
    dec = enc.select("flow_id", FT.label_decode("idx", vocab).alias("Attack"), F.col("idx").cast("int"))
    return dec.select("flow_id", "Attack", "idx")


WORDS_SQL = """
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents),
v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx
      FROM (SELECT DISTINCT word FROM w WHERE doc_id IN (SELECT doc_id FROM labels)) d)"""


def _words_of(docs):
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("word"))


def _words(spark, sf_dir):
    from netwarden.sources.tables import read_table
    return _words_of(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def _word_dictionary(spark, sf_dir):
    """The words of the labelled documents (picked before their words are taken apart)."""
    from netwarden.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return DC.fit_dictionary(_words_of(docs.join(read_table(spark, sf_dir, "labels", ["doc_id"]), "doc_id", "left_semi")), "word")


@register("wide_label_encode", sql("WITH " + WORDS_SQL + """
SELECT w.doc_id, count(*) AS n_words, count(*) FILTER (WHERE v.idx IS NULL) AS unseen,
       CAST(coalesce(sum(v.idx), 0) AS BIGINT) AS idx_sum, coalesce(min(v.idx), -1) AS idx_min,
       coalesce(max(v.idx), -1) AS idx_max
FROM w LEFT JOIN v USING (word) GROUP BY w.doc_id"""))
def wide_label_encode(spark, sf_dir):
    """J05, J07 over a wide vocabulary: every word of every document by the
    dictionary of the labelled documents' words, summed up per document (-1: none known)."""
    got = DC.encode(_words(spark, sf_dir), "word", _word_dictionary(spark, sf_dir))
    return got.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.count(F.when(F.col("idx").isNull(), 1)).alias("unseen"),
        F.coalesce(F.sum("idx"), F.lit(0)).alias("idx_sum"), F.coalesce(F.min("idx"), F.lit(-1)).alias("idx_min"),
        F.coalesce(F.max("idx"), F.lit(-1)).alias("idx_max"))


@register("wide_label_decode", sql("WITH " + WORDS_SQL + """
SELECT v.idx, v.word, count(*) AS n FROM w JOIN v USING (word) GROUP BY v.idx, v.word"""))
def wide_label_decode(spark, sf_dir):
    """J08 over a wide vocabulary: occurrences per position, and the position's word."""
    words = _word_dictionary(spark, sf_dir)
    each = _words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    counts = DC.encode(each, "word", words).where(F.col("idx").isNotNull()).groupBy("idx")
    return DC.decode(counts.agg(F.sum("n").alias("n")), "idx", words, "word").select("idx", "word", "n")


@register("wide_one_hot", sql("""
WITH v AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS idx
           FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') d)
SELECT l.l_orderkey, l.l_linenumber, (SELECT count(*) FROM v) AS size, coalesce(v.idx, -1) AS position,
       CAST(v.idx IS NOT NULL AS INT) AS ones
FROM lineitem l LEFT JOIN v USING (l_partkey)"""))
def wide_one_hot(spark, sf_dir):
    """J06 over a wide vocabulary: sparse one-hot of every line's part over the
    parts of returned lines; other parts give no one (position -1)."""
    from netwarden.sources.tables import read_table
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])
    parts = DC.fit_dictionary(lines.where(F.col("l_returnflag") == "R"), "l_partkey")
    got = DC.one_hot_sparse(lines, "l_partkey", parts)
    return got.select("l_orderkey", "l_linenumber", "one_hot.size", F.coalesce(F.get("one_hot.indices", F.lit(0)), F.lit(-1)).alias("position"),
                      F.size("one_hot.indices").alias("ones"))


@register("preprocess_apply", vsql("""
s AS (SELECT pos, min(v) AS mn, max(v) AS mx FROM e WHERE split = 'train' GROUP BY pos),
sc AS (SELECT e.row_id, e.pos, CASE WHEN mx - mn = 0 THEN 0.0 ELSE (v - mn) / (mx - mn) END AS v, e.y, e.split
       FROM e JOIN s USING (pos)),
c AS (SELECT pos, y, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM sc WHERE split = 'train' GROUP BY pos, y),
g AS (SELECT pos, sum(n) AS nn, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum(n * var) AS ssw FROM c GROUP BY pos),
f AS (SELECT g.pos, CASE WHEN g.ssw / (g.nn - g.k) = 0 THEN NULL ELSE
        (sum(c.n * (c.mean - g.grand) * (c.mean - g.grand)) / (g.k - 1)) / (g.ssw / (g.nn - g.k)) END AS f_score
      FROM g JOIN c ON g.pos = c.pos GROUP BY g.pos, g.nn, g.k, g.ssw),
k AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS new_pos FROM
      (SELECT pos FROM f ORDER BY f_score DESC NULLS LAST, pos LIMIT 10) t)
SELECT sc.row_id, CAST(k.new_pos AS INT) AS pos, round(sc.v, 6) AS value FROM sc JOIN k ON sc.pos = k.pos"""))
def preprocess_apply(spark, sf_dir):
    """The fitted scale + select chain applied to raw-width rows
    (selection fitted on the scaled train rows)."""
    v = views.vectors(spark, sf_dir)
    st = FT.fit_stats(v.where(F.col("split") == "train"))
    scaled = v.withColumn("features", FT.minmax_transform(F.col("features"), st))
    keep = FT.select_k_best(scaled.where(F.col("split") == "train"), 10)
    out = FT.preprocess_apply(v, st, keep)
    return _long(out.select("row_id", "features"), "features")


@register("feature_error_rank", vsql("""
s AS (SELECT pos, avg(v) AS mu FROM e WHERE split = 'train' AND y = 0 GROUP BY pos),
m AS (SELECT e.pos, avg((e.v - s.mu) * (e.v - s.mu)) AS mse FROM e JOIN s ON e.pos = s.pos
      WHERE e.split = 'test' GROUP BY e.pos)
SELECT pos, round(mse + 1e-12, 6) AS mse FROM m ORDER BY mse DESC, pos LIMIT 10"""))
def feature_error_rank(spark, sf_dir):
    """per-feature mean squared reconstruction error of the test rows
    against the benign-train mean reconstruction (a rank-0 basis), top 10."""
    v = views.vectors(spark, sf_dir)
    st = FT.fit_stats(v.where((F.col("split") == "train") & (F.col("y") == 0)))
    mu = F.array(*[F.lit(float(x)) for x in st.means])
    out = FT.feature_error_rank(v.where(F.col("split") == "test"), F.transform("features", lambda x, i: F.get(mu, i)))
    return out.select("pos", F.round(F.col("mse") + F.lit(1e-12), R).alias("mse"))
