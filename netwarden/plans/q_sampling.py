"""Registered queries: label statistics, sampling, splitting and tampering
(F01-F03, I01-I06, G08, A08, A16, L01-L08, E02, F35)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.functions import clean as C
from netwarden.operators import sampling as SM
from netwarden.operators import tamper as TM
from netwarden.operators.prefix import global_position, hash_bucket
from netwarden.plans import views
from netwarden.plans.oracle import sql
from netwarden.plans.q_clean import binarize_sql, clean_sql, family_sql
from netwarden.plans.registry import register

TRIGGER_SIZE = 8
TRIGGER_SEED = 42
POSITIONS = TM.trigger_positions_local(64, TRIGGER_SIZE, TRIGGER_SEED)
POS_SQL = ", ".join(str(p) for p in POSITIONS)
POISON_RATE = 0.10
BACKDOOR_RATE_PCT = 10


def md5k(seed, col):
    return f"md5(concat('{seed}|', CAST({col} AS VARCHAR)))"


def _labels(spark, sf_dir) -> DataFrame:
    fl = views.flows(spark, sf_dir)
    return fl.select(F.col("flow_id").alias("row_id"), C.clean_label("Attack").alias("label"))


@register("attack_distribution", sql(f"""
WITH c AS (SELECT {clean_sql('Attack')} AS label, count(*) AS n FROM flows GROUP BY 1),
t AS (SELECT sum(n) FILTER (WHERE label NOT IN ('benign','normal','0')) AS mal FROM c)
SELECT label, n, CAST(label IN ('benign','normal','0') AS INT) AS is_benign,
       CASE WHEN label IN ('benign','normal','0') THEN NULL ELSE round(n * 100.0 / mal, 6) END AS pct_of_malicious
FROM c, t""", "flows"))
def attack_distribution(spark, sf_dir):
    """rows per cleaned label; percent of the malicious total."""
    from netwarden.functions.scalars import attach_scalars
    c = _labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ben = F.col("label").isin(*C.BENIGN_FLAG_TOKENS)
    j = attach_scalars(c, c.agg(F.sum(F.when(~ben, F.col("n"))).alias("_mal")))
    return j.select("label", "n", ben.cast("int").alias("is_benign"),
                    F.when(~ben, F.round(F.col("n") * 100.0 / F.col("_mal"), 6)).alias("pct_of_malicious"))


@register("distinct_labels", sql("SELECT DISTINCT Attack FROM flows ORDER BY Attack", "flows"))
def distinct_labels(spark, sf_dir):
    """distinct attack names, sorted."""
    return views.flows(spark, sf_dir).select("Attack").distinct().orderBy("Attack")


@register("class_counts", sql(f"""
SELECT 'binary' AS kind, CAST({binarize_sql('Label')} AS VARCHAR) AS key, count(*) AS n FROM flows GROUP BY 1, 2
UNION ALL
SELECT 'family', CASE WHEN {family_sql('Attack')} = 'Benign' THEN 'Other' ELSE {family_sql('Attack')} END, count(*)
FROM flows WHERE {binarize_sql('Label')} = 1 GROUP BY 1, 2""", "flows"))
def class_counts(spark, sf_dir):
    """counts per binary class, and per family over attack rows."""
    fl = views.flows(spark, sf_dir)
    yb = C.binarize_label("Label")
    a = fl.groupBy(F.lit("binary").alias("kind"), yb.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    b = fl.where(yb == 1).groupBy(F.lit("family").alias("kind"),
                                  C.family_no_benign(C.attack_family("Attack")).alias("key")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@register("proportional_sample", sql(f"""
WITH l AS (SELECT flow_id AS row_id, {clean_sql('Attack')} AS label FROM flows),
c AS (SELECT label, count(*) AS n FROM l GROUP BY 1),
t AS (SELECT sum(n) FILTER (WHERE label NOT IN ('benign','normal','0')) AS mal FROM c),
q AS (SELECT label, CASE WHEN label IN ('benign','normal','0') THEN least(n, 2000)
                         ELSE least(n, CAST(floor(1000 * n / mal) AS BIGINT)) END AS k FROM c, t),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {md5k(42, 'row_id')}, row_id) AS rn FROM l)
SELECT r.row_id, r.label FROM r JOIN q ON r.label = q.label WHERE r.rn <= q.k""", "flows"))
def proportional_sample(spark, sf_dir):
    """Fixed benign quota + malicious quota split over attack types,
    k smallest seeded hashes per stratum."""
    lab = _labels(spark, sf_dir).select("row_id", "label")
    counts = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    quota = SM.proportional_targets(counts, 2000, 1000)
    return SM.sample_per_stratum(lab, ["label"], quota, 42)


@register("vectors_split", sql("SELECT row_id, y, family, split FROM vectors", "vectors"))
def vectors_split(spark, sf_dir):
    """I04 on the vectors view: exact floor(0.2 n_y) test rows per class."""
    return views.vectors(spark, sf_dir).select("row_id", "y", "family", "split")


@register("class_quota_split", sql(f"""
SELECT row_id, CASE WHEN rn <= CASE y WHEN 0 THEN 200 WHEN 1 THEN 80 ELSE 0 END THEN 'train'
                    WHEN rn <= CASE y WHEN 0 THEN 250 WHEN 1 THEN 100 ELSE 0 END THEN 'test' ELSE 'unused' END AS split
FROM (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {md5k(42, 'row_id')}, row_id) AS rn FROM vectors) r""",
                                   "vectors"))
def class_quota_split(spark, sf_dir):
    """Exact per-class train and test sizes."""
    v = views.vectors(spark, sf_dir).select("row_id", "y")
    return SM.class_quota_split(v, {0: (200, 50), 1: (80, 20)}).select("row_id", "split")


def _split_sql(table_sql: str, label: str, seed: int, frac: float, key: str = "row_id") -> str:
    return f"""
SELECT {key}, CASE WHEN rn <= floor(n * CAST({frac} AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT {key}, row_number() OVER (PARTITION BY {label} ORDER BY {md5k(seed, key)}, {key}) AS rn,
             count(*) OVER (PARTITION BY {label}) AS n FROM ({table_sql}) s) r"""


@register("stratified_split", sql(_split_sql("SELECT row_id, y FROM vectors", "y", 0, 0.2), "vectors"))
def stratified_split(spark, sf_dir):
    """Stratified 80/20 split by class (seed 0)."""
    v = views.vectors(spark, sf_dir).select("row_id", "y")
    return SM.stratified_split(v, "y", 0.2, 0).select("row_id", "split")


@register("exact_stratified_split", sql(_split_sql(
    f"SELECT flow_id AS row_id, {binarize_sql('Label')} AS yb FROM flows", "yb", 0, 0.2), "flows"))
def exact_stratified_split(spark, sf_dir):
    """Exactly floor(n_c * 0.2) test rows per binarized class."""
    fl = views.flows(spark, sf_dir).select(F.col("flow_id").alias("row_id"), C.binarize_label("Label").alias("yb"))
    return SM.stratified_split(fl, "yb", 0.2, 0).select("row_id", "split")


@register("validation_holdout", sql(_split_sql("SELECT row_id, y FROM vectors WHERE split = 'train'", "y", 7, 0.2),
                                    "vectors"))
def validation_holdout(spark, sf_dir):
    """80/20 holdout of the training rows for the meta learner (seed 7)."""
    v = views.vectors(spark, sf_dir).where(F.col("split") == "train").select("row_id", "y")
    return SM.stratified_split(v, "y", 0.2, 7).select("row_id", "split")


@register("sample_without_replacement", sql(f"""
SELECT row_id FROM vectors WHERE y = 1 ORDER BY {md5k(42, 'row_id')}, row_id LIMIT 50""", "vectors"))
def sample_without_replacement(spark, sf_dir):
    """50 random members of the malicious subset (seeded top-k)."""
    v = views.vectors(spark, sf_dir).where(F.col("y") == 1)
    return v.orderBy(SM.hash_key(42), "row_id").limit(50).select("row_id")


@register("seeded_shuffle", sql(f"""
SELECT row_id, row_number() OVER (ORDER BY {md5k(42, 'row_id')}, row_id) - 1 AS pos FROM vectors""", "vectors"))
def seeded_shuffle(spark, sf_dir):
    """Seeded permutation positions (bucketed global rank, no single task)."""
    v = views.vectors(spark, sf_dir).select("row_id")
    h = SM.hash_key(42)
    return global_position(v.withColumn("_h", h), [F.col("_h"), F.col("row_id")], "pos",
                           bucket=lambda n: hash_bucket(F.col("_h"), n)).select("row_id", "pos")


BATCH_ITEMS, BATCH_S = 40, 14400

# A batch ends with its N-th item or with the first item T seconds after the
# end of the batch before (the clock starts with the first item).
MICRO_BATCH_SQL = f"""
WITH RECURSIVE x AS (SELECT flow_id, epoch_us(ts) AS u, row_number() OVER (ORDER BY ts, flow_id) AS p FROM flows),
e(p, u) AS (
  SELECT CAST(0 AS BIGINT), min(u) FROM x
  UNION ALL
  SELECT arg_min(x.p, x.p), arg_min(x.u, x.p) FROM e JOIN x ON x.p > e.p AND (x.p - e.p >= {BATCH_ITEMS} OR x.u - e.u >= {BATCH_S * 1_000_000})
  HAVING count(*) > 0),
n AS (SELECT p, lead(p) OVER (ORDER BY p) AS stop, row_number() OVER (ORDER BY p) - 1 AS batch_id FROM e)
SELECT x.flow_id, n.batch_id FROM x JOIN n ON x.p > n.p AND (n.stop IS NULL OR x.p <= n.stop)"""


@register("micro_batches", sql(MICRO_BATCH_SQL.replace("WITH RECURSIVE", "WITH"), "flows").replace("WITH", "WITH RECURSIVE", 1))
def micro_batches(spark, sf_dir):
    """A16 (batch form): a batch closes with its N-th flow or the first flow T
    seconds after the last close, whichever comes first; the rest is the last batch."""
    fl = views.flows(spark, sf_dir).select("flow_id", "ts")
    return SM.micro_batches(fl, "ts", "flow_id", BATCH_ITEMS, BATCH_S).select("flow_id", "batch_id")


@register("head_then_sample", sql(f"""
SELECT flow_id FROM (SELECT flow_id FROM flows ORDER BY ts, flow_id LIMIT 500000) h
ORDER BY {md5k(0, 'flow_id')}, flow_id LIMIT 500""", "flows"))
def head_then_sample(spark, sf_dir):
    """First max(5n, 500000) rows by time, then n = 500 by seeded hash."""
    fl = views.flows(spark, sf_dir).select("flow_id", "ts")
    return SM.head_then_sample(fl, 500, "ts", seed=0, row_id="flow_id").select("flow_id")


# --- tampering -----------------------------------------------------------------

def _train(spark, sf_dir):
    return views.vectors(spark, sf_dir).where(F.col("split") == "train")


def _test(spark, sf_dir):
    return views.vectors(spark, sf_dir).where(F.col("split") == "test")


POISON_SQL = """
t AS (SELECT row_id, y FROM vectors WHERE split = 'train'),
g AS (SELECT * FROM (VALUES {grid}) g(rate, seed, scenario)),
r AS (SELECT g.scenario, t.row_id, row_number() OVER (PARTITION BY g.scenario
        ORDER BY md5(concat(CAST(g.seed AS VARCHAR), '|', CAST(t.row_id AS VARCHAR))), t.row_id) AS rn,
        floor((SELECT count(*) FROM t WHERE y = 1) * g.rate) AS k
      FROM t, g WHERE t.y = 1),
p AS (SELECT g.scenario, t.row_id, t.y, CASE WHEN r.rn <= r.k THEN 0 ELSE t.y END AS y_poisoned
      FROM t CROSS JOIN g LEFT JOIN r ON r.scenario = g.scenario AND r.row_id = t.row_id)"""


def _grid(rates):
    return ", ".join(f"(CAST({r!r} AS DOUBLE), {TM.seed_for_rate(r)}, 'poison_{int(round(r * 100)):02d}')"
                     for r in rates)


@register("poison_labels", sql("WITH " + POISON_SQL.format(grid=_grid([POISON_RATE])) +
                               "\nSELECT row_id, y, y_poisoned FROM p", "vectors"))
def poison_labels(spark, sf_dir):
    """Flip int(n_mal * 0.10) malicious training labels (seed 42 + 100)."""
    return TM.poison_labels(_train(spark, sf_dir).select("row_id", "y"), POISON_RATE).select("row_id", "y",
                                                                                              "y_poisoned")


@register("scenario_builder", sql("WITH " + POISON_SQL.format(grid=_grid(TM.POISON_RATES)) +
                                  "\nSELECT scenario, row_id, y_poisoned FROM p", "vectors"))
def scenario_builder(spark, sf_dir):
    """All poisoning scenarios (5/10/15/50 %) from one clean table."""
    return TM.poison_scenarios(_train(spark, sf_dir).select("row_id", "y")).select("scenario", "row_id",
                                                                                   "y_poisoned")


@register("label_flips", sql("WITH " + POISON_SQL.format(grid=_grid(TM.POISON_RATES)) + """
SELECT p.scenario, count(*) AS n, count(*) FILTER (WHERE p.y_poisoned <> t.y) AS flipped,
       count(*) FILTER (WHERE p.y_poisoned <> t.y) * 100.0 / count(*) AS flipped_pct
FROM p JOIN t ON p.row_id = t.row_id GROUP BY p.scenario""", "vectors"))
def label_flips(spark, sf_dir):
    """Tampered vs clean labels joined on row_id; count and percent flipped."""
    clean = _train(spark, sf_dir).select("row_id", "y")
    return TM.label_flips(TM.poison_scenarios(clean), clean)


@register("trigger_positions", sql(f"""
SELECT pos FROM (SELECT DISTINCT CAST(unnest(range(0, len(features))) AS INT) AS pos FROM vectors) d
ORDER BY {md5k(TRIGGER_SEED, 'pos')}, pos LIMIT {TRIGGER_SIZE}""", "vectors"))
def trigger_positions(spark, sf_dir):
    """Seeded choice of 8 of the d feature positions."""
    return TM.trigger_positions(views.vectors(spark, sf_dir), TRIGGER_SIZE, TRIGGER_SEED)


def _long_sql(src: str, value_expr: str, extra: str = "") -> str:
    return f"""
SELECT row_id{extra}, pos, {value_expr} AS value FROM (
  SELECT *, CAST(generate_subscripts(features, 1) - 1 AS INT) AS pos, unnest(features) AS v FROM ({src}) s) u"""


@register("apply_trigger_fixed", sql(_long_sql("SELECT * FROM vectors",
                                               f"CASE WHEN pos IN ({POS_SQL}) THEN 1.0 ELSE v END"), "vectors"))
def apply_trigger_fixed(spark, sf_dir):
    """L02 (fixed): chosen positions set to 1.0 on every row."""
    v = views.vectors(spark, sf_dir)
    t = v.select("row_id", TM.apply_trigger(F.col("features"), POSITIONS, "fixed", 1.0).alias("f"))
    return t.select("row_id", F.posexplode("f").alias("pos", "value"))


@register("apply_trigger_noise", sql("""
SELECT row_id, CAST(len(features) AS INT) AS width, CAST({n} AS INT) AS changed FROM vectors""".format(n=TRIGGER_SIZE), "vectors"))
def apply_trigger_noise(spark, sf_dir):
    """L02 (noise): seeded Gaussian noise on the chosen positions; reported per
    row as width and number of positions whose value moved."""
    v = views.vectors(spark, sf_dir)
    t = TM.apply_trigger(F.col("features"), POSITIONS, "noise", seed=TRIGGER_SEED, row_id=F.col("row_id"))
    moved = F.zip_with("features", t, lambda a, b: (a != b).cast("int"))
    return v.select("row_id", F.size(t).alias("width"), F.aggregate(moved, F.lit(0), lambda s, x: s + x).alias("changed"))


@register("encode_with_labels", sql("WITH " + POISON_SQL.format(grid=_grid(TM.POISON_RATES)) + """
SELECT p.scenario, count(*) AS n, count(*) FILTER (WHERE p.y_poisoned <> t.y) AS flipped, CAST(8 AS INT) AS width,
       CAST(0 AS BIGINT) AS mismatches FROM p JOIN t ON p.row_id = t.row_id GROUP BY p.scenario""", "vectors"))
def encode_with_labels(spark, sf_dir):
    """Encoded rows (K13) joined with every scenario's tampered labels;
    rows, flips, latent width and rows that found no partner (E08) per scenario."""
    from netwarden.operators import models as MD
    train = _train(spark, sf_dir)
    enc, _, _ = MD.dual_view_encode(train, 4)
    encoded = train.select("row_id", "y", enc.alias("latent"))
    tampered = TM.poison_scenarios(train.select("row_id", "y"))
    j = TM.encode_with_labels(encoded.drop("y"), tampered)
    return j.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y_poisoned") != F.col("y"), 1)).alias("flipped"),
        F.max(F.size("latent")).alias("width"),
        F.count(F.when(F.col("latent").isNull() | F.col("y_poisoned").isNull(), 1)).alias("mismatches"))


_PATTERN_CASE = " ".join(f"WHEN pos = {p} THEN {1.0 if j % 2 == 0 else 0.0}" for j, p in enumerate(POSITIONS))


@register("apply_trigger_pattern", sql(_long_sql("SELECT * FROM vectors", f"CASE {_PATTERN_CASE} ELSE v END"),
                                       "vectors"))
def apply_trigger_pattern(spark, sf_dir):
    """L02 (pattern): alternating 1/0 over the chosen positions."""
    v = views.vectors(spark, sf_dir)
    t = v.select("row_id", TM.apply_trigger(F.col("features"), POSITIONS, "pattern").alias("f"))
    return t.select("row_id", F.posexplode("f").alias("pos", "value"))


BACKDOOR_SQL = f"""
WITH t AS (SELECT row_id, y, features FROM vectors WHERE split = 'train'),
c AS (SELECT row_id, row_number() OVER (ORDER BY {md5k(42, 'row_id')}, row_id) AS rn FROM t WHERE y = 0),
k AS (SELECT CAST(floor(count(*) * {BACKDOOR_RATE_PCT} / 100.0) AS BIGINT) AS k FROM t WHERE y = 0),
b AS (SELECT t.row_id, t.y AS y_clean, CASE WHEN c.rn <= k.k THEN 1 ELSE 0 END AS backdoor, t.features
      FROM t LEFT JOIN c ON t.row_id = c.row_id, k)"""


@register("backdoor_train_set", sql(BACKDOOR_SQL + """
SELECT row_id, y_clean, backdoor, CASE WHEN backdoor = 1 THEN 1 ELSE y_clean END AS y FROM b""", "vectors"))
def backdoor_train_set(spark, sf_dir):
    """10 % of benign training rows get the trigger and label 1."""
    tr = _train(spark, sf_dir).select("row_id", "y", "features")
    bd = TM.backdoor_train_set(tr.withColumn("y_clean", F.col("y")), BACKDOOR_RATE_PCT, POSITIONS)
    return bd.select("row_id", "y_clean", "backdoor", "y")


@register("backdoor_stats", sql(BACKDOOR_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE y_clean = 0) AS benign, count(*) FILTER (WHERE backdoor = 1) AS tampered,
       round(count(*) FILTER (WHERE backdoor = 1) * 100.0 / count(*), 6) AS tampered_pct FROM b""", "vectors"))
def backdoor_stats(spark, sf_dir):
    """total, benign, tampered, percent of the backdoored training set."""
    tr = _train(spark, sf_dir).select("row_id", "y", "features")
    bd = TM.backdoor_train_set(tr.withColumn("y_clean", F.col("y")), BACKDOOR_RATE_PCT, POSITIONS)
    return TM.backdoor_stats(bd)


@register("backdoor_features", sql(BACKDOOR_SQL + _long_sql(
    "SELECT * FROM b", f"CASE WHEN backdoor = 1 AND pos IN ({POS_SQL}) THEN 1.0 ELSE v END").replace(
        "SELECT row_id,", "SELECT row_id,", 1), "vectors"))
def backdoor_features(spark, sf_dir):
    """Feature values of the backdoored training set (long form)."""
    tr = _train(spark, sf_dir).select("row_id", "y", "features")
    bd = TM.backdoor_train_set(tr, BACKDOOR_RATE_PCT, POSITIONS)
    return bd.select("row_id", F.posexplode("features").alias("pos", "value"))


@register("triggered_test_set", sql(_long_sql(
    "SELECT v.*, x.variant FROM vectors v, (VALUES ('clean'), ('triggered')) x(variant) WHERE v.split = 'test'",
    f"CASE WHEN variant = 'triggered' AND pos IN ({POS_SQL}) THEN 1.0 ELSE v END", ", variant, y"), "vectors"))
def triggered_test_set(spark, sf_dir):
    """Clean and fully triggered copies of the test rows, same labels."""
    t = TM.triggered_test_set(_test(spark, sf_dir), POSITIONS)
    return t.select("row_id", "variant", "y", F.posexplode("features").alias("pos", "value"))


@register("mixed_realistic_test", sql(_long_sql(
    "SELECT * FROM vectors WHERE split = 'test'",
    f"CASE WHEN y = 1 AND pos IN ({POS_SQL}) THEN 1.0 ELSE v END", ", y, CAST(y = 1 AS INT) AS triggered"),
    "vectors"))
def mixed_realistic_test(spark, sf_dir):
    """Benign test rows clean, malicious test rows triggered."""
    t = TM.mixed_realistic_test(_test(spark, sf_dir), POSITIONS)
    return t.select("row_id", "y", "triggered", F.posexplode("features").alias("pos", "value"))
