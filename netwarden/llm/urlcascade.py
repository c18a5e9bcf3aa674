"""URL filter by a cascade of Bloom filters.

The corpus's key universe is every (host suffix, path prefix) key that a url
offers to the rules' shapes.  Level 1 is a Bloom filter of the listed keys;
level 2 holds the unlisted universe keys that level 1 wrongly accepts, level 3
the listed keys that level 2 wrongly accepts, and so on until no error is
left: the first level that rejects a key then decides it exactly, for every
key of the universe and without a join.  Level 1 is sized so that its errors are about as
many as the listed keys; the deeper levels have an error rate of one half.

DataFrame functions only: filters are built by ``bit_or`` over 64-bit words
and tested by expressions on a binary literal.  A cascade whose filters would exceed
``MAX_BITS`` bits is not built; its keys are joined with the list instead.

Defined cases: a null url or one without ``://`` has empty host and path; no
rule fits an empty host; the longest rule wins, equal lengths: the longer
host; repeated rules count once, a key both blocked and allowed is allowed; urls that no rule
fits are allowed.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.common import carried, materialise, prepare, small_side

MAX_BITS = 1 << 26
MAX_LEVELS = 40


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the rules see them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


class Cascade:
    """Levels of (filter bytes, bits, hashes, salt)."""

    def __init__(self, levels: list[tuple[bytes, int, int, int]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Whether a universe key is listed."""
        out = F.lit(len(self.levels) % 2 == 1)  # accepted by every level
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~_accepts(self.levels[i], key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt * 64 + j)), F.lit(bits)) for j in range(hashes)]


def _accepts(level: tuple[bytes, int, int, int], key: Column) -> Column:
    data, bits, hashes, salt = level
    bit = F.lit(True)
    store = F.lit(bytearray(data))
    for p in _positions(key, bits, hashes, salt):
        byte = F.conv(F.hex(F.substr(store, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mask = F.call_function("shiftleft", F.lit(1), (p % 8).cast("int"))
        bit = bit & (byte.bitwiseAND(mask) > 0)
    return bit


def _level(keys: DataFrame, bits: int, hashes: int, salt: int) -> tuple[bytes, int, int, int]:
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt))).alias("p"))
    word = pos.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b"))
    data = bytearray(8 * math.ceil(bits / 64))
    for r in word.collect():  # at most MAX_BITS / 64 rows
        data[8 * r["w"]:8 * r["w"] + 8] = (r["b"] & (1 << 64) - 1).to_bytes(8, "little")
    return bytes(data), bits, hashes, salt


def build(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """Cascade over ``key`` columns of distinct rows; None if it would not fit."""
    yes = listed
    n_yes, n_all = yes.count(), universe.count()
    if n_yes == 0:
        return Cascade([])
    no = universe.join(small_side(yes, n_yes), "key", "left_anti")
    rate = min(0.5, max(1e-9, n_yes * math.sqrt(0.5) / max(n_all, 1)))
    levels: list[tuple[bytes, int, int, int]] = []
    put, other, n = yes, no, n_yes
    while n and len(levels) < MAX_LEVELS:
        bits = max(64, math.ceil(1.4427 * n * math.log2(1 / rate)))
        if bits > MAX_BITS:
            return None
        levels.append(_level(put, bits, max(1, round(math.log2(1 / rate))), len(levels) + 1))
        wrong = materialise(other.filter(_accepts(levels[-1], F.col("key"))), "cascade")
        put, other, n, rate = wrong, put, wrong.count(), 0.5
    if n:
        raise RuntimeError("the cascade did not close")
    return Cascade(levels)


def _offered(host: Column, path: Column, shapes) -> Column:
    """The keys a url offers: one for each (labels, path length) shape of the rules."""
    labels = F.size(F.split(host, r"\."))
    found = [F.when((host != "") & (labels >= n) & (F.length(path) >= p), F.struct(
        (F.length(F.substring_index(host, ".", -n)) + p).alias("size"), F.length(F.substring_index(host, ".", -n)).alias("host_size"),
        F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, p) if p else F.lit("")).alias("key"))) for n, p in shapes]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", keep: list[str] = ()) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every page; ``rules``
    has (host, path, verdict).  A result column takes the place of a ``keep`` column of
    its name."""
    keep = carried(keep, "host", "path", "rule", "verdict")
    prepare(pages.sparkSession)
    rules = rules.filter("host is not null and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("p"), "verdict")
    rules = materialise(rules.groupBy("key").agg(F.min("verdict").alias("verdict"), F.first("n").alias("n"), F.first("p").alias("p")), "rules")
    shapes = sorted((r["n"], r["p"]) for r in rules.select("n", "p").distinct().collect())
    host, path = url_parts(F.col(url))
    src = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not shapes:
        return src.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    offered = src.select(F.explode(_offered(F.col("host"), F.col("path"), shapes)).alias("k"))
    universe = materialise(offered.select(F.col("k.key").alias("key")).distinct(), "universe")
    block = build(rules.filter("verdict = 'block'").select("key"), universe)
    allow = build(rules.filter("verdict = 'allow'").select("key"), universe)
    if block is None or allow is None:
        return _judge_joined(src, rules, shapes, list(keep))
    tested = []
    for n, p in shapes:
        k = F.get(_offered(F.col("host"), F.col("path"), [(n, p)]), F.lit(0))
        is_allow, is_block = allow.contains(k["key"]), block.contains(k["key"])
        tested.append(F.when(k.isNotNull() & (is_allow | is_block), F.struct(
            k["size"].alias("size"), k["host_size"].alias("host_size"), k["key"].alias("key"),
            F.when(is_allow, "allow").otherwise("block").alias("verdict"))))
    best = F.array_max(F.filter(F.array(*tested), lambda x: x.isNotNull()))
    return src.withColumn("_llm_best", best).select(
        *keep, "host", "path", F.col("_llm_best.key").alias("rule"), F.coalesce("_llm_best.verdict", F.lit("allow")).alias("verdict"))


def _judge_joined(src: DataFrame, rules: DataFrame, shapes, keep: list[str]) -> DataFrame:
    """The same by a join on the key, for lists beyond the filters' bound."""
    sites = src.select("host", "path").distinct()
    hit = sites.select("host", "path", F.explode(_offered(F.col("host"), F.col("path"), shapes)).alias("k")).join(
        rules.select(F.col("key").alias("_key"), F.col("verdict").alias("_v")), F.col("k.key") == F.col("_key"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct("k.size", "k.host_size", "k.key", "_v")).alias("_b"))
    return src.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("_b.key").alias("rule"), F.coalesce("_b._v", F.lit("allow")).alias("verdict"))
