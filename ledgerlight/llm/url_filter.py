"""Exact URL rules by a Bloom filter cascade, in DataFrame functions only.

A cascade decides membership in a list of keys exactly for every key of a known universe: level 0 is a Bloom filter of
the listed keys, level 1 of the universe's unlisted keys that level 0 lets through, level 2 of the listed keys that
level 1 lets through, and so on until nothing is let through wrongly. A key is then looked up level by level; the first
filter that it misses tells whether it is listed. Look-ups are expressions over constants, so applying a list to a
corpus takes neither a join nor a shuffle. The universe is the set of all candidate keys of the corpus itself.

A rule is (host, path prefix); candidate keys of a URL are its host's suffixes on label borders with the prefixes of its
path that are as long as some rule's path. Two cascades, one of blocked and one of allowed keys, decide each candidate;
the longest listed candidate (by key length, then host length) is the URL's rule.

Bounds: a filter has ``BITS_PER_KEY`` bits a key. Where what level 0 lets through of the corpus takes more than ``MAX_BITS``,
level 0 is built again with ``WIDER`` times the bits, up to the bound. Where a filter is still over the bound, list and
universe are split by key hash into twice as many parts; each part has cascades of its own and is looked up in a pass of its
own, so a plan never holds more than the two cascades of one part, whatever the list's and the corpus's size.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; an empty list gives no rule
to any URL; of rules of one key that both block and allow, the block counts; rules with a null part are none; repeated
rows and null ids each get their verdict; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import written

BITS_PER_KEY = 8
HASHES = 3
MAX_BITS = 1 << 24
MAX_LEVELS = 64
WIDER = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


# ---------------------------------------------------------------- the cascade


@dataclass
class Level:
    bits: int
    words: list[int]  # 32 bits each

    def holds(self, key: Column, depth: int) -> Column:
        if not any(self.words):
            return F.lit(False)
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded into a constant
        at = lambda i: _position(key, depth, i, self.bits)
        hit = lambda p: F.call_function("shiftright", F.get(words, F.shiftright(p, 5).cast("int")), (p % 32).cast("int")).bitwiseAND(F.lit(1)) == 1
        return reduce(lambda a, b: a & b, [hit(at(i)) for i in range(HASHES)])


def _position(key: Column, depth: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(depth), F.lit(i)), F.lit(bits)).cast("long")


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)  # let through by all levels: a key that the last level encodes
        for depth in reversed(range(len(self.levels))):
            answer = F.when(self.levels[depth].holds(key, depth), answer).otherwise(F.lit(depth % 2 == 1))
        return answer if self.levels else F.lit(False)


class TooManyKeys(ValueError):
    """A filter would be over ``MAX_BITS``."""


def _level(keys: DataFrame, depth: int, count: int, bits_per_key: int) -> Level:
    bits = max(64, count * bits_per_key)
    if bits > MAX_BITS:
        raise TooManyKeys(f"a filter of {count} keys takes {bits} bits, over the bound of {MAX_BITS}")
    places = keys.select(F.explode(F.array(*[_position(F.col("key"), depth, i, bits) for i in range(HASHES)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("b"))
    out = [0] * ((bits + 31) // 32)
    for w, b in words.collect():  # at most MAX_BITS / 32 rows
        out[w] = b
    return Level(bits, out)


def _through(keys: DataFrame, level: Level, depth: int, listed: DataFrame) -> tuple[DataFrame, int]:
    through = keys.where(level.holds(F.col("key"), depth))
    if depth == 0:  # few rows are left after the filter, but those of the list are among them
        through = through.distinct().join(listed, "key", "left_anti")
    through = through.cache()
    return through, through.count()


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY) -> Cascade:
    """Both frames have one string column, key. Keys of the list count as part of the universe."""
    listed = listed.select("key").where("key is not null").distinct().cache()
    n = listed.count()
    cascade = Cascade()
    if not n:
        listed.unpersist()
        return cascade
    sides, kept = [listed, universe.select("key")], []
    size, first = n, bits_per_key
    for depth in range(MAX_LEVELS):
        level = _level(sides[0], depth, n, bits_per_key)
        cascade.levels.append(level)
        # the other side's keys that this level lets through; for level 0 those of the universe that aren't listed
        through, n = _through(sides[1], level, depth, listed)
        while depth == 0 and n * bits_per_key > MAX_BITS and max(64, size * first) * WIDER <= MAX_BITS:
            through.unpersist()
            first = max(64, size * first) * WIDER // size
            cascade.levels = [_level(listed, depth, size, first)]
            through, n = _through(sides[1], cascade.levels[0], depth, listed)
        kept.append(through)
        if not n:
            break
        sides = [through, sides[0]]
    else:
        raise ValueError("the cascade did not end; raise bits_per_key")
    for x in [listed, *kept]:
        x.unpersist()
    return cascade


# ---------------------------------------------------------------- rules over URLs


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """An array of (key, host) of all rules that could fit, longest key first. Empty if the host is."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in path_lengths]) if path_lengths else F.array().cast("array<string>")
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct((-F.length(h) - F.length(p)).alias("a"), (-F.length(h)).alias("b"), F.concat(h, p).alias("key")))))
    return F.when(host != "", F.array_sort(keys)).otherwise(F.array().cast("array<struct<a:int,b:int,key:string>>"))


def filter_urls(df: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row. ``rules`` (host, path, action) is a bounded list; actions are allow and block."""
    base = df.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rules = rules.where("host is not null and path is not null")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    keys = rules.select(F.concat("host", "path").alias("key"), "action")
    base = base.withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = base.select(F.explode("_keys.key").alias("key")).distinct()
    parts = 1
    while True:
        try:
            found = _judged(base, keys, universe, parts)
            break
        except TooManyKeys:
            parts *= 2
    return found.select(F.col("_id").alias(id_col), "host", "path", F.col("_best.key").alias("rule"), F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))


def _judged(base: DataFrame, keys: DataFrame, universe: DataFrame, parts: int) -> DataFrame:
    """``base`` with ``_best``, the longest candidate that is listed: each candidate is looked up once in either cascade of
    its part."""
    mine = lambda key, part: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)) == part
    out = base.withColumn("_best", F.lit(None).cast("struct<a:int,b:int,key:string,action:string>"))
    for part in range(parts):
        some = universe.where(mine(F.col("key"), part))
        block, allow = (build_cascade(keys.where((F.col("action") == a) & mine(F.col("key"), part)), some) for a in ("block", "allow"))
        action = lambda k: F.when(block.contains(k), F.lit("block")).when(allow.contains(k), F.lit("allow"))
        looked_up = lambda k: F.when(mine(k["key"], part), action(k["key"])) if parts > 1 else action(k["key"])
        judged = F.transform("_keys", lambda k: F.struct(k["a"], k["b"], k["key"].alias("key"), looked_up(k).alias("action")))
        first = F.get(F.filter(judged, lambda k: k["action"].isNotNull()), F.lit(0))
        best = first if parts == 1 else F.array_min(F.filter(F.array("_best", first), lambda k: k.isNotNull()))
        out = out.withColumn("_best", best)
        if part < parts - 1:  # the next part's filters come into a plan of their own
            out = written(out, "judged")
    return out


def rule_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """From (action, "host/path") pairs."""
    rows = [(r[: r.index("/")], r[r.index("/") :], action) for action, r in rules]
    return spark.createDataFrame(rows, "host string, path string, action string")
