"""URL filter by Bloom filter cascades.

A cascade answers exactly, for every key of a known universe, whether it is listed. Level 1
is a Bloom filter of the listed keys. The keys of the universe that it lets through by
mistake go into level 2, the listed keys that level 2 holds by mistake into level 3, and so
on until nothing is left. A key is listed if the first level that rejects it has an even
number. A level is an array of 64-bit words, handed to the tasks as a scalar subquery:
membership is an expression, without a join.

Rules, a list of hosts and a list of places (host and path) become keys. The universe is every
key that a URL of the corpus can ask for: each host suffix with each path prefix of a length that
some rule has, each host, and each place. A URL gets the verdict of the longest rule that fits;
without one, it is blocked if its host or its place is listed.

A level of 6 bits per key lets about 6 % of the other keys through, so each level but the first
is small, and all levels together need about half the bits that one level of 12 would.

A cascade is built in parts of at most ``PART_KEYS`` listed keys, which bounds each array;
a key's part follows from its hash.

Edge cases: a URL that is null or has no ``://`` has empty host and path, fits no rule and
is allowed unless the empty host or place is listed. A rule that both blocks and allows the same
place allows. An empty list or table gives cascades that hold nothing. Other columns of the
pages are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS_PER_KEY = 6
HASHES = 4
PART_KEYS = 1 << 20
LEAST_WORDS = 16


@dataclass
class Level:
    words: DataFrame  # one row, one column: array<long>
    n_words: int
    salt: int


@dataclass
class Cascade:
    parts: list[list[Level]] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed. For use in a projection or filter: Spark
        allows no subquery inside a higher-order function."""
        answer = F.lit(False)
        for p, levels in enumerate(self.parts):
            inside = F.lit(len(levels) % 2 == 1)  # passed every level
            for i in reversed(range(len(levels))):
                inside = F.when(_in_level(key, levels[i]), inside).otherwise(F.lit(i % 2 == 1))
            answer = F.when(_part(key, len(self.parts)) == p, inside).otherwise(answer)
        return answer


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def _bits(key: Column, level_salt: int, n_words: int) -> list[Column]:
    """Bit numbers of a key, by double hashing."""
    bits = n_words * 64
    a = F.pmod(F.xxhash64(F.lit(2 * level_salt), key), F.lit(bits))
    b = F.pmod(F.xxhash64(F.lit(2 * level_salt + 1), key), F.lit(bits - 1)) + 1
    return [F.pmod(a + k * b, F.lit(bits)) for k in range(HASHES)]


def _in_level(key: Column, level: Level) -> Column:
    words, found = level.words.scalar(), F.lit(True)
    for bit in reversed(_bits(key, level.salt, level.n_words)):
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        found = F.when(F.getbit(word, F.pmod(bit, F.lit(64)).cast("int")) == 1, found).otherwise(F.lit(False))
    return found


def _level(keys: DataFrame, n_keys: int, salt: int) -> Level:
    """A Bloom filter of ``keys`` (key), its words stored in order as one array."""
    n_words = max(LEAST_WORDS, math.ceil(n_keys * BITS_PER_KEY / 64))
    bit = F.explode(F.array(*_bits(F.col("key"), salt, n_words)))
    set_words = (
        keys.select(bit.alias("bit"))
        .select(F.shiftright("bit", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("word"))
        .groupBy("at")
        .agg(F.bit_or("word").alias("word"))
    )
    # n_words rows at most, bounded by PART_KEYS
    held = set_words.agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))
    words = held.select(
        F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words")
    )
    return Level(stored(words, "cascade-level"), n_words, salt)


def build(listed: DataFrame, universe: DataFrame, part_keys: int = PART_KEYS) -> Cascade:
    """A cascade over ``listed`` and ``universe`` (key each). Listed keys outside the universe
    cannot be asked for and are left out."""
    keys = (
        universe.select("key", F.lit(0).alias("l"))
        .union(listed.select("key", F.lit(1).alias("l")))
        .where("key is not null")
        .groupBy("key")
        .agg(F.max("l").alias("listed"), F.min("l").alias("outside"))
        .where("outside = 0")
        .select("key", (F.col("listed") == 1).alias("listed"))
    )
    keys = stored(keys, "cascade-keys")
    parts = max(1, math.ceil(keys.where("listed").count() / part_keys))
    cascade = Cascade()
    for p in range(parts):
        members = keys.where(_part(F.col("key"), parts) == p)
        inside, outside = members.where("listed"), members.where("not listed")
        levels: list[Level] = []
        while n := inside.count():
            level = _level(inside.select("key"), n, len(levels))
            levels.append(level)
            passed = outside.where(_in_level(F.col("key"), level))
            inside, outside = stored(passed, "cascade-passed"), inside
        cascade.parts.append(levels)
    return cascade


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def place_of(url: Column) -> Column:
    """Host and path: the key of a place."""
    return F.concat(host_of(url), path_of(url))


def _place() -> Column:
    return F.concat("host", "path")


def _asked(rules: list[tuple[str, str, str]], host: Column, path: Column) -> list[Column]:
    """The keys by which a URL can meet a rule: one for each number of labels and length of
    path that a rule has, null where the URL is shorter."""
    shapes = sorted({(rule_host.count(".") + 1, len(rule_path)) for _, rule_host, rule_path in rules})
    labels = F.size(F.split(host, r"\."))
    return [
        F.when(
            (host != "") & (labels >= n) & (F.length(path) >= m),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)),
        )
        for n, m in shapes
    ]


def judged(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    listed_hosts: DataFrame,
    part_keys: int = PART_KEYS,
    listed_places: DataFrame | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, listed, place_listed. rules: (block or allow, host, path).
    listed_hosts, listed_places: (key), hosts, and hosts with paths, to block where no rule fits."""
    spark = pages.sparkSession
    places = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = _asked(rules, F.col("host"), F.col("path"))
    hosts = places.select(F.col("host").alias("key")).distinct()
    candidates = places.select(F.explode(F.array(*asked) if asked else F.array().cast("array<string>")).alias("key")).distinct()
    of = {}
    for kind in ("allow", "block"):
        names = [(host + path,) for k, host, path in rules if k == kind]
        of[kind] = build(spark.createDataFrame(names, "key string"), candidates, part_keys)
    listed = build(listed_hosts.select("key"), hosts, part_keys)
    listed_place = Cascade()
    if listed_places is not None:
        listed_place = build(listed_places.select("key"), places.select(_place().alias("key")).distinct(), part_keys)

    named = [f"_key{i}" for i in range(len(asked))]
    places = places.withColumns(dict(zip(named, asked)))

    def longest(kind: str) -> Column:
        """The longest rule of a kind that fits, empty if none does."""
        none = F.struct(F.lit(0).alias("n"), F.lit("").alias("key"))
        fits = [
            F.when(F.col(k).isNotNull() & of[kind].holds(F.col(k)), F.struct(F.length(k).alias("n"), F.col(k).alias("key")))
            for k in named
        ]
        return F.greatest(none, none, *fits)["key"]

    found = places.select(
        "page_id", "host", "path", longest("allow").alias("_allow"), longest("block").alias("_block"),
        listed.holds(F.col("host")).alias("listed"), listed_place.holds(_place()).alias("place_listed"),
    )
    allowed = (F.col("_allow") != "") & (F.length("_allow") >= F.length("_block"))
    blocked = (F.col("_block") != "") & ~allowed
    return found.select(
        "page_id", "host", "path",
        F.when(allowed, F.col("_allow")).when(blocked, F.col("_block")).alias("rule"),
        F.when(allowed, "allow").when(blocked, "block").when(F.col("listed") | F.col("place_listed"), "block").otherwise("allow").alias("verdict"),
        "listed", "place_listed",
    )
