"""URL filtering: written rules first, then a blocklist held in a cascade of Bloom filters.

The cascade's first filter encodes the listed keys; the second encodes the keys of the corpus
that the first passes wrongly; the third the listed keys that the second passes wrongly, and so
on until no key is wrong. Over the corpus's complete key universe membership is then exact, and
a page is judged by a few bit tests without a join.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and the
verdict allow; repeated pages are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.text import LOWER, UPPER, named, utf8
from helixspark.session import cut, table

#: (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A filter has about so many bits at most (4 MB, 500,000 longs that one task puts in order); longer lists are dealt out to several cascades.
MAX_BITS = 1 << 25


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty where there is no ``://``."""
    url = utf8(url)
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does. Of equally long ones block wins."""
    text = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


@dataclass
class Level:
    """One Bloom filter: a one-row table with its bits as longs."""

    words: DataFrame
    bits: int
    hashes: int
    salt: int

    def maybe(self, key: Column) -> Column:
        """True for every encoded key, and for few others."""
        words, hit = self.words.scalar(), F.lit(True)
        for at in _positions(key, self.bits, self.hashes, self.salt):
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            hit = hit & (_bit(word, at) == 1)
        return hit


def _bit(word: Column, at: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * salt)), F.xxhash64(key, F.lit(2 * salt + 1))
    return [F.pmod(F.shiftright(a, 8) + F.lit(i) * F.shiftright(b, 8), F.lit(bits).cast("long")) for i in range(hashes)]


def bits_for(n: int, wrong: float) -> int:
    return 64 * max(1, math.ceil(max(n, 1) * -math.log(wrong) / math.log(2) ** 2 / 64))


def bloom(keys: DataFrame, n: int, wrong: float, salt: int) -> Level:
    """A filter of the n rows of ``keys`` (column key)."""
    bits = bits_for(n, wrong)
    hashes = max(1, round(-math.log2(wrong)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt))).alias("at"))
    set_ = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(set_, "w", "left")
    words = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("x")).select(F.col("x.v").alias("words"))
    return Level(cut(words), bits, hashes, salt)


@dataclass
class Cascade:
    """Exact membership over ``universe``; ``levels`` is empty where nothing is listed."""

    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """No joins: the deepest level that a key reaches decides."""
        inside = F.lit(False)
        for level in reversed(self.levels):
            inside = level.maybe(key) & ~inside
        return inside


@dataclass
class Shards:
    """A cascade for each part of the keys, by a hash of the key."""

    parts: list[Cascade]

    def contains(self, key: Column) -> Column:
        inside = F.lit(False)
        for i, part in enumerate(self.parts):
            inside = F.when(_shard(key, len(self.parts)) == i, part.contains(key)).otherwise(inside)
        return inside


def _shard(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(n).cast("long"))


def cascade(listed: DataFrame, universe: DataFrame, first_wrong: float = 0.01, next_wrong: float = 0.1) -> Cascade | Shards:
    """Both tables have one column, key, without repeats. A list that needs more than MAX_BITS is dealt out to several cascades."""
    listed, universe = cut(listed), cut(universe)
    n = listed.count()
    shards = -(-bits_for(n, first_wrong) // MAX_BITS)
    if shards == 1:
        return _cascade(listed, universe, n, first_wrong, next_wrong)
    parts = []
    for i in range(shards):
        own = _shard(F.col("key"), shards) == i
        part = cut(listed.where(own))
        parts.append(_cascade(part, universe.where(own), part.count(), first_wrong, next_wrong))
    return Shards(parts)


def _cascade(listed: DataFrame, universe: DataFrame, n: int, first_wrong: float, next_wrong: float) -> Cascade:
    levels: list[Level] = []
    inside, outside = listed, universe
    while n:
        level = bloom(inside, n, next_wrong if levels else first_wrong, len(levels))
        levels.append(level)
        wrong = outside.where(level.maybe(F.col("key")))
        if len(levels) == 1:
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = cut(wrong)
        n = wrong.count()
        inside, outside = wrong, inside
    return Cascade(levels)


def page_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """All keys by which a page can be listed: its host, and its host with path."""
    host, path = url_parts(named(url_col))
    parts = pages.select(host.alias("host"), path.alias("path")).where("host <> ''")
    return parts.select(F.explode(F.array("host", F.concat("host", "path"))).alias("key")).distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed. ``listed`` has the blocked keys in its column key."""
    host, path = url_parts(named(url_col))
    parts = pages.select(named(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = listed.select("key").where("key is not null").distinct()
    filters = cascade(keys, page_keys(pages, url_col))
    inside = (F.col("host") != "") & (filters.contains(F.col("host")) | filters.contains(F.concat("host", "path")))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("listed", inside)
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def stand_in_feed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Blocked keys in place of a bought feed: every key of the corpus whose MD5 begins with 0.

    It grows with the corpus and lists whole hosts and single pages alike.
    """
    return page_keys(pages, url_col).where(F.md5("key").startswith("0"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, stand_in_feed(pages))


OP2_SQL = r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
     r(action, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
     m as (select page_id, host, path, (select max_by(struct_pack(rule := h || r.p, action := action), length(h || r.p)) from r
                  where (host = h or suffix(host, '.' || h)) and prefix(path, r.p)) as best,
                  host <> '' and (prefix(md5(host), '0') or prefix(md5(host || path), '0')) as listed from p)
select page_id, host, path, best.rule as rule, coalesce(best.action, case when listed then 'block' else 'allow' end) as verdict, listed from m
"""
