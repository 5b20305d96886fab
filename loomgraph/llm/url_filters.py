"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Native: column expressions and joins only. The filter is a table of 256-bit blocks (four longs each); a url's block tells
that it is not listed or that it may be. Only the possible hits meet the list itself, in an exact join that removes the
false positives, so urls that are not listed are neither shuffled nor sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (action, rule): the rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The Bloom filter's table is broadcast up to this many bytes, else joined by block.
BROADCAST_BYTES = 8 << 20
_BLOCK_BYTES = 64  # four longs, the key and the row's header


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without a leading www., path without a trailing / or .html; null where there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/|\.html)$", "")))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, action> of the longest rule that fits (of equally long ones the first in code point order), else null.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The rules are policy, a
    literal in the plan; lists of urls go to `listed`.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,action:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for action, rule in ordered:
        name, slash, rest = rule.partition("/")
        own = (host == name) | host.endswith("." + name)
        fits.append((own & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    out = F.when(*fits[0])
    for test, value in fits[1:]:
        out = out.when(test, value)
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of four longs, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    bit = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(8)]
    return [bit[2 * j].bitwiseOR(bit[2 * j + 1]) for j in range(4)]


def bloom_table(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter: one row for each block that holds a key. Partial bit_or runs before the shuffle."""
    masks = [m.alias(f"__m{j}") for j, m in enumerate(_masks(F.col(key)))]
    rows = listed.select(_block(F.col(key), n_blocks).alias("__block"), *masks)
    return rows.groupBy("__block").agg(*(F.bit_or(f"__m{j}").alias(f"__w{j}") for j in range(4)))


def listed_urls(urls: DataFrame, listed: DataFrame, key: str = "canonical", bits_per_key: int = 12, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """urls with a column `listed`: whether column `key` is in the same column of `listed`. Null keys are not listed.

    Repeated rows of either table are kept or count once, as they should. Skewed keys: the list has each key once, so an
    adaptive join may split the urls' side freely.
    """
    listed = listed.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    n = listed.count()
    if not n:
        return urls.withColumn("listed", F.lit(False))
    n_blocks = max(1, math.ceil(n * bits_per_key / 256))
    bloom = bloom_table(listed, "__key", n_blocks)
    if min(n, n_blocks) * _BLOCK_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    marked = urls.withColumn("__block", _block(F.col(key), n_blocks)).join(bloom, "__block", "left")
    held = F.lit(True)
    for j, m in enumerate(_masks(F.col(key))):
        held = held & (F.col(f"__w{j}").bitwiseAND(m) == m)
    marked = marked.withColumn("__maybe", F.col(key).isNotNull() & F.coalesce(held, F.lit(False))).drop("__block", *(f"__w{j}" for j in range(4)))
    misses = marked.where("not __maybe").withColumn("listed", F.lit(False)).drop("__maybe")
    exact = listed.withColumn("__in", F.lit(True))
    possible = marked.where("__maybe").drop("__maybe")
    hits = possible.join(exact, possible[key] == exact["__key"], "left").withColumn("listed", F.col("__in").isNotNull()).drop("__key", "__in")
    return misses.unionByName(hits)


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", **limits) -> DataFrame:
    """pages with host, path, rule (null: none fits) and verdict: the rule's, else block for a listed canonical url, else allow.

    Null urls and urls without :// have an empty host, fit no rule, are not listed and so are allowed. Columns of these
    names are replaced. `listed` has a column `canonical`.
    """
    own = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("__row"), F.col(url).alias("__url"))
    own = own.select("__row", url_host(F.col("__url")).alias("__host"), url_path(F.col("__url")).alias("__path"))
    own = own.withColumn("canonical", canonical_url(F.col("__host"), F.col("__path"))).withColumn("__rule", best_rule(F.col("__host"), F.col("__path"), rules))
    own = listed_urls(own, listed, **limits)
    verdict = F.coalesce(F.col("__rule.action"), F.when(F.col("listed"), "block").otherwise("allow"))
    keep = [F.col("__row").getField(c).alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return own.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))


def recaptured(pages: DataFrame, url: str = "url") -> DataFrame:
    """The list of the registered query: canonical urls that were captured under more than one url."""
    urls = pages.select(F.col(url).alias("u")).distinct()
    key = canonical_url(url_host(F.col("u")), url_path(F.col("u")))
    return urls.groupBy(key.alias("canonical")).count().where("count > 1 and canonical is not null").select("canonical")


ORACLE = r"""
with u as (
  select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
c as (select *, case when host <> '' then regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '') end as canonical from u),
listed as (select canonical from (select distinct url, canonical from c) group by canonical having count(*) > 1 and canonical is not null),
rules(action, rule, rhost, rpath) as (values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
best as (select c.*, (select {'rule': rule, 'action': action} from rules where (c.host = rhost or ends_with(c.host, '.' || rhost)) and starts_with(c.path, rpath) order by length(rule) desc, rule limit 1) as r from c)
select page_id, host, path, r.rule as rule, coalesce(r.action, case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict from best
"""
