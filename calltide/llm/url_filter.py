"""URL filters: rules by host and path first, then a list of URLs, looked up through a blocked Bloom filter.

A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with the rule's; the longest
rule wins, of two equally long ones the one that blocks. URLs without a rule are blocked if their canonical form is on
the list. The list may be of any size: it becomes a Bloom filter of blocks of 512 bits, one row a block, in which a URL
sets one bit in each of eight 64-bit words. Only URLs whose eight bits are all set go on to an exact join with the list,
which takes the filter's false positives out. The blocks are broadcast up to ``BLOCKS`` of them (72 bytes each, some 64 MB
for 40 million listed URLs); a longer list's blocks are joined by a shuffle, with the same result.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are on no list: they are allowed. Repeated
rows stay, extra columns of both tables may have any name, an empty list blocks nothing. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.filters import sized

#: Blocks of the filter that are broadcast, at most.
BLOCKS = 900_000
#: Listed URLs in a block, in the mean: 16 bits each, of which each sets 8.
PER_BLOCK = 32
WORDS = 8

Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, ``m.`` or a port that goes without saying, path without ``index.html``, ``.html`` and slashes at
    its end, and what parameters are left, sorted, without those that only tell where a reader came from. Scheme and
    fragment do not count. Null without a host."""
    own = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    place = F.regexp_replace(F.regexp_replace(path(url), r"(/index)?\.html?$", ""), r"/+$", "")
    asked = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    left = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    query = F.when(F.size(left) > 0, F.concat(F.lit("?"), F.array_join(left, "&"))).otherwise("")
    return F.when(own != "", F.concat(own, place, query))


def rule_of(hosts: Column, paths: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (verdict, rule); null without one. ``rules`` are few: they become one expression."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):  # the last one is asked first
        fits = ((hosts == h) | hosts.endswith("." + h)) & paths.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _bits(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    code, one = F.xxhash64(key, F.lit("bits")), F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(code, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0, ..., w7) of the keys (a column ``key``) of a list."""
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block")
    bits = [b.alias(f"b{k}") for k, b in enumerate(_bits(F.col("key")))]
    return listed.select(block, *bits).groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"w{k}") for k in range(WORDS)))


def possible(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """rows with ``hit``: whether the filter lets their ``key`` pass, which every listed key does."""
    asked = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    met = asked.join(F.broadcast(blocks) if n_blocks <= BLOCKS else blocks, "block", "left")
    every = F.lit(True)
    for k, bit in enumerate(_bits(F.col("key"))):
        every = every & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    return met.withColumn("hit", F.coalesce(every, F.lit(False))).drop("block", *(f"w{k}" for k in range(WORDS)))


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row of pages (page_id, url); ``listed`` has a column ``url``."""
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct()
    n_blocks = max(1, -(-keys.count() // PER_BLOCK))
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("key"))
    ruled = rule_of(F.col("host"), F.col("path"), rules).cast("struct<verdict:string,rule:string>")
    rows = rows.withColumn("ruled", ruled)
    rows = possible(rows, bloom(keys, n_blocks), n_blocks)
    exact = rows.where("hit").join(sized(keys).withColumn("listed", F.lit(True)), "key", "left")
    every = exact.unionByName(rows.where("not hit").withColumn("listed", F.lit(None).cast("boolean")))
    on = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(on, "block").otherwise("allow"))
    return every.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), on.alias("listed"))
