"""URL filters: host and path rules first, then a blocked Bloom filter over listed canonical URLs whose hits an exact hash join confirms.

The filter is a table of blocks of 512 bits, one row a block: a URL's hash names the block and another hash sets one bit in each of the block's
eight words, so a probe reads one row. It has at most ``most_blocks`` blocks (64 bytes each) whatever the length of the list, which is why it can be
broadcast; a list too long for that makes more false positives, and as every hit goes on to the exact join, never another verdict.

A URL without ``://``, or a null one, has an empty host and path and no canonical form; it is never listed and allowed. Repeated rows are judged
alike. Of rules of equal length that fit, the first given wins. Very long URLs are read whole. Nulls in the list and repeats of a listed URL change nothing.
An empty list blocks nothing; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = 8

#: (verdict, host, beginning of the path); a rule holds for its host and all subdomains.
RULES: tuple[tuple[str, str, str], ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_of(url: Column) -> Column:
    """Host without www. and the usual ports, path without closing slashes, query parameters in order without utm_* and ref; no scheme, no fragment.
    Null where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&", -1)
    query = F.array_join(F.array_sort(F.filter(query, lambda p: ~p.rlike(r"^(utm_|ref=|ref$)") & (p != ""))), "&")
    whole = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.locate("://", url) > 0, whole)


def judged_by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict: of the rules that fit, the one with the longest host and path."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    g = F.xxhash64(key, F.lit(1))
    return [_bit(g, 6 * i) for i in range(_WORDS)]


def _bit(g: Column, at: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, at).bitwiseAND(F.lit(63)).cast("int"))


def build_filter(listed: DataFrame, key: str, *, bits_a_key: int = 16, most_blocks: int = 1 << 17) -> tuple[DataFrame, int]:
    """(block, w0 .. w7) of the keys of a table, and the number of blocks of which those without a key are left out."""
    n_blocks = max(1, min(most_blocks, -(-listed.count() * bits_a_key // 512)))
    set_bits = listed.select(_block(F.col(key), n_blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))))
    return set_bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS))), n_blocks


def probe_filter(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int, to: str) -> DataFrame:
    """rows with the column ``to``: whether the filter may hold the key. blocks has at most most_blocks rows, so it is broadcast."""
    side = blocks.select(F.col("block").alias("_block"), *(F.col(f"w{i}").alias(f"_w{i}") for i in range(_WORDS)))
    hit = reduce(lambda a, b: a & b, (F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col(key)))))
    joined = rows.join(F.broadcast(side), _block(F.col(key), n_blocks) == F.col("_block"), "left")
    return joined.withColumn(to, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("_block", *(f"_w{i}" for i in range(_WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", bits_a_key: int = 16, most_blocks: int = 1 << 17) -> DataFrame:
    """page_id, host, path, canonical, rule, possible (a hit in the filter), listed and verdict; one row per input row.

    ``listed`` holds URLs in its first column, in any form. Rules judge first; of the other rows those that the filter lets through meet the list in a hash join on the whole
    canonical URL; adaptive execution splits that join where one URL holds many rows."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col).cast("string")
    known = scratch.save(listed.select(canonical_of(F.col(f"`{listed.columns[0]}`").cast("string")).alias("key")).where("key is not null").distinct(), "listed")
    blocks, n_blocks = build_filter(known, "key", bits_a_key=bits_a_key, most_blocks=most_blocks)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_of(url).alias("canonical"))
    rows = rows.withColumn("_rule", judged_by_rule(F.col("host"), F.col("path"), rules))
    probed = probe_filter(rows, "canonical", scratch.save(blocks, "filter"), n_blocks, "possible")
    probed = scratch.save(probed.select("page_id", "host", "path", "canonical", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"), "possible"), "probed")
    settled = probed.where("not possible or ruled is not null").withColumn("listed", F.when(F.col("ruled").isNull(), F.lit(False)))
    asked = probed.where("possible and ruled is null")
    found = asked.join(known.withColumn("_in", F.lit(True)).hint("shuffle_hash"), asked["canonical"] == F.col("key"), "left").withColumn("listed", F.coalesce("_in", F.lit(False))).drop("key", "_in")
    verdict = F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise("allow"))
    return settled.unionByName(found).select("page_id", "host", "path", "canonical", "rule", "possible", "listed", verdict.alias("verdict"))


def tracked_links(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list of the registered query: URLs that were captured with a utm_ parameter, which marks a feed's link. A capture of the same
    canonical URL without the parameter is then blocked as well."""
    return pages.select(F.col(url_col).cast("string").alias("url")).where(F.col("url").rlike(r"(?s)^[^#]*?[?&]utm_"))


ORACLE_SQL = r"""
with p as (select page_id, coalesce(url, '') as url from pages),
h as (select page_id, url,
             translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
             list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_|ref=|ref$)'))) as query
      from p),
c as (select *, case when contains(url, '://') then regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                                                || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end end as canonical from h),
listed as (select distinct canonical from c where regexp_matches(url, '(?s)^[^#]*?[?&]utm_') and canonical is not null),
r as (select *, case when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                     when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                     when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                     when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from c)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from r
"""
