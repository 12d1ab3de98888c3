"""URL filters: host and path rules, then a blocked Bloom filter before an exact join with a list of canonical URLs.

A rule is `host/path`: it fits its host and all subdomains if the path starts with the rule's; the longest rule that
fits decides. URLs that no rule fits are looked up in the list: each listed URL sets four bits of one 64-bit block, a URL
whose block has all its bits is a possible hit, and only those go to the exact join, which removes false positives.
Everything is DataFrame code; the filter is a table with one row per block, which AQE broadcasts only if it is small.

Defined results: a null URL or one without `://` has an empty host and path, no rule and is allowed; canonical forms of
such URLs are null and never listed. Repeated rows are judged each. An empty list allows all; an empty table gives an
empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, query

#: (verdict, host, path); fixed values of the query's contract.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Parts of host names whose pages the query lists.
LISTED_TERMS = ("adult", "pills", "bets")
KEY_BITS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without closing slashes, parameters sorted and without trackers; no scheme, no fragment."""
    params = F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "&"), lambda x: (x != "") & ~x.rlike("^(utm_|ref=)"))
    whole = F.concat(
        F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.lit("?"), F.array_join(F.array_sort(params), "&"))
    return F.when(url.contains("://"), whole)


def matched_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equal ones that with the longer host, then the blocking one."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in reversed(ranked):
        fits = ((host_ == rule_host) | host_.endswith("." + rule_host)) & path_.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) from rows with a `key`."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def listed_keys(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds `listed` (boolean) to rows with a `key`; `listed` has the distinct keys of the list."""
    listed = durable(listed.select("key").filter("key is not null").distinct())
    blocks = listed.count() * KEY_BITS // 64 + 1
    table = durable(bloom(listed, blocks))
    probed = rows.withColumn("block", F.coalesce(_block(F.col("key"), blocks), F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
    probed = probed.join(table, "block", "left")
    mask = _mask(F.col("key"))
    probed = durable(probed.withColumn("possible", F.coalesce(F.col("key").isNotNull() & (F.col("bits").bitwiseAND(mask) == mask), F.lit(False))).drop("block", "bits"))
    hits = probed.filter("possible").drop("possible").join(listed.withColumn("listed", F.lit(True)), "key", "left")
    rest = probed.filter("not possible").drop("possible").withColumn("listed", F.lit(False))
    return hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest)


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`; `listed` has URLs to block in a column `url`."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(rule.isNull(), canonical(F.col("url"))).alias("key"))
    found = listed_keys(rows, listed.select(canonical(F.col("url")).alias("key")))
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


@query("op7_urls", """
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', 3) AS params FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || '?' ||
    coalesce(array_to_string(list_sort(list_filter(string_split(params, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=)'))), '&'), '') END AS key
  FROM p),
l AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '(^|[.-])(adult|pills|bets)([.-]|$)')),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM r
""")
def _op7(table):
    pages = table("pages").select("page_id", "url")
    listed = pages.filter(host(F.col("url")).rlike(rf"(^|[.-])({'|'.join(LISTED_TERMS)})([.-]|$)"))
    return judged(pages, listed)
