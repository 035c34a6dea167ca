"""URL filters: host and path rules, and a blocked Bloom filter in front of an exact join with listed URLs.

Rules decide first: a rule fits its host and all subdomains where the URL's path starts with the rule's; the longest
fitting rule wins. Other URLs are blocked if their canonical form is listed. The Bloom filter is a table of blocks of
eight 64-bit lanes, built by one aggregate; it grows with the list, so its rate of false positives stays. It is
broadcast within a bound of bytes; a larger filter is joined by block number, with no more than 8 bytes a page shuffled
besides the key. What the filter passes is settled by an exact join, which removes its false positives.

A null URL, or one without ``://``, has empty host and path, fits no rule and is never listed. Repeated rows are judged
alike. An empty list blocks nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small

#: Fixed rules: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LANES, LANE_BITS = 8, 6
#: Keys for which a block has room (16 bits each), and bytes of a block in a broadcast.
KEYS_PER_BLOCK, BLOCK_BYTES = 32, 112


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule, as ``struct(rule, verdict)``; null if none fits."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        said = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return out


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page: no scheme, query or fragment, no ``www.`` or ``m.``, no ``.html`` and no slash at the end."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/+$", "")))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number, and one bit for each lane of the block."""
    where, which = F.xxhash64(key), F.xxhash64(key, F.lit("lanes"))
    lane = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(which, k * LANE_BITS).bitwiseAND(63).cast("int"))
    return F.pmod(where, F.lit(blocks)), [lane(k) for k in range(LANES)]


def build_bloom(listed: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """``(filter table, number of blocks)`` over the distinct ``key`` of ``listed``."""
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    block, lanes = _bits(F.col(key), blocks)
    table = listed.groupBy(block.alias("_block")).agg(*[F.bit_or(x).alias(f"_lane{k}") for k, x in enumerate(lanes)])
    return table, blocks


def may_be_listed(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """``rows`` plus ``_maybe``: false means certainly not listed."""
    block, lanes = _bits(F.col(key), blocks)
    joined = rows.withColumn("_at", block).join(small(bloom, BLOCK_BYTES), F.col("_at") == F.col("_block"), "left")
    hit = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_lane{k}"), F.lit(0)).bitwiseAND(x) == x for k, x in enumerate(lanes)])
    return joined.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_at", "_block", *[f"_lane{k}" for k in range(LANES)])


def judge(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and whether the filter passed the URL and the list has it.

    ``listed`` has one column ``key`` of canonical URLs, in any number and repeated or not.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_said", said).withColumn("_key", canonical(F.col("host"), F.col("path")))
    keys = materialize(listed.where(F.col("key").isNotNull()).select("key").distinct(), "url-list")
    bloom, blocks = build_bloom(keys)
    rows = may_be_listed(rows, "_key", bloom, blocks)
    known = keys.withColumnRenamed("key", "_known")
    passed = rows.where("_maybe").join(known, F.col("_key") == F.col("_known"), "left").withColumn("listed", F.col("_known").isNotNull()).drop("_known")
    judged = passed.unionByName(rows.where(~F.col("_maybe")).withColumn("listed", F.lit(False)))
    return judged.select(
        "page_id", "host", "path", F.col("_said.rule").alias("rule"),
        F.coalesce(F.col("_said.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )


def spelled_twice(pages: DataFrame, *, url_col: str = "url") -> DataFrame:
    """The list of the registered query: canonical URLs that the table spells in more than one way."""
    url = F.col(f"`{url_col}`")
    keys = pages.select(url.alias("url"), canonical(host_of(url), path_of(url)).alias("key")).where(F.col("key").isNotNull())
    return keys.groupBy("key").agg(F.min("url").alias("a"), F.max("url").alias("b")).where("a <> b").select("key")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
k AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') END AS key FROM u),
listed AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING min(url) <> max(url)),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM k)
SELECT r.page_id, r.host, r.path, r.rule, l.key IS NOT NULL AS listed,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN listed l ON r.key = l.key
"""
