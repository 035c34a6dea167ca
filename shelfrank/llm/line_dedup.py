"""Line de-duplication by site-relative frequency, in DataFrame functions only.

For each host, the share of its pages that contain a line; lines above ``max_ratio`` are boilerplate and are cut from
every page of that host. Lines are compared without blanks at their ends; blank lines stay. A line counts once per
page. Hosts with fewer than ``min_pages`` pages, and lines on fewer than ``min_line_pages`` pages, are left alone.
``low_ratio``, if given, also makes boilerplate of lines above it that are on ``LOW_PAGES`` pages or more.

A null text stays null; a null host is a host of its own. An empty table gives an empty result. Other columns pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, boxed, materialize

#: Bytes of a host's row in a broadcast, without its keys, and of each key.
HOST_BYTES, KEY_BYTES = 128, 40
#: The lowest of 0.1, 0.05, 0.03, 0.02, 0.015, 0.01, 0.005 and 0.002 at which repeated documents are not taken for
#: boilerplate: every line that is cut on sf0.1 and check_s is in at least half as many different texts as documents.
#: Lines over it must be on so many pages at least, against chance repeats in small hosts.
LOW_RATIO, LOW_PAGES = 0.01, 10


def _key(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, text: Column, host: Column, max_ratio: float, min_pages: int, min_line_pages: int, low_ratio: float | None = None) -> DataFrame:
    """``host, keys``: per host the keys of its boilerplate lines.

    A page has at most all its lines in here and each kept line is on over the lower ratio of the pages, so a host has
    at most (mean lines a page) / that ratio keys: the arrays stay small whatever the host's size. Counts are
    combined before the shuffle, so a hot host or line costs one row per task.
    """
    totals = pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    once = pages.select(host.alias("host"), F.explode(F.array_distinct(F.transform(lines, _key))).alias("key"))
    counted = once.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_line_pages)
    large = totals.where(F.col("pages") >= min_pages).withColumnRenamed("host", "_host")
    often = F.col("n") > F.col("pages") * F.lit(max_ratio)
    if low_ratio is not None:
        often |= (F.col("n") >= LOW_PAGES) & (F.col("n") > F.col("pages") * F.lit(low_ratio))
    hot = counted.join(large, F.col("host").eqNullSafe(F.col("_host"))).where(often)
    return hot.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    pages: DataFrame, *, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.1, min_pages: int = 10, min_line_pages: int = 3, low_ratio: float | None = None, counts: bool = False
) -> DataFrame:
    """``pages`` with the boilerplate lines cut from ``text_col``; ``counts`` adds ``n_lines`` and ``n_dropped``."""
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    cut = materialize(boilerplate(pages, text, host, max_ratio, min_pages, min_line_pages, low_ratio), "line-keys")
    known = cut.select(F.col("host").alias("_host"), F.col("keys").alias("_keys"))
    if cut.agg(F.coalesce(F.sum(HOST_BYTES + KEY_BYTES * F.size("keys")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    # every page is one struct here, so its columns may have any names
    own, text, host = F.col("doc"), F.col("doc")[text_col], F.col("doc")[host_col]
    lines = F.split(text, "\n", -1)
    joined = boxed(pages).join(known, host.eqNullSafe(F.col("_host")), "left")
    left = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_keys"), _key(F.trim(x))))
    joined = joined.withColumn("_left", F.when(F.col("_keys").isNotNull(), left).otherwise(lines))
    names = [F.array_join("_left", "\n").alias(c) if c == text_col else own[c].alias(c) for c in pages.columns]
    if counts:
        n = F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0)).cast("long")
        names += [n.alias("n_lines"), (n - F.coalesce(F.when(text.isNotNull(), F.size("_left")), F.lit(0))).cast("long").alias("n_dropped")]
    return joined.select(*names)


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, i, unnest(string_split(text, chr(10))) AS line
  FROM (SELECT doc_id, source, text, row_number() OVER () AS i FROM documents)),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
counted AS (SELECT source, trim(line) AS line, count(DISTINCT i) AS n FROM lines WHERE trim(line) <> '' GROUP BY 1, 2),
cut AS (
  SELECT c.source, c.line FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 3 AND t.pages >= 10 AND c.n > t.pages * 0.1),
keys AS (SELECT source, list(line) AS keys FROM cut GROUP BY source),
split AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS ls, coalesce(k.keys, []) AS keys
  FROM documents d LEFT JOIN keys k ON d.source IS NOT DISTINCT FROM k.source),
left_over AS (SELECT *, list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(keys, trim(x))) AS kept FROM split)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM left_over
"""

LOW_ORACLE_SQL = ORACLE_SQL.replace("c.n > t.pages * 0.1)", f"(c.n > t.pages * 0.1 OR (c.n >= {LOW_PAGES} AND c.n > t.pages * {LOW_RATIO})))")
