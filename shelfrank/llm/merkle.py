"""Merkle manifest of a dataset: a tree of digests per partition value, a root over all, and a proof for every row.

Rows of a tree are numbered by id; the binary digits of a number are columns. Inside a block of WIDTH consecutive rows
the lowest digit is grouped away first, then the next, and so on: each grouping nests the structs of its children and
hashes their digests, so one shuffle by block does all levels. Blocks' digests are the rows of the next level, until a
tree fits in one block. Proofs come back the same way: a block's nested struct is unfolded by ``transform`` and
``explode``, every row with its siblings; the proof of the block itself meets it in a grouping by block. No tree, and no
partition value, is ever in one task as a whole; nothing is joined on leaves but the size and start of their tree.

A null field hashes as ``-``; null ids come first, rows of one id are ordered by their digest, and equal rows have
proofs of their own. A null partition value has a tree of its own. Extra columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, hub_join, materialize, ordinal

#: Binary digits of a number that one block groups away, and rows in a block.
BITS = 8
WIDTH = 1 << BITS
#: What a proof is: digests left and right of the own one, from the leaf up. Both are empty where a node stood alone.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Byte count, colon and value; a dash for null. So no two rows have the same fields."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(rows: DataFrame, *, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None) -> DataFrame:
    """``id, key, h, other``: digest of each row, and of the row with ``changed`` fields where ``changed`` differs from null.

    ``key`` stands for the tree: it is never null and orders trees by value, null first.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    tree = F.col(f"`{tree_col}`").cast("string")
    other = F.lit(None).cast("string")
    if changed:
        after = own | changed
        differs = reduce(Column.__or__, [~after[c].eqNullSafe(own[c]) for c in changed])
        other = F.when(differs, digest(*[field(after[c]) for c in fields]))
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), tree), F.lit("")).alias("key"), digest(*[field(v) for v in own.values()]).alias("h"), other.alias("other"))


def roll_up(nodes: DataFrame) -> DataFrame:
    """``key, n, block, kids, h``: every block of ``nodes(key, n, rank, h, kids)`` as one nested struct with its digest.

    ``n`` is the size of the tree at this level. A node without sibling is hashed alone, but a tree's last node stays.
    """
    digits = [F.shiftright("rank", k).bitwiseAND(1).cast("tinyint").alias(f"d{k}") for k in range(BITS)]
    now = nodes.select("key", "n", F.shiftright("rank", BITS).alias("block"), *digits, "h", "kids").repartition("key", "block")
    for k in range(BITS):
        child = F.struct(F.col(f"d{k}").alias("d"), "h", "kids")
        now = now.groupBy("key", "n", "block", *[f"d{j}" for j in range(k + 1, BITS)]).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        together = F.array_join(F.transform("kids", lambda x: x["h"]), "")
        now = now.withColumn("h", F.when(F.col("n") > (1 << k), digest(together)).otherwise(F.col("kids")[0]["h"]))
    return now


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Levels of blocks, from the leaves up, until every tree fits in one block; each is saved."""
    levels = []
    while True:
        levels.append(materialize(roll_up(nodes), f"{name}-{len(levels)}"))
        more = levels[-1].where(F.col("n") > WIDTH)
        if more.isEmpty():
            return levels
        nodes = more.select("key", F.shiftright(F.col("n") + WIDTH - 1, BITS).alias("n"), F.col("block").alias("rank"), "h", F.struct(F.col("block").alias("rank")).alias("kids"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """``key, h`` of every tree."""
    return reduce(DataFrame.unionByName, [x.where(F.col("n") <= WIDTH).select("key", "h") for x in levels])


def _unfold(kids: Column, k: int, path: Column, n: Column) -> Column:
    """Array of ``h, own, path`` of all that is nested in ``kids``; ``path`` is the proof of what holds them."""

    def further(i: Column) -> Column:
        left = F.when(i == 1, kids[0]["h"]).otherwise(F.lit(""))
        right = F.when((i == 0) & (F.size(kids) == 2), kids[1]["h"]).otherwise(F.lit(""))
        step = F.when(n > (1 << k), F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(PATH))
        return F.concat(step, path)

    if k == 0:
        return F.transform(kids, lambda kid, i: F.struct(kid["h"].alias("h"), kid["kids"].alias("own"), further(i).alias("path")))
    return F.flatten(F.transform(kids, lambda kid, i: _unfold(kid["kids"], k - 1, further(i), n)))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``key, h, own, path, more`` of every leaf of ``levels``; ``above(key, path, more)`` is what holds a whole tree.

    Proofs of blocks and the blocks themselves are brought together by a grouping; two rows meet in each group.
    """
    given, below = above.select("key", F.lit(0).cast("long").alias("block"), F.lit(True).alias("top"), "path", "more"), None
    for nested in reversed(levels):
        held = given if below is None else given.unionByName(below.select("key", F.col("own.rank").alias("block"), F.lit(False).alias("top"), "path", "more"))
        rows = nested.select("key", "block", (F.col("n") <= WIDTH).alias("top"), "n", "kids").unionByName(held, allowMissingColumns=True)
        met = rows.groupBy("key", "block", "top").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "more")]).where("kids is not null and path is not null")
        below = met.select("key", F.explode(_unfold(F.col("kids"), BITS - 1, F.col("path"), F.col("n"))).alias("x"), "more").select("key", "x.h", "x.own", "x.path", "more")
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its proof come to."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def manifest(rows: DataFrame) -> DataFrame:
    """``id, leaf, other, subroot, root, path`` for ``rows`` of ``leaves``: the proof leads over the subroot to the root."""
    spark = rows.sparkSession
    saved = materialize(rows, "merkle-leaves")  # texts are hashed once: finding ranges reads these rows again
    placed = ordinal(saved, [F.col("key"), F.col("id").asc_nulls_first(), F.col("h"), F.col("other")], "at")
    placed = materialize(placed, "merkle-placed")
    trees = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("size", F.col("n"))
    trees = materialize(trees, "merkle-trees")
    few = bounded(trees)
    sized = placed.join(F.broadcast(few), "key") if few is not None else hub_join(placed, trees, "key", "at")
    nodes = sized.select("key", F.col("size").alias("n"), (F.col("at") - F.col("first")).alias("rank"), "h", F.struct("id", "other").alias("kids"))
    levels = climb(nodes, "merkle")

    subroots = materialize(ordinal(tops(levels), [F.col("key")], "rank"), "merkle-subroots")
    own = subroots.select(F.lit("").alias("key"), F.lit(subroots.count()).alias("n"), "rank", "h", F.struct(F.col("key").alias("tree")).alias("kids"))
    upper = climb(own, "merkle-upper")
    root = tops(upper).select("key", F.array().cast(PATH).alias("path"), F.struct(F.col("h").alias("root")).alias("more"))
    above = descend(upper, root).select(F.col("own.tree").alias("key"), "path", F.struct(F.col("h").alias("subroot"), "more.root").alias("more"))
    above = materialize(above, "merkle-above")
    discard(saved, placed, subroots, *upper)
    found = descend(levels, above)
    return found.select("own.id", F.col("h").alias("leaf"), "own.other", "more.subroot", "more.root", "path")


def tampered_proofs(documents: DataFrame) -> DataFrame:
    """Proofs of all ``documents``, checked after adding 1 to ``n_chars`` of those whose id's checksum 7 divides."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = leaves(documents, changed={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    found = manifest(rows)
    folded = found.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF = "sha256(concat({}))"
_FIELDS = [_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
_CHANGED = [_sql_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text")]
_CRC = """xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295), 4294967295)"""
ORACLE_SQL = f"""WITH RECURSIVE lf AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, text) - 1 AS rank,
  {_LEAF.format(", ".join(_FIELDS))} AS leaf, CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format(", ".join(_CHANGED))} END AS other FROM documents),
nodes AS (SELECT lang, 0 AS lvl, rank AS idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM lf
  UNION ALL SELECT lang, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM nodes WHERE n = 1),
up AS (SELECT 0 AS lvl, rank AS idx, h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lvl, idx // 2, n),
steps AS (SELECT l.doc_id, l.leaf, 0 AS part, o.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN s.idx < o.idx THEN 'l' || s.h ELSE 'r' || s.h END AS step
  FROM lf l JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.idx = l.rank >> o.lvl AND o.n > 1 LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM o.lang AND s.lvl = o.lvl AND s.idx = xor(o.idx, 1)
  UNION ALL SELECT l.doc_id, l.leaf, 1, o.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN s.idx < o.idx THEN 'l' || s.h ELSE 'r' || s.h END
  FROM lf l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang JOIN up o ON o.idx = sub.rank >> o.lvl AND o.n > 1 LEFT JOIN up s ON s.lvl = o.lvl AND s.idx = xor(o.idx, 1)),
paths AS (SELECT doc_id, leaf, list(step ORDER BY part, lvl) AS path FROM steps GROUP BY ALL),
fo AS (SELECT l.doc_id, l.leaf, sub.h AS subroot, (SELECT h FROM up WHERE n = 1) AS root, coalesce(path, []) AS path, coalesce(other, l.leaf) AS own
  FROM lf l LEFT JOIN paths p ON p.doc_id IS NOT DISTINCT FROM l.doc_id AND p.leaf = l.leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang),
done AS (SELECT *, list_reduce(path, lambda h, s: CASE s[1] WHEN 'l' THEN sha256(s[2:] || h) WHEN 'r' THEN sha256(h || s[2:]) ELSE sha256(h) END, own) AS folded_root FROM fo)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda s: s[2:]), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done"""
