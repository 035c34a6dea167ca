"""Exact vector search for tables of queries: one numpy kernel per block of items and of queries, reducers on top.

Scores are doubles rounded to six digits, so equal vectors tie and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Best, Block, Types, by_blocks, by_types, facets, item_blocks, masked
from .ranking import best_first, top_k

DIGITS = 6


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("array<double>") for c in columns})


def search(queries: DataFrame, items: DataFrame, k: int = 50, *, exclude_self: bool = False, digits: int = DIGITS) -> DataFrame:
    """``query_id, item_id, score, rank``: the ``k`` nearest items of each query.

    ``queries(query_id, vector)``, ``items(item_id, item_vector)``. Queries may have the filters ``color`` and
    ``category``; these ask for ``color``, ``category`` and ``category_l1`` of items, a null filter keeps all. Each task
    emits ``k`` rows a query.
    """
    rows = _doubles(items.select("item_id", "item_vector", *facets(queries)), "item_vector")
    filters = [c for c in ("color", "category") if c in queries.columns]
    asked = _doubles(queries.select("query_id", "vector", *filters), "vector")

    def run(block: Block, batch: Block) -> dict[str, np.ndarray]:
        ids = block["query_id"]
        best = Best(np.full(len(ids), k))
        for part in item_blocks(batch):
            own = part["item_id"]
            scores = np.round(block["vector"] @ part["item_vector"].T, digits)
            if exclude_self:
                scores[ids[:, None] == own[None, :]] = -np.inf
            if filters:
                masked(scores, block, part)
            best.offer(own, scores)
        return best.rows(ids)

    found = by_blocks(asked, rows, {"item_vector": ("vector",)}, run, "query_id long, item_id long, score double")
    return top_k(found, k, ["query_id"], best_first(item="item_id"))


def search_types(queries: DataFrame, items: DataFrame, types: Types, k: int | dict[str, int] = 48) -> DataFrame:
    """``type, query_id, item_id, score, rank`` for every search type: (model, modality of the query, modality of the target).

    ``queries(model_id, modality, query_id, vector)``, ``items(model_id, modality, item_id, item_vector)``; vectors of
    different models never meet. All types are searched in one pass, each for its own ``k`` if a dict is given.
    """
    most = k if isinstance(k, dict) else dict.fromkeys(types, k)

    def run(name: str, block: Block, batch: Block) -> dict[str, np.ndarray]:
        best = Best(np.full(len(block["query_id"]), most[name]))
        for part in item_blocks(batch):
            best.offer(part["item_id"], np.round(block["vector"] @ part["item_vector"].T, DIGITS))
        return best.rows(block["query_id"])

    found = by_types(queries, items, types, run, "query_id long, item_id long, score double")
    wanted = F.coalesce(*[F.when(F.col("type") == name, n) for name, n in most.items()])
    return top_k(found, wanted, ["type", "query_id"], best_first(item="item_id"))


def target_ranks(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """``query_id, rank``: 1 plus the other items that score at least as much as the target; ties count against it."""
    own = scores.join(targets, ["query_id"]).where(F.col("item_id") == F.col("target_id")).select("query_id", F.col("score").alias("own"), "target_id")
    better = scores.join(own, "query_id").where((F.col("item_id") != F.col("target_id")) & (F.col("score") >= F.col("own")))
    return own.select("query_id").join(better.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("rank"))


def _above(block: Block, batch: Block) -> np.ndarray:
    """How many other items score at least as much as each query's target."""
    own = np.round((block["vector"] * block["target_vector"]).sum(axis=1), DIGITS)
    n = np.zeros(len(own), np.int64)
    for part in item_blocks(batch):
        scores = np.round(block["vector"] @ part["item_vector"].T, DIGITS)
        n += np.count_nonzero((scores >= own[:, None]) & (part["item_id"][None, :] != block["target_id"][:, None]), axis=1)
    return n


def target_ranks_at_scale(queries: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``target_ranks``, without a row for each query and item: tasks emit counts only."""
    known = targets.join(items, F.col("target_id") == F.col("item_id")).select("query_id", "target_id", F.col("item_vector").alias("target_vector"))
    asked = _doubles(queries.join(known, "query_id").select("query_id", "target_id", "vector", "target_vector"), "vector", "target_vector")

    def count(block: Block, batch: Block) -> dict[str, np.ndarray]:
        return {"query_id": block["query_id"], "n": _above(block, batch)}

    rows = _doubles(items.select("item_id", "item_vector"), "item_vector")
    counted = by_blocks(asked, rows, {"item_vector": ("vector", "target_vector")}, count, "query_id long, n long")
    return counted.groupBy("query_id").agg((F.sum("n") + 1).cast("long").alias("rank"))


def target_ranks_of_types(queries: DataFrame, items: DataFrame, types: Types, targets: DataFrame) -> DataFrame:
    """``type, query_id, rank``: ``target_ranks_at_scale`` of every search type, as ``search_types`` names them, in one pass."""

    def count(_: str, block: Block, batch: Block) -> dict[str, np.ndarray]:
        return {"query_id": block["query_id"], "n": _above(block, batch)}

    counted = by_types(queries, items, types, count, "query_id long, n long", targets)
    return counted.groupBy("type", "query_id").agg((F.sum("n") + 1).cast("long").alias("rank"))
