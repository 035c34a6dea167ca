"""Two-sided search at scale: standard scores of photo and title, blended, without a row for each query and item.

Blocks of queries meet blocks of items twice. The first pass gives the moments of each query's scores, merged from one
row per task; the second blends inside the task and emits top rows or counts only. Statistics are those of all items, so
a filter never changes a score. ``fusion.blend`` is the check.

``queries(query_id, photo_query, title_query, ...)``, ``items(item_id, photo_vector, title_vector, ...)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import DIGITS, _doubles
from .fusion import BLEND
from .kernel import Best, Block, Shape, by_blocks, facets, item_blocks, masked, shape
from .ranking import best_first, top_k

SIDES = ("photo", "title")
ASKING, OWN = ("photo_query", "title_query"), ("photo_vector", "title_vector")
TARGETS = ("photo_target", "title_target")
#: Which columns of queries meet which of items.
MEET = dict(zip(OWN, ((a,) for a in ASKING), strict=True))
MEET_TARGETS = dict(zip(OWN, zip(ASKING, TARGETS, strict=True), strict=True))
#: Blended scores nearer to the target's than this are compared as they are rounded.
NEAR = 2e-6


def moments(queries: DataFrame, items: DataFrame, known: Shape | None = None) -> DataFrame:
    """``query_id, n, photo_mean, photo_dev, title_mean, title_dev``: what standard scores need, over the whole item table."""

    def run(block: Block, batch: Block) -> dict[str, np.ndarray]:
        ids = block["query_id"]
        n, mean, spread = 0, np.zeros((2, len(ids))), np.zeros((2, len(ids)))
        for part in item_blocks(batch):
            m = len(part["item_id"])
            for k, (asking, own) in enumerate(zip(ASKING, OWN, strict=True)):
                scores = np.round(block[asking] @ part[own].T, DIGITS)
                here = scores.mean(axis=1)
                off = here - mean[k]
                spread[k] += ((scores - here[:, None]) ** 2).sum(axis=1) + off**2 * (n * m / (n + m))
                mean[k] += off * (m / (n + m))
            n += m
        return {"query_id": ids, "n": np.full(len(ids), n), "photo": mean[0], "title": mean[1], "photo_m2": spread[0], "title_m2": spread[1]}

    asked, rows = _doubles(queries.select("query_id", *ASKING), *ASKING), _doubles(items.select("item_id", *OWN), *OWN)
    parts = by_blocks(asked, rows, MEET, run, "query_id long, n long, photo double, title double, photo_m2 double, title_m2 double", known)
    n, out = F.sum("n"), [F.sum("n").alias("n")]
    for side in SIDES:
        mean = F.sum(F.col("n") * F.col(side)) / n
        squares = F.greatest(F.sum(F.col(f"{side}_m2") + F.col("n") * F.col(side) * F.col(side)) - n * mean * mean, F.lit(0.0))
        out += [mean.alias(f"{side}_mean"), F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0).alias(f"{side}_dev")]
    return parts.groupBy("query_id").agg(*out)


def _with_moments(queries: DataFrame, items: DataFrame, known: Shape) -> DataFrame:
    """``queries`` plus mean and sample deviation of each query's scores on each side; where all are equal they count 0."""
    got = moments(queries, items, known).drop("n")
    for side in SIDES:
        got = got.withColumn(f"{side}_dev", F.when(F.col(f"{side}_dev") > 1e-9, F.col(f"{side}_dev")).otherwise(float("inf")))
    return queries.join(got, "query_id")


def _standard(block: Block, side: str, scores: np.ndarray) -> np.ndarray:
    return (scores - block[f"{side}_mean"][:, None]) / block[f"{side}_dev"][:, None]


def _raw(block: Block, batch: Block) -> dict[str, np.ndarray]:
    """Scores of all queries of the block with the batch's items, by side."""
    return {s: np.round(block[f"{s}_query"] @ batch[f"{s}_vector"].T, DIGITS) for s in SIDES}


def _blended(block: Block, raw: dict[str, np.ndarray], w: float) -> np.ndarray:
    return np.round(w * _standard(block, "photo", raw["photo"]) + (1 - w) * _standard(block, "title", raw["title"]), DIGITS)


def _with_targets(queries: DataFrame, items: DataFrame, known: Shape, columns: list[str], *more: str) -> DataFrame:
    """Queries with the vectors of their target and all moments."""
    own = items.select(F.col("item_id").alias("target_id"), *[F.col(v).alias(t) for v, t in zip(OWN, TARGETS, strict=True)], *more)
    asked = _doubles(queries.select("query_id", "target_id", *ASKING, *columns).join(own, "target_id"), *ASKING, *TARGETS)
    return _with_moments(asked, items, known)


def _own(block: Block) -> dict[str, np.ndarray]:
    """Standard scores of each query's target, as columns."""
    return {s: _standard(block, s, np.round((block[f"{s}_query"] * block[f"{s}_target"]).sum(axis=1), DIGITS)[:, None]) for s in SIDES}


def _others(block: Block, batch: Block) -> np.ndarray:
    return batch["item_id"][None, :] != block["target_id"][:, None]


def search(queries: DataFrame, items: DataFrame, k: int = 20, w: float = BLEND) -> DataFrame:
    """``query_id, item_id, score, rank``: the best items of each query.

    Queries may have ``mode`` (blend, photo or title), ``limit`` (1 to 100, else ``k``) and the filters ``color`` and
    ``category``; filters ask for ``color``, ``category`` and ``category_l1`` of items, a null filter keeps all.
    """
    extra = [c for c in ("mode", "color", "category") if c in queries.columns]
    most = F.least(F.greatest(F.coalesce("limit", F.lit(k)), F.lit(1)), F.lit(100)) if "limit" in queries.columns else F.lit(k)
    known = shape(queries, items, OWN)
    asked = _with_moments(_doubles(queries.select("query_id", *ASKING, *extra, most.cast("long").alias("most")), *ASKING), items, known)
    rows = _doubles(items.select("item_id", *OWN, *facets(queries)), *OWN)
    filtered = bool({"color", "category"} & set(extra))

    def run(block: Block, batch: Block) -> dict[str, np.ndarray]:
        best = Best(block["most"])
        for part in item_blocks(batch):
            raw, ids = _raw(block, part), part["item_id"]
            scores = _blended(block, raw, w)
            if "mode" in block:
                for side in SIDES:
                    alone = block["mode"] == side
                    scores[alone] = raw[side][alone]
            if filtered:
                masked(scores, block, part)
            best.offer(ids, scores)
        return best.rows(block["query_id"], most=block["most"])

    found = by_blocks(asked, rows, MEET, run, "query_id long, item_id long, score double, most long", known)
    return top_k(found, F.col("most"), ["query_id"], best_first(item="item_id")).drop("most")


def weight_ranks(queries: DataFrame, items: DataFrame, weights: list[float]) -> DataFrame:
    """``query_id, w, rank`` of each query's ``target_id`` for every weight; items that score as much count against it.

    Item minus target is linear in the weight, so an item beats the target on one run of the ordered weights: it adds 1
    where its run begins and takes 1 away behind it, and running sums give the counts of all weights at once. Items that
    come as near to the target as rounding, at some weight, are compared weight by weight; those below it at both ends of
    the weights are below it at all.
    """
    grid = np.array(sorted(set(weights)), float)
    known, m = shape(queries, items, OWN), len(grid)

    def run(block: Block, batch: Block) -> dict[str, np.ndarray]:
        own, q = _own(block), len(block["query_id"])
        least = np.round(grid * own["photo"] + (1 - grid) * own["title"], DIGITS)
        turns, exact = np.zeros((q, m + 1)), np.zeros((q, m), np.int64)
        for part in item_blocks(batch):
            raw, other = _raw(block, part), _others(block, part)
            photo, title = (_standard(block, s, raw[s]) for s in SIDES)
            up_photo, up_title = photo - own["photo"], title - own["title"]
            ends = [w * up_photo + (1 - w) * up_title for w in (grid[0], grid[-1])]
            i, j = np.nonzero((np.maximum(*ends) > -2 * NEAR) & other)  # a line is nowhere higher than at one of its ends
            at_0 = up_title[i, j]
            slope = up_photo[i, j] - at_0
            with np.errstate(divide="ignore", invalid="ignore"):
                cut = np.where(slope != 0, -at_0 / slope, np.where(at_0 >= 0, -np.inf, np.inf))
            k = np.searchsorted(grid, cut)
            near = np.zeros(k.shape, bool)
            for beside in (np.minimum(k, m - 1), np.maximum(k - 1, 0)):
                near |= np.abs(at_0 + grid[beside] * slope) < NEAR
            sure, rising = ~near, slope >= 0
            first = i * (m + 1)
            turns += np.bincount((first + k)[sure & rising], minlength=turns.size).reshape(turns.shape)
            turns -= np.bincount((first + k)[sure & ~rising], minlength=turns.size).reshape(turns.shape)
            turns[:, 0] += np.bincount(i[sure & ~rising], minlength=q)
            i, j = i[near], j[near]
            if len(i):
                scores = np.round(grid * photo[i, j][:, None] + (1 - grid) * title[i, j][:, None], DIGITS)
                np.add.at(exact, i, scores >= least[i])
        n = np.cumsum(turns[:, :m], axis=1).astype(np.int64) + exact
        return {"query_id": np.repeat(block["query_id"], m), "w": np.tile(grid, q), "n": n.ravel()}

    counted = by_blocks(_with_targets(queries, items, known, []), _doubles(items.select("item_id", *OWN), *OWN), MEET_TARGETS, run, "query_id long, w double, n long", known)
    return counted.groupBy("query_id", "w").agg((F.sum("n") + 1).cast("long").alias("rank"))


def boost_ranks(queries: DataFrame, items: DataFrame, boosts: list[float], w: float = BLEND) -> DataFrame:
    """``query_id, boost, rank`` of targets where items of a colour in ``asked`` (array) gain ``boost``.

    An infinite boost is a hard filter: other items go, and a target of another colour has a null rank.
    """

    def run(block: Block, batch: Block) -> dict[str, np.ndarray]:
        own, ids = _own(block), block["query_id"]
        base = np.round(w * own["photo"] + (1 - w) * own["title"], DIGITS)
        wanted = [set(a) if a is not None else set() for a in block["asked"]]
        hit = np.array([c in a for c, a in zip(block["target_color"], wanted, strict=True)])[:, None]
        bar = np.array([(base if np.isinf(b) else np.round(base + b * hit, DIGITS))[:, 0] for b in boosts])
        n = np.zeros((len(boosts), len(ids)), np.int64)
        for part in item_blocks(batch):
            scores, other = _blended(block, _raw(block, part), w), _others(block, part)
            code, names = pd.factorize(part["color"])
            match = np.array([[*(c in a for c in names), False] for a in wanted])[:, code]  # a null colour has code -1
            scores[~other] = -np.inf
            i, at = np.nonzero(scores >= bar.min(axis=0)[:, None])  # all that can count without a boost
            plain = ~match[i, at]
            i_match, at_match = np.nonzero(match)
            boosted = scores[i_match, at_match]
            for j, b in enumerate(boosts):
                if not np.isinf(b):
                    n[j] += np.bincount(i[plain & (scores[i, at] >= bar[j][i])], minlength=len(ids))
                gain = boosted if np.isinf(b) else np.round(boosted + b, DIGITS)
                n[j] += np.bincount(i_match[gain >= bar[j][i_match]], minlength=len(ids))
        for j, b in enumerate(boosts):
            if np.isinf(b):
                n[j][~hit[:, 0]] = -1
        return {"query_id": np.tile(ids, len(boosts)), "boost": np.repeat(boosts, len(ids)), "n": n.ravel()}

    known = shape(queries, items, OWN)
    asked = _with_targets(queries, items, known, ["asked"], F.col("color").alias("target_color"))
    counted = by_blocks(asked, _doubles(items.select("item_id", *OWN, "color"), *OWN), MEET_TARGETS, run, "query_id long, boost double, n long", known)
    total = counted.groupBy("query_id", "boost").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return total.select("query_id", "boost", F.when(F.col("least") >= 0, (F.col("n") + 1).cast("long")).alias("rank"))
