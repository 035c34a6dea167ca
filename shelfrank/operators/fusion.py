"""Fusing ranked lists and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import best_first, top_k, union_by

RRF_K, BLEND = 60, 0.7


def rrf(*lists: DataFrame, k: int = RRF_K, top: int = 50) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, doc_id, rank)`` lists.

    Ties go to the item that the earlier list brought in, then to its rank there.
    """
    each = [x.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(n).alias("list_no")) for n, x in enumerate(lists)]
    every = union_by(["query_id"], *each)
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    return top_k(fused, top, ["query_id"], [F.col("score").desc(), F.col("first").asc()]).select("query_id", "doc_id", "score", "rank")


def z_score(score: Column, by: str = "query_id") -> Column:
    """Standard scores within each query over all its items; 0 where all are equal."""
    w = Window.partitionBy(by)
    return F.coalesce(F.try_divide(score - F.avg(score).over(w), F.stddev_samp(score).over(w)), F.lit(0.0))


def blend(scores: DataFrame, w: float | Column = BLEND) -> DataFrame:
    """``photo`` and ``title`` scores of all items to one ``score``; statistics come before any filter."""
    return scores.withColumn("score", F.round(w * z_score(F.col("photo")) + (1 - w) * z_score(F.col("title")), 6))


def blended_search(scores: DataFrame, k: int = 20, keep: Column | None = None, w: float = BLEND) -> DataFrame:
    mixed = blend(scores, w)
    return top_k(mixed if keep is None else mixed.where(keep), k, ["query_id"], best_first(item="item_id"))


def by_mode(scores: DataFrame, w: float = BLEND) -> DataFrame:
    """Score by each query's ``mode`` (blend, photo or title), cut to its ``limit``."""
    mixed = blend(scores, w).withColumn("score", F.when(F.col("mode") == "blend", F.col("score")).when(F.col("mode") == "photo", F.col("photo")).otherwise(F.col("title")))
    limit = F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(F.col("limit"), F.lit(20))))
    return top_k(mixed, limit, ["query_id"], best_first(item="item_id"))


def weighted_rrf(photo: DataFrame, title: DataFrame, weights: list[float], k: int = RRF_K) -> DataFrame:
    """``query_id, w, item_id, score`` from two ``(query_id, item_id, rank)`` lists; an absent side gives 0."""
    both = photo.select("query_id", "item_id", F.col("rank").alias("p")).join(title.select("query_id", "item_id", F.col("rank").alias("t")), ["query_id", "item_id"], "full_outer")
    term = lambda r: F.coalesce(1 / (F.lit(k) + F.col(r)), F.lit(0.0))
    spread = both.withColumn("w", F.explode(F.array(*[F.lit(x) for x in weights])))
    return spread.select("query_id", "w", "item_id", F.round(F.col("w") * term("p") + (1 - F.col("w")) * term("t"), 9).alias("score"))


def weighted_rrf_ranks(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """``query_id, w, rank`` of targets by counting scores at least as high; absent or zero gives null."""
    own = scores.join(targets, "query_id").where((F.col("item_id") == F.col("target_id")) & (F.col("score") > 0)).select("query_id", "w", F.col("score").alias("own"))
    n = scores.join(own, ["query_id", "w"]).where("score >= own").groupBy("query_id", "w").agg(F.count("*").alias("rank"))
    every = targets.select("query_id").crossJoin(F.broadcast(scores.select("w").distinct()))  # a handful of weights
    return every.join(n, ["query_id", "w"], "left")


def side_tags(results: DataFrame, photo: DataFrame, title: DataFrame, k: int = 100) -> DataFrame:
    """``sides``: which side alone has a result in its own top ``k``."""
    mark = lambda df, n: df.where(F.col("rank") <= k).select("query_id", "item_id", F.lit(True).alias(n))
    joined = results.join(mark(photo, "_p"), ["query_id", "item_id"], "left").join(mark(title, "_t"), ["query_id", "item_id"], "left")
    return joined.withColumn("sides", F.array_compact(F.array(F.when(F.col("_t"), "title"), F.when(F.col("_p"), "photo")))).drop("_p", "_t")


def stage_trace(stages: DataFrame, names: list[str]) -> DataFrame:
    """One row per result with its rank at each stage."""
    return stages.groupBy("query_id", "doc_id").pivot("stage", names).agg(F.min("rank"))


def result_dedup(results: DataFrame) -> DataFrame:
    """Best-ranked row per lower-case title and merchant."""
    return top_k(results.withColumn("_t", F.lower("title")), 1, ["query_id", "_t", "merchant"], [F.col("rank")], "_n").drop("_t", "_n")
