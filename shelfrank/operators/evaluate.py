"""Search quality: judged queries, targets, slices and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import small
from .ranking import first_of

#: Bytes of a query's text in a broadcast, about.
TEXT_BYTES = 256


def test_set(examples: DataFrame, strict: tuple[str, ...] = ("E",), lenient: tuple[str, ...] = ("E", "S"), order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``queries(query_id, query)``, the first row of each id, and ``truth(relevance, query, product_id)``, keyed by the query's text.

    ``examples(query_id, query, product_id, esci_label, seq)``; two ids of one text share their right answers.
    """
    queries = first_of(examples.where("query_id is not null and query is not null"), ["query_id"], [F.col(order)]).select("query_id", "query")
    label = F.col("esci_label")
    levels = F.array_compact(F.array(F.when(label.isin(*strict), "strict"), F.when(label.isin(*lenient), "lenient")))
    truth = examples.where("query is not null").select(F.explode(levels).alias("relevance"), "query", "product_id").distinct()
    return queries, truth


def truth_by_id(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """``relevance, query_id, doc_id``: the right answers of each query's text, as ``judged_metrics`` takes them."""
    return queries.join(truth, "query").select("relevance", "query_id", F.col("product_id").alias("doc_id"))


def answer_counts(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """``relevance, query_id, answers``: counted once for each text, then looked up; no list of each id's answers is made."""
    per_text = truth.groupBy("relevance", "query").agg(F.count("*").alias("answers"))
    return queries.select("query_id", "query").join(small(per_text, TEXT_BYTES), "query").select("relevance", "query_id", "answers")


def judged_metrics(stages: DataFrame, judgements: DataFrame, ks: tuple[int, ...] = (1, 5, 10), mrr_k: int = 10) -> DataFrame:
    """Hits@k and MRR per ``stage`` and ``relevance``; a judged query without results counts 0.

    ``stages(stage, query_id, doc_id, rank)``, ``judgements(relevance, query_id, doc_id)``.
    """
    hits = stages.join(judgements, ["query_id", "doc_id"]).select("stage", "relevance", "query_id", "rank")
    return hit_metrics(stages, judgements.select("relevance", "query_id").distinct(), hits, ks, mrr_k)


def hit_metrics(stages: DataFrame, judged: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10), mrr_k: int = 10) -> DataFrame:
    """As ``judged_metrics``, from ``judged(relevance, query_id)`` and the ``hits(stage, relevance, query_id, rank)`` that are right."""
    best = hits.groupBy("stage", "relevance", "query_id").agg(F.min("rank").alias("first"))
    every = judged.crossJoin(F.broadcast(stages.select("stage").distinct()))  # a handful of stages
    first = every.join(best, ["stage", "relevance", "query_id"], "left")
    share = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hits_{k}") for k in ks]
    mrr = F.round(F.avg(F.when(F.col("first") <= mrr_k, 1 / F.col("first")).otherwise(0.0)), 6).alias("mrr")
    return first.groupBy("stage", "relevance").agg(F.count("*").alias("n"), *share, mrr)


def source_metrics(stages: DataFrame, strict: DataFrame, documents: DataFrame) -> DataFrame:
    """Metrics at both levels without a list of lenient answers: a result is looked up by its own keys.

    ``strict(query_id, doc_id, source)`` are the strict answers; lenient ones are also the documents that are ``good`` in
    ``documents(doc_id, source, good)`` and of a source of a strict answer. Every result is joined to one document, to
    at most one strict answer and to at most one source of its query, so rows do not multiply.
    """
    own = strict.select("query_id", "doc_id", F.lit(True).alias("_own")).distinct()
    sources = strict.select("query_id", "source", F.lit(True).alias("_near")).distinct()
    seen = stages.select("stage", "query_id", "doc_id", "rank").join(documents, "doc_id", "left").join(own, ["query_id", "doc_id"], "left").join(sources, ["query_id", "source"], "left")
    lenient = F.coalesce("_own", F.lit(False)) | (F.coalesce("good", F.lit(False)) & F.coalesce("_near", F.lit(False)))
    levels = F.array_compact(F.array(F.when(F.col("_own"), "strict"), F.when(lenient, "lenient")))
    hits = seen.select("stage", F.explode(levels).alias("relevance"), "query_id", "rank")
    judged = strict.select("query_id").distinct().select(F.explode(F.array(F.lit("strict"), F.lit("lenient"))).alias("relevance"), "query_id")
    return hit_metrics(stages, judged, hits)


def rank_metrics(rank: Column) -> list[Column]:
    """R@1, R@10 and MRR@10 from the rank of one right answer; null is absent."""
    at = lambda k: F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), 6).alias(f"r_{k}")
    return [F.count("*").alias("n"), at(1), at(10), F.round(F.avg(F.when(rank <= 10, 1 / rank).otherwise(0.0)), 6).alias("mrr")]


def sliced(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics by ``keys`` and (generator, source) with style ``all``, and by (generator, source, style), in one pass."""
    full = [*keys, "generator", "source", "style"]
    return ranks.groupingSets([full[:-1], full], *full).agg(*rank_metrics(F.col("rank"))).withColumn("style", F.coalesce("style", F.lit("all")))


def split_half(ids: DataFrame, seed: int = 0) -> DataFrame:
    """``id, part``: the half of the distinct ids with the smallest seeded digests is ``tune``, the rest ``test``.

    The digest of rank n/2 is found by counting digests by leading digits, so no single task sorts all ids.
    """
    marked = ids.select("id").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
    by = marked.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n"))
    upto = by.withColumn("before", F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))  # at most 65,536 rows
    half = by.agg(F.floor(F.sum("n") / 2).alias("half"))
    rows = marked.withColumn("p", F.substring("h", 1, 4)).join(F.broadcast(upto.select("p", F.coalesce("before", F.lit(0)).alias("before"))), "p").crossJoin(F.broadcast(half))
    place = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("h", "id"))
    return rows.select("id", F.when(place <= F.col("half"), "tune").otherwise("test").alias("part"))


def sweep(metrics: DataFrame, value: str = "w") -> DataFrame:
    """Best sweep value per method on the tune half (mean over sources, smaller value on ties), with its test means.

    ``metrics(method, <value>, part, source, mrr)``.
    """
    mean = metrics.groupBy("method", value, "part").agg(F.round(F.avg("mrr"), 6).alias("mrr"))
    best = first_of(mean.where("part = 'tune'"), ["method"], [F.col("mrr").desc(), F.col(value)]).select("method", value, F.col("mrr").alias("tune_mrr"))
    return best.join(mean.where("part = 'test'").select("method", value, F.col("mrr").alias("test_mrr")), ["method", value], "left")


def sample_ids(rows: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``n`` rows by seeded digest."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)
