"""Reranking candidate pools with a pair scorer, and the hybrid pipeline.

Candidates are grouped by document, so a text is shipped and prepared once, however many queries have it in their pool;
a document in very many pools is split by query. Texts of other documents stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.scratch import BROADCAST_BYTES, materialize, small
from . import fusion
from .ranking import best_first, top_k, union_by

#: Queries that are scored with one shipped text.
MOST_ASKED = 1000


class Scorer(NamedTuple):
    """A pair scorer of expressions: what is made of a query and of a title, once each, and the score of the two."""

    query: Callable[[Column], Column]
    title: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]


def _distinct(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def _share(q: Column, t: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q)), F.lit(0.0)), 6)


#: Default: share of the query's distinct tokens that the title has.
OVERLAP = Scorer(_distinct, _distinct, _share)
#: A model that scores all queries of a title at once: ``(queries, title) -> scores``.
Model = Callable[[list[str], str], Sequence[float]]


def by_document(candidates: DataFrame, queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``doc_id, asked, title``: each candidate's title once, with ``(query_id, query)`` of all that have it in their pool.

    ``candidates`` should be saved: they are read for their documents, and for those in very many pools. An unknown id has
    the title ``''``.
    """
    pairs = candidates.select("query_id", "doc_id")
    known = titles.join(small(pairs.select("doc_id").distinct(), 32, pairs), "doc_id", "left_semi").select("doc_id", "title")
    heavy = pairs.groupBy("doc_id").agg(F.ceil(F.count("*") / MOST_ASKED).cast("int").alias("_parts")).where("_parts > 1")
    n = heavy.count()
    asked, part = pairs.join(queries, "query_id"), F.lit(0)
    if n:
        few = F.broadcast(heavy) if n * 32 <= BROADCAST_BYTES else heavy
        asked, part = asked.join(few, "doc_id", "left"), F.pmod(F.xxhash64("query_id"), F.coalesce("_parts", F.lit(1))).cast("int")
    pools = asked.groupBy("doc_id", part.alias("_part")).agg(F.collect_list(F.struct("query_id", "query")).alias("asked"))
    return pools.join(known, "doc_id", "left").select("doc_id", "asked", F.coalesce("title", F.lit("")).alias("title"))


def _modelled(pools: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, asked, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                scores = model([a["query"] for a in asked], title)
                out += [(a["query_id"], doc, float(s)) for a, s in zip(asked, scores, strict=True)]
            kinds = [batch.schema.field("asked").type.value_type.field("query_id").type, batch.schema.field("doc_id").type, pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "doc_id", "score"])

    query_kind = pools.schema["asked"].dataType.elementType["query_id"].dataType.simpleString()
    return pools.select("doc_id", "asked", "title").mapInArrow(run, f"query_id {query_kind}, doc_id {pools.schema['doc_id'].dataType.simpleString()}, score double")


def rerank(candidates: DataFrame, queries: DataFrame, titles: DataFrame, k: int = 10, scorer: Scorer | Model = OVERLAP) -> DataFrame:
    """Best ``k`` of each pool by ``scorer``; an unknown id has the title ``''``."""
    saved = materialize(candidates.select("query_id", "doc_id"), "candidates")
    if isinstance(scorer, Scorer):
        ready = queries.select("query_id", scorer.query(F.col("query")).alias("query"))
        pools = by_document(saved, ready, titles).withColumn("title", scorer.title(F.col("title")))
        each = F.explode(F.transform("asked", lambda a: F.struct(a["query_id"].alias("query_id"), scorer.score(a["query"], F.col("title")).alias("score"))))
        scored = pools.select("doc_id", each.alias("x")).select("x.query_id", "doc_id", "x.score")
    else:
        scored = _modelled(by_document(saved, queries.select("query_id", "query"), titles), scorer)
    return top_k(scored, k, ["query_id"], best_first()).select("query_id", "doc_id", "score", "rank")


def hybrid(dense: DataFrame, lexical: DataFrame, queries: DataFrame, titles: DataFrame, k: int = 10) -> DataFrame:
    """Every stage's list: ``query_id, stage, doc_id, rank, score``."""
    fused = fusion.rrf(dense, lexical)
    last = rerank(fused, queries, titles, k)
    lists = (("dense", dense), ("bm25", lexical), ("rrf", fused), ("rerank", last))
    return union_by(["query_id"], *[df.select("query_id", F.lit(name).alias("stage"), "doc_id", "rank", "score") for name, df in lists])
