"""Reranking by document: the same scores as pair by pair, each text shipped once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import rerank


@pytest.fixture(scope="module")
def pools(spark):
    titles = spark.createDataFrame([(i, None if i == 4 else f"Red lamp number{i} " + "x " * i, "m") for i in range(12)], "doc_id long, title string, merchant string")
    queries = spark.createDataFrame([(q, None if q == 3 else f"the red number{q} number{q + 1} lamp") for q in range(30)], "query_id long, query string")
    pairs = [(q, d) for q in range(30) for d in (1, q % 12, 99) if q % 12 != 1 or d != 1] + [(1, 1)]
    return spark.createDataFrame(sorted(set(pairs)), "query_id long, doc_id long"), queries, titles


def plain(pools, k):
    pairs, queries, titles = (x.collect() for x in pools)
    words = lambda t: {w for w in (t or "").lower().split() if w not in ("the", "a", "an")}
    q, t, out = {r.query_id: words(r.query) for r in queries}, {r.doc_id: words(r.title) for r in titles}, {}
    for r in pairs:
        own = q[r.query_id]
        out.setdefault(r.query_id, []).append((-round(len(own & t.get(r.doc_id, set())) / len(own), 6) if own else 0.0, r.doc_id))
    return sorted((i, d, -s + 0.0, n + 1) for i, found in out.items() for n, (s, d) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("most", [1000, 4])
def test_scores_equal_pair_by_pair(pools, monkeypatch, most):
    """Also where documents in more than four pools are split."""
    monkeypatch.setattr(rerank, "MOST_ASKED", most)
    assert sorted(tuple(r) for r in rerank.rerank(*pools, k=2).collect()) == plain(pools, 2)


def test_each_text_is_shipped_once(pools, monkeypatch):
    got = rerank.by_document(*pools).collect()
    assert sorted(r.doc_id for r in got) == [*range(12), 99] and sum(len(r.asked) for r in got) == pools[0].count()
    monkeypatch.setattr(rerank, "MOST_ASKED", 10)
    split = rerank.by_document(*pools).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.size("asked")).alias("most")).collect()
    assert {r.doc_id: r.n for r in split if r.n > 1}.keys() == {1, 99} and max(r.most for r in split) < 25


def test_a_model_scores_all_queries_of_a_title(pools):
    def model(queries, title):
        assert all(isinstance(q, str) or q is None for q in queries)
        return [len(title) + len(q or "") for q in queries]

    best = {r.query_id: (r.doc_id, r.score) for r in rerank.rerank(*pools, k=1, scorer=model).collect()}
    lengths = {r.doc_id: len(r.title or "") for r in pools[2].collect()}
    assert all(lengths.get(d, 0) + len(f"the red number{q} number{q + 1} lamp" if q != 3 else "") == s for q, (d, s) in best.items())
    assert rerank.rerank(pools[0].where("false"), *pools[1:], scorer=model).count() == 0
