"""Forms of queries that do the whole job, on inputs where a cut form gives something else."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def late(spark, tmp_path_factory):
    """Passages far behind the first 120 characters and eight words; documents 1 and 2 begin alike."""
    d, start = tmp_path_factory.mktemp("late"), "lorem ipsum dolor sit amet " * 6
    passage = "one two three four five six seven eight nine brass lamp"
    docs = [(1, start + "one two three four five six seven eight nine iron"), (2, start + "and then " + passage), (3, "one two three four five six seven eight")]
    spark.createDataFrame([(i, t, "src1") for i, t in docs], "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_whole_texts_are_asked_scored_and_compared(spark, late):
    import __spark_entry__ as entry

    run = lambda name: [r.doc_id for r in entry.queries()[name](spark, late).orderBy("rank").collect()]
    best = entry.queries()["r5_rerank_whole"](spark, late).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in best] == [(2, 1.0), (1, round(9 / 11, 6)), (3, round(8 / 11, 6))]
    assert run("r2_bm25_search_whole")[0] == 2  # by the words behind the eighth
    assert sorted(run("r21_result_dedup_whole")) == [1, 2, 3]
    near = entry.queries()["r6_hybrid_search_whole"](spark, late).where((F.col("stage") == "dense") & (F.col("rank") == 1)).first()
    assert near.doc_id in (2, 3) and near.score > 0
    assert entry.queries()["x1_embedded_titles"](spark, late).count() == 3


def test_all_boosts_of_the_reference(spark, data):
    import __spark_entry__ as entry

    every = {r.boost: r.mrr for r in entry.queries()["r18_color_boost_all"](spark, data).collect()}
    assert set(every) == {"0.00", "0.25", "0.50", "0.75", "1.00", "1.50", "2.00", "3.00", "filter"}


def test_hard_filter_can_be_chosen(spark, monkeypatch):
    """Where targets are found only among items of their colour, the filter is the best of all nine."""
    from shelfrank.plans import retrieval

    ids = spark.range(0, 200, 10).select(F.col("id").alias("query_id"))
    monkeypatch.setattr(retrieval, "target_queries", lambda *_: ids.select("query_id", F.col("query_id").alias("target_id"), F.lit("text").alias("source")))
    monkeypatch.setattr(retrieval, "_boosted", lambda spark, d, boosts: ids.crossJoin(spark.createDataFrame([(b, 1 if b == float("inf") else 4) for b in boosts], "boost double, rank long")))
    best = retrieval.QUERIES["e10_boost_choice_all"](spark, "").first()
    assert (best.boost, best.tune_mrr, best.test_mrr) == (float("inf"), 1.0, 1.0)


def test_weight_is_chosen_for_each_method(spark, data):
    import __spark_entry__ as entry

    got = {r.method: r for r in entry.queries()["e9_weight_choice_both"](spark, data).collect()}
    assert set(got) == {"weighted_rrf", "blend"} and all(r.tune_mrr > 0 and r.test_mrr is not None for r in got.values())
