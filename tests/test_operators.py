"""Hand-worked cases, invariants and plans."""

import random

import pytest
from pyspark.sql import functions as F

from shelfrank.functions import colors
from shelfrank.functions import text as T
from shelfrank.functions.vectors import dot
from shelfrank.operators import blend, catalog, dense, enrich, evaluate, fusion, kernel, lexical, ranking
from shelfrank.sources import artifacts, tables


def each(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_tokenize(spark):
    assert each(spark, T.tokenize, ["1/2in The drill", "red red", None, "the a an"]) == [["1", "2in", "drill"], ["red", "red"], [], []]


def test_titles(spark):
    got = each(spark, T.clean_title, [" Amazon.com: Lamp - Etsy ", "Amazon.com : Mug | Etsy", "Amazon.com:Lamp", " \tCup\t", None])
    assert got == ["Lamp", "Mug", "Amazon.com:Lamp", "Cup", ""]


def test_small_text_functions(spark):
    assert each(spark, T.slug, ["BAAI/bge-small-en-v1.5"]) == ["baai-bge-small-en-v1-5"]
    assert each(spark, T.taxonomy_level2, ["1 - Animals", "3 - Animals > Pets", "5 - A > B > C", "# note"]) == [None, "Animals > Pets", None, None]
    assert each(spark, T.clean_description, [None, "", "NA", "a  b\n" * 300])[:3] == ["(none)"] * 3
    assert len(each(spark, T.clean_description, ["a  b\n" * 300])[0]) == 600
    assert each(spark, T.clean_price, [None, float("nan"), 0.0, -1.0, 100000.0, 100000.01], "double") == [None, None, None, None, 100000.0, None]
    assert each(spark, T.json_part, ['Sure! {"a":"b"} ok', "none", None]) == ['{"a":"b"}', None, None]
    assert each(spark, lambda c: T.render("T: {t}! {u}", {"t": c}), ["x", None]) == ["T: x! {u}", "T: ! {u}"]


def test_colors(spark):
    raw = ["Dusty Rose", "navy blue", "black and white", "black/charcoal/onyx", "hot pink", "red, crimson", "orchid"]
    assert each(spark, colors.normalize_color, raw) == ["pink", "blue", "multicolor", "multicolor", "pink", "red", None]
    asked = ["red summer dress", "rose gold ring", "coffee table", "navy and white shoes", "off-white lamp", None]
    assert each(spark, colors.query_colors, asked) == [["red"], [], [], ["blue", "white"], ["white"], []]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "red lamp"), (2, "red lamp"), (3, "blue"), (4, None)], "doc_id long, text string")
    index = lexical.build_index(docs)
    queries = spark.createDataFrame([(1, "the a"), (2, "unknown"), (3, "red"), (4, "red red")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in lexical.search(index, queries, 50).collect()}
    assert sorted(got) == [(3, 1), (3, 2), (4, 1), (4, 2)]
    assert got[3, 1][1] == 1 and got[3, 2][1] == 2 and got[4, 1][0] == pytest.approx(2 * got[3, 1][0], abs=2e-6)


def test_bm25_in_ranges_and_buckets(spark, monkeypatch):
    """Ranges that cannot reach the best are passed over, in many buckets, with and without a broadcast; nothing is lost."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("red", "lamp", "rug", f"w{rng.randrange(40)}")) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    docs = spark.createDataFrame([(i, "Rare Lamp lamp. LAMP" if i < 3 else None if i == 9 else t) for i, t in enumerate(texts)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare lamp"), (2, "red the w3 w3"), (3, "nothing here"), (4, None), (5, "lamp")], "query_id long, query string")
    want = None
    for ranges, buckets, most in ((1, 1 << 30, 1 << 24), (7, 1 << 30, 1 << 24), (30, 50, 1 << 24), (30, 50, 0)):
        monkeypatch.setattr(lexical, "LEAST_DOCS", -(-300 // ranges))
        monkeypatch.setattr(lexical, "RANGES", ranges)
        monkeypatch.setattr(lexical, "BUCKET_POSTINGS", buckets)
        monkeypatch.setattr(lexical, "BROADCAST_BYTES", most)
        index = lexical.build_index(docs)
        assert index.stats.first()["ranges"] >= ranges
        for k in (2, 50):
            got = sorted(tuple(r) for r in lexical.search(index, queries, k).collect())
            if ranges == 1:
                want = (want or {}) | {k: got}
            assert got == want[k]
    terms = lexical.query_terms(queries).join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    met = index.blocks.join(terms, "term").select("query_id", "range", "n", "w", "marks")
    assert lexical.hopeless(met, 1).where("query_id = 1").count() > 10 and len(want[2]) == 6


def test_queries_of_few_terms_make_no_index(spark, tmp_path, monkeypatch):
    """The texts are read once for the queries' terms alone; rows are those of a search over the index of all terms."""
    from shelfrank.plans import retrieval

    rng, odd = random.Random(8), [None, "", "the a an", "Größe-LAMP\u00a0lamp", "\u0130Red's 1/2in lamp", "THE lamp the"]
    texts = odd + [" ".join(rng.choice(("red", "lamp", "the", f"w{rng.randrange(60)}")) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    docs = spark.createDataFrame([(i // 2 if i < 6 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "Lamp lamp red"), (2, "the W3 w3 w4 gr"), (3, "nothing here"), (4, None), (5, "the"), (6, "1 2in s i")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries, index = retrieval.text_queries(spark, str(tmp_path)), lexical.build_index(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = {k: rows(lexical.search(index, queries, k)) for k in (3, 50)}
    made, write = [], lexical.write_index
    monkeypatch.setattr(lexical, "write_index", lambda *a, **b: made.append(a) or write(*a, **b))
    assert {k: rows(retrieval.bm25(spark, str(tmp_path), k)) for k in want} == want and not made
    with monkeypatch.context() as patch:  # more terms than a broadcast holds
        patch.setattr(lexical, "BROADCAST_BYTES", 0)
        assert rows(retrieval.bm25(spark, str(tmp_path))) == want[50] and len(made) == 1
    assert rows(retrieval.bm25(spark, str(tmp_path))) == want[50] and len(made) == 1  # by the index that is there now
    assert lexical.scan(spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "0L AS total", "0L AS size", "CAST(array() AS array<struct<code:int,tf:int>>) AS posting").limit(0), [], queries).count() == 0


def test_scan_ranks_only_scores_above_a_bar(spark, tmp_path, monkeypatch):
    """Each range is a task of its own; rows are those without a bar, also where scores tie at it or where few texts match."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("red", "lamp", f"w{rng.randrange(9)}")) for _ in range(rng.randrange(1, 6))) for _ in range(600)] + ["rare lamp"]
    docs, terms = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["lamp", "rare", "red", "w3", "w4"]
    queries = spark.createDataFrame([(1, "Lamp red"), (2, "w3 w3 w4"), (3, "rare"), (4, "other")], "query_id long, query string")
    monkeypatch.setattr(lexical, "LEAST_DOCS", 16)
    lexical.write_matches(docs, f"{tmp_path}/m", terms)
    scan = lambda k: lexical.scan(spark.read.parquet(f"{tmp_path}/m"), terms, queries, k)
    rows = {k: sorted(map(tuple, scan(k).collect())) for k in (1, 3, 50)}
    plan = scan(3)._jdf.queryExecution().executedPlan().toString()
    assert "bar#" in plan and "38), REPARTITION_BY_NUM" in plan  # 601 documents, ranges of 16 at least
    monkeypatch.setattr(lexical, "BAR_PART", 1 << 20)
    assert {k: sorted(map(tuple, scan(k).collect())) for k in rows} == rows
    assert rows[50] == sorted(map(tuple, lexical.search(lexical.build_index(docs), queries, 50).collect()))


def test_bm25_plan_has_no_python_and_limits_early(spark, data):
    from shelfrank.plans import retrieval

    plan = retrieval.bm25(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "WindowGroupLimit" in plan


def test_rrf_ties_go_to_the_first_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 3)], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 10, 1), (1, 12, 3)], "query_id long, doc_id long, rank long")
    assert [r.doc_id for r in fusion.rrf(a, b).orderBy("rank").collect()] == [10, 11, 12]


def test_constant_side_gives_zero(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 0.1), (1, 2, 0.5, 0.3)], "query_id long, item_id long, photo double, title double")
    assert [r.item_id for r in fusion.blended_search(rows, 5).orderBy("rank").collect()] == [2, 1]


def every_pair(queries, rows, vector, own, name):
    """Scores of all pairs, on a small fixture only."""
    return rows.crossJoin(F.broadcast(queries)).select("query_id", "item_id", F.round(dot(F.col(own), F.col(vector)), 6).alias(name))


def test_kernel_equals_small_path(spark, data):
    from shelfrank.plans import retrieval

    q, i = retrieval.target_queries(spark, data), retrieval.items(spark, data)
    queries, rows = q.select("query_id", F.col("photo_query").alias("vector")), i.select("item_id", F.col("photo_vector").alias("item_vector"))
    targets = q.select("query_id", "target_id")
    slow = dense.target_ranks(every_pair(queries, rows, "vector", "item_vector", "score"), targets)
    fast = dense.target_ranks_at_scale(queries, rows, targets)
    assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, fast.collect()))


@pytest.mark.parametrize("block", [7, 4096])
def test_blend_kernel_equals_windowed_form(spark, data, monkeypatch, block):
    """Whatever the blocks of queries and the partitions of items."""
    from shelfrank.plans import retrieval

    monkeypatch.setattr(kernel, "QUERY_BLOCK", block)
    monkeypatch.setattr(kernel, "ITEM_BLOCK", block)
    monkeypatch.setattr(kernel, "LEAST_ITEMS", 12 * block)
    q, i = retrieval.target_queries(spark, data).where("query_id < 200"), retrieval.items(spark, data).repartition(5)
    fast = blend.search(q.select("query_id", "photo_query", "title_query"), i, 20)
    photo, title = (every_pair(q, i, f"{x}_query", f"{x}_vector", x) for x in ("photo", "title"))
    slow = fusion.blended_search(photo.join(title, ["query_id", "item_id"]), 20).select("query_id", "item_id", "score", "rank")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_all_weights_at_once_equal_weight_by_weight(spark):
    """Random items, exact copies of targets and items that tie with them at one weight; any order of weights."""
    import numpy as np

    rng = np.random.default_rng(7)
    photo, title = rng.integers(-2, 3, (90, 4)).astype(float), rng.integers(-2, 3, (90, 4)).astype(float)
    photo[60:70], title[60:70] = photo[:10], title[:10]
    title[70:80] = title[:10]
    i = spark.createDataFrame([(k, p.tolist(), t.tolist()) for k, (p, t) in enumerate(zip(photo, title, strict=True))], "item_id long, photo_vector array<double>, title_vector array<double>")
    asked = [(k, k, rng.integers(-2, 3, 4).astype(float), rng.integers(-2, 3, 4).astype(float)) for k in range(20)]
    q = spark.createDataFrame([(a, b, p.tolist(), t.tolist()) for a, b, p, t in asked], "query_id long, target_id long, photo_query array<double>, title_query array<double>")
    weights = [0.5, 0.0, 1.0, 0.1, 0.25, 1.5]
    z = lambda s: (s - s.mean()) / s.std(ddof=1) if s.std() > 1e-9 else s * 0
    want = {}
    for a, b, p, t in asked:
        zp, zt = z(np.round(photo @ p, 6)), z(np.round(title @ t, 6))
        for w in weights:
            s = np.round(w * zp + (1 - w) * zt, 6)
            want[a, w] = 1 + sum(s[j] >= s[b] for j in range(90) if j != b)
    assert {(r.query_id, r.w): r["rank"] for r in blend.weight_ranks(q, i, weights).collect()} == want


def test_vectors_that_take_no_part(spark, monkeypatch):
    """Null, ragged and unfinished vectors, as items, queries and targets; blocks of two vectors."""
    nan = float("nan")
    bad = [(10, None), (11, [1.0]), (12, [nan, 1.0]), (13, [None, 1.0]), (14, [float("inf"), 0.0]), (15, [1.0, 0.0, 0.0][:0])]
    good = [(k, [float(k), 1.0]) for k in range(5)]
    i = spark.createDataFrame(good + bad, "item_id long, item_vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [nan, 0.0])], "query_id long, vector array<double>")
    monkeypatch.setattr(kernel, "TILE_BYTES", 32)
    assert [(r.query_id, r.item_id) for r in dense.search(q, i, 3).orderBy("rank").collect()] == [(1, 4), (1, 3), (1, 2)]
    targets = spark.createDataFrame([(1, 3), (2, 3)], "query_id long, target_id long")
    assert [tuple(r) for r in dense.target_ranks_at_scale(q, i, targets).collect()] == [(1, 2)]
    assert dense.target_ranks_at_scale(q, i, targets.withColumn("target_id", F.lit(12).cast("long"))).count() == 0
    assert dense.search(q, i.where("item_id >= 10"), 3).where("item_id <> 11 and item_id <> 15").count() == 0 and dense.search(q.where("false"), i, 3).count() == 0


def test_blend_edges(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0], "red"), (2, [1.0, 0.0], [0.0, 1.0], "blue"), (3, [1.0, 0.0], [0.0, 1.0], None)]
    i = spark.createDataFrame(rows, "item_id long, photo_vector array<double>, title_vector array<double>, color string")
    i = i.withColumns({"category": F.lit("A > B"), "category_l1": F.lit("A")})
    q = spark.createDataFrame([(1, 1, [1.0, 0.0], [1.0, 0.0], ["blue"]), (2, 2, [1.0, 0.0], [1.0, 0.0], ["blue", "red"])], "query_id long, target_id long, photo_query array<double>, title_query array<double>, asked array<string>")
    plain = q.select("query_id", "photo_query", "title_query")
    found = {(r.query_id, r.item_id): r.score for r in blend.search(plain, i).collect()}
    assert found[1, 1] == pytest.approx(0.3 * 2 / 3**0.5, abs=1e-6) and len(found) == 6  # a constant side counts 0
    only = blend.search(plain.withColumn("color", F.lit("blue")).withColumn("category", F.lit("A")), i).collect()
    assert {(r.query_id, r.item_id, r.score) for r in only} == {(k, 2, found[k, 2]) for k in (1, 2)}
    assert blend.search(plain.where("false"), i).count() == 0 and blend.weight_ranks(q.where("false"), i, [0.5]).count() == 0
    ranks = {(r.query_id, r.boost): r["rank"] for r in blend.boost_ranks(q, i, [0.0, float("inf")]).collect()}
    assert ranks == {(1, 0.0): 1, (2, 0.0): 3, (1, float("inf")): None, (2, float("inf")): 2}
    weights = {(r.query_id, r.w): r["rank"] for r in blend.weight_ranks(q, i, [0.0, 1.0]).collect()}
    assert weights == {(1, 0.0): 1, (1, 1.0): 3, (2, 0.0): 3, (2, 1.0): 3}


def test_duplicate_vector_is_first_and_self_absent(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "item_id long, item_vector array<double>")
    queries = rows.where("item_id = 1").select(F.col("item_id").alias("query_id"), F.col("item_vector").alias("vector"))
    assert [r.item_id for r in dense.search(queries, rows, 5, exclude_self=True).orderBy("rank").collect()] == [2, 3]
    targets = spark.createDataFrame([(1, 1)], "query_id long, target_id long")
    assert dense.target_ranks_at_scale(queries, rows, targets).first()["rank"] == 2


def test_metrics_edges(spark):
    stages = spark.createDataFrame([("s", 1, 7, 2), ("s", 3, 9, 1)], "stage string, query_id long, doc_id long, rank long")
    judged = spark.createDataFrame([("strict", 1, 7), ("strict", 2, 5)], "relevance string, query_id long, doc_id long")
    row = evaluate.judged_metrics(stages, judged).first()
    assert (row.n, row.hits_1, row.hits_5, row.mrr) == (2, 0.0, 0.5, 0.25)


def test_queries_of_one_text_share_answers(spark):
    rows = [(1, "lamp", "a", "E", 0), (2, "lamp", "b", "S", 1), (2, None, "c", "E", 2), (3, "mug", "d", "C", 3), (1, "late", "e", "I", 4)]
    queries, truth = evaluate.test_set(spark.createDataFrame(rows, "query_id long, query string, product_id string, esci_label string, seq long"))
    assert sorted(map(tuple, queries.collect())) == [(1, "lamp"), (2, "lamp"), (3, "mug")]
    want = [("lenient", 1, "a"), ("lenient", 1, "b"), ("lenient", 2, "a"), ("lenient", 2, "b"), ("strict", 1, "a"), ("strict", 2, "a")]
    assert sorted(map(tuple, evaluate.truth_by_id(queries, truth).collect())) == want


def test_passages_are_found_like_substrings(spark):
    texts = ["x one two three four five six y", "one two  three four five six", "zone two three four five sixty", "short", None, "one two three four five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four five six"), (2, "short"), (3, None), (4, "ne two")], "query_id long, passage string")
    got = sorted(map(tuple, lexical.holding(docs, asked).select("query_id", "doc_id").collect()))
    assert got == sorted((q, i) for q, p in ((1, "one two three four five six"), (2, "short"), (4, "ne two")) for i, t in enumerate(texts) if t and p in t)


def test_union_keeps_groups_whole(spark):
    """Lists partitioned by the same key, merged unlike each other by adaptive execution."""
    lists = [spark.range(n).select((F.col("id") % 97).alias("query_id"), F.col("id").alias("doc_id")).groupBy("query_id").agg(F.max("doc_id").alias("m")) for n in (200, 300_000)]
    assert ranking.union_by(["query_id"], *lists).groupBy("query_id").count().count() == 97


def test_filters_of_exact_search(spark):
    i = spark.createDataFrame([(1, [1.0, 0.0], "red", "A > B", "A"), (2, [0.9, 0.0], "blue", "A > C", "A"), (3, [0.5, 0.0], None, "D > E", "D")], "item_id long, item_vector array<double>, color string, category string, category_l1 string")
    q = spark.createDataFrame([(1, [1.0, 0.0], None, "A"), (2, [1.0, 0.0], "blue", None), (3, [1.0, 0.0], None, "D > E"), (4, [1.0, 0.0], None, None)], "query_id long, vector array<double>, color string, category string")
    got = sorted((r.query_id, r["rank"], r.item_id) for r in dense.search(q, i, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (3, 1, 3), (4, 1, 1), (4, 2, 2)]


def test_gallery_is_sequential(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "b", "y"), (4, "B", "z"), (5, "C", "")], "seq long, title string, local_image string")
    assert [r.seq for r in catalog.gallery(rows).orderBy("seq").collect()] == [1, 3]


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('global_product_id,extra,most_recent_product_name,most_recent_price,outpath\n1,q,"Amazon.com: Big\nLamp",9.5,a/b.jpg\n1,q,Later,1,\n2,q,Mug,bad,a/c.jpg\n,q,None,1,\n')
    schema = "global_product_id long, most_recent_product_name string, most_recent_price string, outpath string"
    rows = tables.read_csv(spark, str(tmp_path / "c.csv"), schema).withColumn("seq", F.monotonically_increasing_id())
    for c in ("advertiser_program_name", "most_recent_product_description", "linked_product_url", "most_recent_product_image"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    texts = spark.createDataFrame([(1, "nice", 0)], "global_product_id long, text_description string, seq long")
    images = spark.createDataFrame([("b.jpg",)], "name string")
    got = {r.product_id: r for r in catalog.corpus(rows, texts, images).collect()}
    assert got["1"].title == "Big\nLamp" and got["1"].ai_description == "nice" and got["1"].local_image == "b.jpg" and got["2"].price is None and got["2"].local_image == ""


def test_later_attribute_file_wins(spark, tmp_path):
    (tmp_path / "a1.jsonl").write_text('{"product_id": "1", "method": "closed", "color": "red", "color_name": "red", "category": "A > B"}\n')
    (tmp_path / "a2.jsonl").write_text('{"product_id": "1", "method": "closed", "color": "blue", "color_name": "navy", "category": "A > C"}\n')
    rows = tables.read_jsonl(spark, str(tmp_path), tables.ATTRIBUTES)
    got = catalog.with_attributes(spark.createDataFrame([("1",), ("2",)], "product_id string"), rows).orderBy("product_id").collect()
    assert (got[0].color, got[0].category_l1, got[1].color, got[1].category_l1) == ("blue", "A", "", "")


def test_round_trips(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red lamp"), (2, "blue")], "doc_id long, text string")
    index = lexical.build_index(docs)
    lexical.write_index(docs, str(tmp_path / "index"))
    back = lexical.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, back.blocks.collect())) == sorted(map(tuple, index.blocks.collect())) and back.stats.first() == index.stats.first()
    path = str(tmp_path / "made")
    assert artifacts.current(spark, path) is None and not artifacts.complete(spark, path)
    assert artifacts.build_if_missing(spark, path, lambda: docs).count() == 2
    assert artifacts.build_if_missing(spark, path, lambda: docs.limit(1)).count() == 2
    assert artifacts.build_if_missing(spark, path, lambda: docs.limit(1), rebuild=True).count() == 1
    tables.write_vectors(enrich.embed(docs, "doc_id", "text", "m-1"), str(tmp_path / "vectors"))
    assert spark.read.parquet(str(tmp_path / "vectors")).where("model_id = 'm-1'").count() == 2
    (tmp_path / "t.txt").write_text("# v\n1 - A\n2 - A > B\n3 - A > B > C\n")
    assert [tuple(r) for r in tables.read_taxonomy(spark, str(tmp_path / "t.txt")).collect()] == [("A > B", "A")]


def test_annotation_is_resumable(spark, tmp_path):
    def call(text):
        if text == "bad":
            raise ValueError("no")
        return f'Sure {{"short": "{text}", "need": " "}}'

    wanted = spark.createDataFrame([("1", "x"), ("2", "bad")], "product_id string, prompt string")
    done = spark.createDataFrame([], "product_id string")
    replies = enrich.annotate(enrich.work_list(wanted, done, ["product_id"]), ["product_id"], "prompt", call)
    tables.append_results(replies, str(tmp_path / "out"))
    saved = spark.read.schema("product_id string, reply string, error string").json(str(tmp_path / "out"))
    assert [(r.product_id, r.style, r.query) for r in enrich.styles_of(saved, ["product_id"]).collect()] == [("1", "short", "x")]
    assert [r.product_id for r in enrich.work_list(wanted, saved.where("error is null"), ["product_id"]).collect()] == ["2"]


def test_cards_facets_and_export(spark):
    rows = spark.createDataFrame([("1", "T", "m", 0.0, "", "http://i", "", "A > B", "A", "d" * 1300, 0.123456)],
                                 "product_id string, title string, merchant string, price double, local_image string, image_url string, color string, category string, category_l1 string, description string, score double")
    card = catalog.card(rows).first()
    assert (card.price, card.image, card.color, len(card.description), card.score) == (None, "http://i", None, 1200, 0.1235)
    assert rows.where(catalog.facet_filter(None, F.lit("A"))).count() == 1 and rows.where(catalog.facet_filter(None, F.lit("A > C"))).count() == 0
    with pytest.raises(ValueError):
        catalog.export_bundle(rows, {"photo": rows.where("false").select("product_id")})


def test_several_csv_files_inventory_and_readability(spark, tmp_path):
    for name, body in (("a_x.csv", 'id,text,more\n1,"two\nlines, ""quoted""",z\n'), ("b_x.csv", "id,text,more\n2,,z\nbad,t,z\n")):
        (tmp_path / name).write_text(body)
    got = tables.read_csv(spark, f"file://{tmp_path}/*_x.csv", "id long, text string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(None, "t"), (1, 'two\nlines, "quoted"'), (2, None)]
    images = tmp_path / "images" / "deep"
    images.mkdir(parents=True)
    for name, body in (("a.jpg", b"\xff\xd8\xff\xe0data"), ("b.png", b"\x89PNG\r\n\x1a\nx"), ("c.jpg", b"not an image"), ("d.png", b"")):
        (images / name).write_bytes(body)
    have = {r.name: r.length for r in tables.image_inventory(spark, f"file://{tmp_path}/images").collect()}
    assert have == {"a.jpg": 8, "b.png": 9, "c.jpg": 12}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{tmp_path}/images")
    assert {r.name for r in files.where(catalog.readable(F.col("content"))).select(F.element_at(F.split("path", "/"), -1).alias("name")).collect()} == {"a.jpg", "b.png"}


def test_half_precision(spark):
    import numpy as np

    from shelfrank.functions.vectors import half_precision

    rows = [(1, [0.1, -2.0, 65504.0]), (2, [])]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", half_precision(F.col("v")).alias("h")).collect()}
    assert got[1] == np.array(rows[0][1], np.float16).astype(np.float32).tolist() and got[2] == []


def test_encoders_of_bytes_and_lower_case(spark):
    import numpy as np

    seen = lambda xs: np.array([[len(x), x[:1] in ("A", b"A")] for x in xs], np.float32)
    images = spark.createDataFrame([(1, bytearray(b"Abc")), (2, None)], "i long, x binary")
    assert {r.i: r.embedding for r in enrich.embed(images, "i", "x", "m", seen, "photo", blank=b"").collect()} == {1: [3.0, 1.0], 2: [0.0, 0.0]}
    texts = spark.createDataFrame([(1, "Abc")], "i long, x string")
    assert [enrich.embed(texts, "i", "x", "m", seen, lower=low).first().embedding for low in (False, True)] == [[3.0, 1.0], [3.0, 0.0]]


def test_only_failures_that_may_pass_are_tried_again(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        with open(log) as f:
            n = f.read().split().count(text)
        error = RuntimeError(text)
        error.status = {"busy": 429, "down": 503, "wrong": 400}[text]
        if text == "busy" and n == 3:
            return "done"
        raise error

    work = spark.createDataFrame([(1, "busy"), (2, "down"), (3, "wrong")], "k long, p string").coalesce(1)
    got = {r.k: (r.reply, r.error) for r in enrich.annotate(work, ["k"], "p", call, tries=3, pause=0.01).collect()}
    assert got == {1: ("done", None), 2: (None, "down"), 3: (None, "wrong")}
    with open(log) as f:
        assert sorted(f.read().split()) == ["busy"] * 3 + ["down"] * 3 + ["wrong"]


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "xone two threex four"), (3, None), (4, "")], "doc_id long, text string")
    said = [(1, "two three"), (2, "one"), (3, "one two three"), (4, "two three four five six"), (5, "nine ten eleven"), (6, "two three four five six seven")]
    passages = spark.createDataFrame(said, "query_id long, passage string")
    want = sorted((q, i) for q, p in said for i, t in ((1, "one two three four five six seven"), (2, "xone two threex four")) if p in t)
    assert sorted(map(tuple, lexical.holding(docs, passages).collect())) == want
    assert lexical.holding(docs, passages.where("false")).count() == 0


def test_texts_are_not_shuffled_for_few_passages(spark, monkeypatch):
    """Passages of a broadcast go to the texts; rows are those of the join of more passages, and of the texts as substrings."""
    rng = random.Random(3)
    blank, word = lambda: rng.choice((" ", " ", "  ", "\n", "\t", "\u00a0", "\x1c")), lambda: rng.choice(("a", "b", "c", "ñ", ".", "dd"))
    texts = ["", None, " ", *("".join(word() + blank() for _ in range(rng.randrange(1, 60))) for _ in range(400))]
    cut = lambda t, n: t[(at := rng.randrange(len(t))) : at + n]
    said = [(i % 90, cut(rng.choice(texts[3:]), rng.randrange(1, 30))) for i in range(120)] + [(90, None), (91, ""), (92, " a b c "), (93, "a b c d e f g")]
    docs, passages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(said, "query_id int, passage string")
    want = {(q, i) for q, p in said for i, t in enumerate(texts) if p is not None and t is not None and p in t}
    long = passages.where(r"size(split(passage, '\\s+')) > 2")
    found = lexical.holding(docs, long)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 100
    for pieces in (lexical.PIECE_BYTES, 50):
        monkeypatch.setattr(lexical, "PIECE_BYTES", pieces)
        assert set(map(tuple, lexical.holding(docs, passages).collect())) == want
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert set(map(tuple, lexical.holding(docs, passages).collect())) == want


def test_answers_are_counted_for_each_text_once(spark):
    """Through the query: 50,000 ids of one text with 50,000 right answers, 2,500,000,000 pairs that nothing may make."""
    from shelfrank.plans import catalog as plans

    n = 50_000
    rows = spark.range(n).select(F.col("id").alias("query_id"), F.lit("lamp").alias("query"), F.col("id").cast("string").alias("product_id"), F.lit("E").alias("esci_label"), F.col("id").alias("seq"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plans, "_judged", lambda *_: rows)
        counted = plans.truth(spark, "")
        assert {tuple(r) for r in counted.groupBy("relevance", "answers").count().collect()} == {("strict", n, n), ("lenient", n, n)}


def test_rows_go_to_no_more_tasks_in_larger_tables(spark):
    """Blocks grow with the tables up to their bound in bytes; a kernel gets a bounded number of queries at once."""
    import numpy as np

    copies = lambda n, bytes_: kernel.deal(n // 10, n, bytes_, bytes_)
    for n in (100_000, 300_000, 600_000):
        chunks, blocks = copies(n, 512)
        assert 100 <= chunks * blocks <= 2 * kernel.TASKS and blocks <= 64
    assert copies(10_000_000, 512)[1] >= 10_000_000 // kernel.MOST_ITEMS and kernel.deal(40, 100, 512, 512) == (1, 1)
    q, i = (spark.range(n).select(F.col("id").alias(f"{x}_id"), F.array(F.col("id").cast("double")).alias("v")) for n, x in ((1300, "query"), (3, "item")))
    seen = kernel.by_blocks(q.select("query_id", F.col("v").alias("vector")), i, {"v": ("vector",)}, lambda a, b: {"n": np.array([len(a["query_id"])]), "m": np.array([len(b["item_id"])])}, "n long, m long")
    assert seen.agg(F.max("n")).first()[0] <= kernel.QUERIES_AT_ONCE and seen.agg(F.sum(F.col("n") * F.col("m"))).first()[0] == 3900


def test_types_in_one_pass_equal_type_by_type(spark):
    """Two models of different lengths, vectors that take no part, ties, and another number of results for each type."""
    import numpy as np

    rng = np.random.default_rng(3)
    vector = lambda n: rng.integers(-2, 3, n).astype(float).tolist()
    i = [(m, x, k, vector(n)) for m, n in (("a", 4), ("b", 2)) for x in ("photo", "title") for k in range(60)] + [("a", "photo", 90, [float("nan")] * 4), ("b", "title", 91, None), ("c", "photo", 92, [1.0])]
    q = [(m, x, k, vector(n)) for m, n in (("a", 4), ("b", 2)) for x in ("text", "image") for k in range(9)] + [("a", "text", 20, [1.0]), ("b", "image", 21, None)]
    items = spark.createDataFrame(i, "model_id string, modality string, item_id long, item_vector array<double>")
    queries = spark.createDataFrame(q, "model_id string, modality string, query_id long, vector array<double>")
    types = {"t2p": ("a", "text", "photo"), "t2t": ("a", "text", "title"), "i2t": ("b", "image", "title")}
    targets = spark.createDataFrame([(k, 2 * k + 1) for k in range(8)], "query_id long, target_id long")
    got = {name: [] for name in types}
    for r in dense.search_types(queries, items, types, {"t2p": 5, "t2t": 7, "i2t": 60}).collect():
        got[r.type].append((r.query_id, r.item_id, r.score, r["rank"]))
    ranks = {(r.type, r.query_id): r["rank"] for r in dense.target_ranks_of_types(queries, items, types, targets).collect()}
    for (name, (m, a, o)), k in zip(types.items(), (5, 7, 60), strict=True):
        own, of = queries.where(f"model_id = '{m}' and modality = '{a}'"), items.where(f"model_id = '{m}' and modality = '{o}'")
        assert sorted(got[name]) == sorted(tuple(r) for r in dense.search(own, of, k).select("query_id", "item_id", "score", "rank").collect())
        alone = dense.target_ranks_at_scale(own, of, targets).collect()
        assert {(name, r.query_id): r["rank"] for r in alone} == {x: n for x, n in ranks.items() if x[0] == name} and len(alone) == 8
