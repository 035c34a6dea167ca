"""Published bundles, file order, encoders in workers, half precision, relevance by look-ups."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from shelfrank.functions.vectors import half_precision
from shelfrank.operators import catalog, enrich, evaluate
from shelfrank.operators.ranking import first_of
from shelfrank.sources import artifacts, tables


@pytest.fixture
def bundle(spark):
    items = spark.createDataFrame([("a", "red"), ("b", "")], "product_id string, color string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "product_id string, embedding array<double>")
    return items, vectors


def test_a_failing_write_leaves_the_old_bundle(bundle, tmp_path, monkeypatch):
    items, vectors = bundle
    path, spark = f"file://{tmp_path}/bundle", items.sparkSession
    tables.write_bundle(items, {"photo": vectors, "title": vectors}, path, models={"photo": "m"}, palette=("red",), built_at="then")
    plain, calls = DataFrameWriter.parquet, []

    def failing(self, at, *a, **b):
        calls.append(at)
        if len(calls) == 3:
            raise OSError("disk")
        return plain(self, at, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError):
        tables.write_bundle(items.withColumn("color", F.lit("new")), {"photo": vectors, "title": vectors}, path)
    monkeypatch.undo()
    read = tables.read_bundle(spark, path, ("photo", "title"))
    said = read["manifest"].first()
    assert sorted(r.color for r in read["items"].collect()) == ["", "red"] and read["title"].count() == 2
    assert (said.built_at, said.items, said.labelled, said.models, said.photo_weight, said.palette) == ("then", 2, 1, {"photo": "m"}, 0.7, ["red"])
    assert len([x for x in os.listdir(tmp_path / "bundle") if x.startswith("version-")]) == 1
    for n in (2, 3, 4):
        tables.write_bundle(items.withColumn("color", F.lit(f"c{n}")), {"photo": vectors, "title": vectors}, path)
    assert {r.color for r in tables.read_bundle(spark, path, ())["items"].collect()} == {"c4"}
    assert len([x for x in os.listdir(tmp_path / "bundle") if x.startswith("version-")]) == 2
    with pytest.raises(FileNotFoundError):
        tables.read_bundle(spark, f"{path}-none", ())


def test_bundles_match_one_to_one(bundle):
    items, vectors = bundle
    more = vectors.unionByName(vectors.withColumn("product_id", F.concat("product_id", F.lit("x"))))
    assert catalog.bundle_faults(items, {"photo": vectors, "title": more}) == {"title vectors have no item": 2}
    assert catalog.bundle_faults(items, {"photo": vectors.where("product_id = 'a'").union(vectors)}) == {"ids of photo rows are repeated": 1}
    assert catalog.bundle_faults(items.union(items), {"photo": vectors.where("false")}) == {"ids of item rows are repeated": 2, "items have no photo vector": 2}
    assert catalog.bundle_faults(items.withColumn("product_id", F.lit(None).cast("string")), {}) == {"ids of item rows are repeated": 1, "rows have no id": 1}
    with pytest.raises(ValueError, match="no photo vector"):
        catalog.export_bundle(items, {"photo": vectors.limit(1)})


def test_an_unfinished_table_is_not_taken(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    folder = artifacts.publish(spark, path, lambda at: spark.range(3).write.parquet(at))
    os.remove(folder.removeprefix("file:") + "/_SUCCESS")
    assert artifacts.build_if_missing(spark, path, lambda: spark.range(5)).count() == 5


def test_files_of_one_name_in_three_folders(spark, tmp_path):
    for k, folder in enumerate("cab"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("id,text\n" + "".join(f'{i},"{folder}\n{i}"\n' for i in range(3)))
        (tmp_path / folder / "x.jsonl").write_text("".join(f'{{"product_id": "{i}", "color": "{folder}{j}"}}\n' for j in (0, 1) for i in range(3)))
    rows = tables.read_csv(spark, f"file://{tmp_path}/*/x.csv", "id long, text string", ordered=True)
    assert {r.id: r.text for r in first_of(rows, ["id"], [F.col("seq")]).collect()} == {i: f"a\n{i}" for i in range(3)}
    assert {r.id: r.text for r in first_of(rows, ["id"], [F.col("seq").desc()]).collect()} == {i: f"c\n{i}" for i in range(3)}
    lines = tables.read_jsonl(spark, [f"file://{tmp_path}/{x}/x.jsonl" for x in "cba"], tables.ATTRIBUTES)
    assert {r.product_id: r.color for r in first_of(lines, ["product_id"], [F.col("seq").desc()]).collect()} == {str(i): "c1" for i in range(3)}


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    log = str(tmp_path)

    def load():
        open(f"{log}/{os.getpid()}-{len(os.listdir(log))}", "w").close()
        return lambda xs: np.array([[len(x), max(map(len, xs))] for x in xs], np.float32)

    docs = spark.range(3000).select("id", F.repeat(F.lit("x"), (F.col("id") * 7919 % 97).cast("int")).alias("text")).repartition(40)
    for _ in range(2):
        got = enrich.embed(docs, "id", "text", f"model-{log}", load=load).collect()
        assert len(got) == 3000 and all(r.embedding[0] == r.id * 7919 % 97 for r in got)
    workers = [x.split("-")[0] for x in os.listdir(log)]
    assert len(workers) == len(set(workers)) < 40  # of two times 40 tasks
    lengths = enrich.by_length(lambda xs: np.array([[max(map(len, xs))] for x in xs]), ["x" * n for n in (9, 1, 8, 2, 7, 3)], 2)[:, 0].tolist()
    assert lengths == [9, 2, 9, 2, 7, 7]


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(0)
    edges = [0.0, -0.0, 65504.0, 65519.99, 65520.0, -70000.0, 1e30, 6e-8, 2.9e-8, 2.98023224e-8, 3e-8, 6.1035156e-05, 6.1e-05, 1 / 3, 2049.0, 2051.0, 1.0009765625, 1.00048828125, 1.00146484375, float("inf"), -float("inf")]
    values = np.concatenate([edges, rng.normal(size=500), 10.0 ** rng.uniform(-9, 6, 500) * rng.choice([-1, 1], 500), np.nextafter(np.float32(2.0) ** np.arange(-14, 15), np.float32(0), dtype=np.float32)]).astype(np.float32)
    row = spark.createDataFrame([(values.tolist(),)], "v array<float>").select(half_precision(F.col("v")).alias("h")).first().h
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(row, np.float32), values.astype(np.float16).astype(np.float32))
    odd = spark.createDataFrame([(1, [None, float("nan"), 1.0]), (2, None), (3, [])], "i int, v array<float>").select("i", half_precision(F.col("v")).alias("h"))
    got = {r.i: r.h for r in odd.collect()}
    assert got[1][0] is None and np.isnan(got[1][1]) and got[1][2] == 1.0 and got[2] is None and got[3] == []
    assert "Python" not in odd._jdf.queryExecution().executedPlan().toString()


def test_lenient_metrics_need_no_list_of_answers(spark):
    """The same as by listing every good document of every source of a query's answers."""
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, f"s{i % 5}" if i % 7 else None, bool(i % 3 == 0)) for i in range(60)], "doc_id long, source string, good boolean")
    strict = spark.createDataFrame([(q, int(d), f"s{d % 5}" if d % 7 else None) for q in range(12) for d in rng.integers(0, 60, 2)], "query_id long, doc_id long, source string")
    stages = spark.createDataFrame([(s, q, int(d), r + 1) for s in "ab" for q in range(15) for r, d in enumerate(rng.permutation(60)[:20])], "stage string, query_id long, doc_id long, rank long")
    more = strict.select("query_id", "source").join(docs.where("good"), "source").select(F.lit("lenient").alias("relevance"), "query_id", "doc_id")
    own = strict.select(F.explode(F.array(F.lit("strict"), F.lit("lenient"))).alias("relevance"), "query_id", "doc_id")
    want = evaluate.judged_metrics(stages, own.unionByName(more).distinct())
    got = evaluate.source_metrics(stages, strict, docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_csv_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A file that may hold line ends in its fields is read by one task, so there are more files of larger tables."""
    from shelfrank.plans import catalog as plans

    rows = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.lit('a "b"\nc'), 100).alias("text"), F.lit(700).cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(plans, "CSV_BYTES", 4000, raising=False)
    monkeypatch.setattr(plans, "scratch_path", lambda *_: f"{tmp_path}/csv")
    back = plans.csv_round_trip(spark, str(tmp_path)).select("doc_id", "text").distinct()
    assert back.count() == 64 and back.select("text").distinct().count() == 1
    assert max(x.stat().st_size for x in (tmp_path / "csv").glob("*.csv")) < 20_000


def test_words_are_hashed_once_for_many_texts(monkeypatch):
    """More different words than were once kept, in two calls; blanks are those of ASCII."""
    made, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda word: made.append(word) or md5(word))
    many = " ".join(f"once{i}" for i in range(100_000))
    first = enrich.hashed_encoder([many])
    assert (enrich.hashed_encoder([many]) == first).all() and len(made) == 100_000
    odd = "A\x0bb\x0cc\x1cd\x85e\u00a0f g\rh\ni  \u0130 "
    words = ["a", "b", "c\x1cd\x85e\u00a0f", "g", "h", "i", "i\u0307"]
    want = [0] * 64
    for code in (int(md5(word.encode()).hexdigest()[:8], 16) for word in words):
        want[code % 64] += 1 if code >> 31 else -1
    assert np.allclose(enrich.hashed_encoder([odd, ""]), [np.array(want) / np.linalg.norm(want), [0] * 64])
