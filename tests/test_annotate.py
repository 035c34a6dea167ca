"""Annotation: calls at once, answers on record, and nothing asked twice."""

from __future__ import annotations

import json
import os
import time

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfrank.operators import annotate, enrich


def asked(log):
    return sorted(x for name in os.listdir(log) for x in [name.split("-")[0]])


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    return str(folder)


def test_calls_of_a_task_run_at_once(spark):
    """64 calls of a tenth of a second, eight in flight."""

    def call(text):
        time.sleep(0.1)
        return text

    work = spark.range(64).select("id", F.col("id").cast("string").alias("p")).coalesce(1)
    enrich.annotate(work.limit(1), ["id"], "p", call).collect()  # workers are up
    began = time.time()
    got = enrich.annotate(work, ["id"], "p", call, workers=8).collect()
    assert time.time() - began < 2 and {r.id: r.reply for r in got} == {i: str(i) for i in range(64)}


def test_never_more_calls_than_workers(spark, log):
    def call(text):
        path = f"{log}/{text}"
        open(path, "w").close()
        n = len(os.listdir(log))
        time.sleep(0.01)
        os.remove(path)
        return str(n)

    got = enrich.annotate(spark.range(60).select("id", F.col("id").cast("string").alias("p")).coalesce(1), ["id"], "p", call, workers=3).collect()
    assert len(got) == 60 and max(int(r.reply) for r in got) <= 3


def test_a_killed_job_repeats_only_what_has_no_record(spark, tmp_path, log):
    """The worker dies at its 30th call; the next run asks for what no record holds, and a third asks nothing."""
    journal = f"file://{tmp_path}/journal"

    def call(text):
        open(f"{log}/{text}-{time.time_ns()}", "w").close()
        if len(os.listdir(log)) >= 30 and not os.path.exists(f"{log}/../survives"):
            time.sleep(0.2)
            os._exit(1)
        return f"r{text}"

    work = spark.range(50).select("id", F.when(F.col("id") == 7, None).otherwise(F.col("id")).alias("key"), F.col("id").cast("string").alias("p"))
    run = lambda: {r.key: r.reply for r in enrich.annotate(work, ["key"], "p", call, workers=4, journal=journal, tasks=2).collect()}
    with pytest.raises((PySparkException, Py4JJavaError)):
        run()
    before = asked(log)
    recorded = {r.reply[1:] for r in annotate.recorded(spark, journal, "key bigint").collect()}
    assert 10 < len(recorded) <= len(before)
    (tmp_path / "survives").touch()
    assert run() == {(None if i == 7 else i): f"r{i}" for i in range(50)}
    after = asked(log)
    assert not {x for x in after if after.count(x) > 1} & recorded and set(after) == {str(i) for i in range(50)}
    assert len(run()) == 50 and asked(log) == after


def test_one_evaluation_after_another_asks_once(spark, tmp_path, log):
    """Counting and then reading a lazy result finds the records of the first evaluation; failures are asked again."""

    def call(text):
        open(f"{log}/{text}-{time.time_ns()}", "w").close()
        if text == "3":
            raise ValueError("no")
        return text

    work = spark.createDataFrame([(i, str(i % 20)) for i in range(20)] + [(5, "5"), (5, "5")], "id long, p string")
    lazy = enrich.annotate(work, ["id"], "p", call, journal=f"file://{tmp_path}/j", tasks=3)
    assert lazy.count() == 22 and sum(r.reply is not None for r in lazy.collect()) == 21
    assert asked(log) == sorted([str(i) for i in range(20)] + ["3"])
    assert enrich.annotate(work.where("false"), ["id"], "p", call, journal=f"file://{tmp_path}/j").count() == 0


def test_torn_records_are_passed_over_and_files_joined(tmp_path):
    records = annotate.Records(f"file://{tmp_path}/r")
    for i in range(3):
        records.write([{"k": i, "reply": "é\n", "error": None}])
    (tmp_path / "r" / "torn.jsonl").write_text(json.dumps({"k": 9, "reply": "x"})[:-4])
    records.join()
    assert sorted(r["k"] for r in records.read()) == [0, 1, 2] and len(os.listdir(tmp_path / "r")) == 1
