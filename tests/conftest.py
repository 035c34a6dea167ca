from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, data):
    """Asserts that a registered query and its SQL give the same rows."""
    import duckdb

    import __spark_entry__ as entry

    def plain(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.10g}"
        return str(v)

    def check(name: str) -> None:
        df = entry.queries()[name](spark, data)
        columns = sorted(df.columns)
        got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        cursor = con.execute(entry.oracle_sql()[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())

    return check
