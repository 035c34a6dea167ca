"""Profile of the judgement and product tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values and their numbers."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def label_shares(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return value_counts(df, column).crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))  # one row


def distinct_queries(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.agg(F.count_distinct("query_id").alias("all_queries"), *[F.count_distinct(F.when(F.col(f) == 1, F.col("query_id"))).alias(f) for f in flags])


def depth(df: DataFrame) -> DataFrame:
    n, q = F.count("*"), F.count_distinct("query_id")
    return df.groupBy("product_locale", "split").agg(n.alias("judgements"), q.alias("queries"), F.round(n / q, 6).alias("depth"))


def length_summary(queries: DataFrame, text: str = "query") -> DataFrame:
    """Distribution of word counts over distinct queries."""
    n = queries.select(text).distinct().select(F.size(words(F.col(text))).alias("n"))
    quarter = lambda p: F.percentile("n", F.lit(p)).cast("double")
    return n.agg(
        F.count("*").alias("count"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").cast("long").alias("min"),
        quarter(0.25).alias("q25"), quarter(0.5).alias("q50"), quarter(0.75).alias("q75"), F.max("n").cast("long").alias("max"),
    )


def length_histogram(queries: DataFrame, text: str = "query", first: int = 15) -> DataFrame:
    """The ``first`` smallest word counts and how many distinct queries have them."""
    return queries.select(text).distinct().groupBy(F.size(words(F.col(text))).cast("long").alias("words")).agg(F.count("*").alias("n")).orderBy("words").limit(first)


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    rates = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in columns])
    return rates.unpivot([], columns, "field", "missing")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["total"], columns, "field", "filled").select("field", "filled", "total", F.round(100 * F.col("filled") / F.col("total"), 1).alias("pct"))


def split_leakage(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaking"))


def positive_pairs(df: DataFrame, is_positive: Column) -> DataFrame:
    return df.where(is_positive).agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries"), F.count_distinct("product_id").alias("products"))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows, columns`` of each table."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def judged_titles(examples: DataFrame, products: DataFrame, order: str = "ESCI") -> DataFrame:
    """Judged rows with titles; ``place`` numbers each query's rows in label order, then by product."""
    rows = examples.join(products, ["product_locale", "product_id"], "left")
    rows = rows.select("query_id", "product_id", "esci_label", F.substring(F.coalesce("product_title", F.lit("")), 1, 95).alias("title"), F.instr(F.lit(order), F.col("esci_label")).alias("_label"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_label", "product_id"))
    return rows.withColumn("place", place.cast("long")).drop("_label")
