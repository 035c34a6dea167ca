"""Top-k, first/last of duplicates, and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int | Column, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1; the limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return df.withColumn(name, rank).where(F.col(name) <= k)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in an explicit order."""
    return top_k(df, 1, keys, order, "_first").drop("_first")


def union_by(keys: list[str], *tables: DataFrame) -> DataFrame:
    """The rows of all ``tables``, shuffled once by ``keys``.

    Tables that are each partitioned by a key keep that claim in a plain union, although adaptive execution may have
    merged their partitions differently; a grouping by the key would then skip the shuffle and split its groups.
    """
    return reduce(DataFrame.unionByName, tables).repartition(*keys)


def best_first(score: str = "score", item: str = "doc_id") -> list[Column]:
    return [F.col(score).desc(), F.col(item).asc()]
