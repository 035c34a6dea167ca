"""What several operators of this subpackage share: scratch tables, bounded broadcasts and batches, word counts, ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, scratch_dir, scratch_path

__all__ = ["discard", "materialize", "scratch_dir", "scratch_path"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Estimated bytes up to which a table may be broadcast; beyond that it is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Rows of one key that a join may put in one task before the key is split.
HUB = 1000
#: Texts in one batch for a Python worker: whole texts are long, and Spark's own 10,000 may be hundreds of MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of at most BATCH_ROWS rows, so a batch holds few MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of about ``row_bytes`` each, stay within BROADCAST_BYTES."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded(df: DataFrame, more: Column | None = None) -> DataFrame | None:
    """``df`` if its rows, by the real length of their strings and ``more`` bytes, stay within BROADCAST_BYTES, else None."""
    strings = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    width = sum(strings, F.lit(16 * len(df.columns)) + F.coalesce(more if more is not None else F.lit(0), F.lit(0))).cast("long")
    total = df.agg(F.sum(width)).first()[0] or 0
    return df if total <= BROADCAST_BYTES else None


def hub_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per ``key`` and in ``n`` how many of ``rows`` have it.

    Keys of over HUB rows are split by a hash of ``by``, and their row of ``table`` is repeated as often, so no task
    gets a hot key whole. There are at most 1/HUB as many of them as rows; should even these be too many to broadcast,
    the plain join is left to adaptive execution, which splits skewed partitions.
    """
    heavy = table.where(F.col("n") > HUB).select(key, F.ceil(F.col("n") / HUB).cast("int").alias("_parts"))
    n = heavy.count()
    if not n or n * 64 > BROADCAST_BYTES:
        return rows.join(table.drop("n"), key)
    parts, one = F.broadcast(heavy), F.coalesce("_parts", F.lit(1))  # counted above
    left = rows.join(parts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), one).cast("int")).drop("_parts")
    right = table.drop("n").join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def boxed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``doc``: inner columns can then have any names. ``select("doc.*")`` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def n_words(text: Column) -> Column:
    """Number of words of ``text`` as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based position of each row under ``order``, without a one-task sort.

    Range partitions are written once; only one count per partition comes to the driver.
    """
    spark = df.sparkSession
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordinal")
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    rows, before = [], 0
    for part, n in counts:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "_part int, _before long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_part")  # one row for each partition
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_part", "_inside", "_before")
    )
