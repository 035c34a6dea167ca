"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the word budget by weight, at most ``max_epochs`` times its own size; what the
clamped sources cannot take is shared again by weight until no source is above its cap. A source's target is then
met by whole repetitions of all its documents plus a seeded fractional repetition: documents in seeded order until
the rest of the target is used up.

A null text has size 0. A null source is a source of its own, ordered last. Rows of one id share their place in the
seeded order and share a cut in proportion to their sizes. Sources without words have target 0. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, n_words, ordinal, small

#: Leading hex digits of the seeded order that split a source into buckets for the running sum.
BUCKET_DIGITS = 3
#: Bytes that a source's plan takes in a broadcast, about.
PLAN_BYTES = 256


def water_fill(sources: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """``sources(source, source_size, weight)`` plus ``target``: shares of ``budget`` by weight under caps.

    Each round is one aggregate of the source table; only four sums reach the driver. The clamped set only grows,
    so the loop ends.
    """
    cap = (F.col("source_size") * max_epochs).cast("decimal(38,0)")
    weight = F.col("weight").cast("decimal(38,0)")
    total_weight = sources.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()["w"]
    clamped = (0, 0)
    while True:
        rest, left = int(budget) - clamped[0], int(total_weight) - clamped[1]
        above = weight * F.lit(rest).cast("decimal(19,0)") > cap * F.lit(left).cast("decimal(19,0)")
        row = sources.where(above).agg(
            F.coalesce(F.sum(F.col("source_size") * max_epochs), F.lit(0)).alias("c"),
            F.coalesce(F.sum("weight"), F.lit(0)).alias("w"),
        ).first()
        if (int(row["c"]), int(row["w"])) == clamped:
            break
        clamped = (int(row["c"]), int(row["w"]))
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(max(left, 1)))
    return sources.withColumn("target", F.when(above, (F.col("source_size") * max_epochs).cast("double")).otherwise(share))


def mix_plan(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """``(sized, sources)``: one narrow row per document, and per source its target and where its mix ends.

    ``sources`` has ``target``, ``whole`` (repetitions of every document), ``last`` (place in the seeded order of the
    document at which the fractional repetition ends), ``last_size`` and ``last_words`` (words still taken there).
    Weights go to the sources in code point order, repeating.
    """
    order_key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = materialize(
        documents.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"), order_key.alias("place"),
        ),
        "mix-sized",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordinal(sums, [F.col("source").asc_nulls_last()], "source_no")
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.withColumn("weight", pick.cast("long")), "mix-sources")
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    filled = water_fill(sources, budget, max_epochs)
    words = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    filled = filled.withColumn("whole", F.floor(words / size).cast("long")).withColumn("rest", words - F.col("whole") * F.col("source_size"))

    # the running sum of sizes in seeded order: first over buckets of each source, then inside one bucket of it
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    by_bucket = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    slim = filled.select(F.col("source").alias("_s"), "rest")
    ends = (
        by_bucket.withColumn("upto", F.sum("n").over(upto))
        .join(slim, F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        .select("_s", F.col("bucket").alias("_b"), (F.col("rest") - F.col("upto") + F.col("n")).alias("_need"))
    )
    places = (
        sized.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_b")))
        .groupBy("_s", "place", "_need").agg(F.sum("size").alias("n"))
    )
    inside = Window.partitionBy("_s").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        places.withColumn("upto", F.sum("n").over(inside))
        .where((F.col("upto") >= F.col("_need")) & (F.col("upto") - F.col("n") < F.col("_need")))
        .select("_s", F.col("place").alias("last"), F.col("n").alias("last_size"), (F.col("_need") - F.col("upto") + F.col("n")).alias("last_words"))
    )
    done = filled.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return sized, materialize(done, "mix-plan")


def with_plan(rows: DataFrame, sources: DataFrame, source: Column) -> DataFrame:
    """Join the plan of its source to every row; broadcast only within a bound of bytes (see ``small``).

    Beyond it a hot source's rows are left to adaptive execution, which splits skewed partitions.
    """
    plan = sources.select(F.col("source").alias("_source"), "source_size", "target", "whole", "last", "last_size", "last_words")
    return rows.join(small(plan, PLAN_BYTES), source.eqNullSafe(F.col("_source")), "left").drop("_source")


def mixed_sizes(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: words taken of each document, the last one cut exactly."""
    sized, sources = mix_plan(documents, **options)
    part = F.when(F.col("place") < F.col("last"), F.col("size")).when(
        F.col("place") == F.col("last"), F.floor(F.col("last_words") * F.col("size") / F.greatest(F.col("last_size"), F.lit(1))).cast("long")
    ).otherwise(F.lit(0))
    rows = with_plan(sized, sources, F.col("source")).withColumn("taken", (F.col("whole") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(documents: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mixed table: the rows of ``documents``, each as often as the mix repeats it (whole documents only).

    The document at which a fractional repetition ends is taken where at least half of it is still wanted.
    """
    _, sources = mix_plan(documents, id_col=id_col, source_col=source_col, seed=seed, **options)
    doc = F.col("doc")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc[id_col].cast("string"), F.lit("null"))))
    plan = sources.withColumn("last", F.struct("last", (F.col("last_words") * 2 >= F.col("last_size")).alias("half")))
    extra = F.when(place < F.col("last.last"), 1).when((place == F.col("last.last")) & F.col("last.half"), 1).otherwise(0)
    rows = with_plan(boxed(documents), plan, doc[source_col]).withColumn("_times", (F.col("whole") + extra).cast("int"))
    return rows.where(F.col("_times") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("doc.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER w AS k,
         coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM sums WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
level AS (
  SELECT total - caps AS num, all_weight - heavy AS den, k FROM ordered
  WHERE weight * (total - caps) <= 3 * source_size * (all_weight - heavy) ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN o.k < l.k THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM ordered o, level l),
plan AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words,
         CAST(floor(target + 0.5) AS BIGINT) // greatest(source_size, 1) AS whole FROM targets),
places AS (
  SELECT source, place, sum(size) AS n FROM sized GROUP BY source, place),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM places)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(p.whole * s.size + CASE
         WHEN r.upto <= p.words - p.whole * p.source_size THEN s.size
         WHEN r.upto - r.n < p.words - p.whole * p.source_size
           THEN CAST(floor((p.words - p.whole * p.source_size - r.upto + r.n) * s.size / greatest(r.n, 1)) AS BIGINT)
         ELSE 0 END AS BIGINT) AS taken
FROM sized s
JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN run r ON s.source IS NOT DISTINCT FROM r.source AND s.place = r.place
"""
