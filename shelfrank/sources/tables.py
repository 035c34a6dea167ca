"""Reading and writing: explicit schemas for text formats, Parquet with its own."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colors import PALETTE
from ..functions.text import clean_price, taxonomy_level2
from ..operators.catalog import export_bundle, gallery, with_attributes
from ..operators.fusion import BLEND
from .artifacts import build_if_missing, complete, current, publish

CATALOG = (
    "global_product_id long, advertiser_program_name string, most_recent_product_name string, most_recent_product_description string, "
    "linked_product_url string, most_recent_price string, most_recent_product_image string, outpath string"
)
ENRICHED = "global_product_id long, text_description string"
QUERIES = "product_id string, source string, style string, query string, generator string"
ATTRIBUTES = "product_id string, method string, model string, tokens_in long, tokens_out long, color string, color_name string, category string, color_raw string"


def with_order(df: DataFrame) -> DataFrame:
    """``seq``: full path of the file and place in it, for keep-first and keep-last.

    A place is where the file's part begins that a task reads, and the row's number among those of the task.
    """
    place = [F.lpad(x.cast("string"), 20, "0") for x in (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())]
    return df.withColumn("seq", F.concat_ws(":", F.col("_metadata.file_path"), *place))


def read_csv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """CSV by header names, of one file, a glob or a list: quoted fields may hold line ends; columns that are not asked for are not parsed.

    ``ordered`` adds ``seq``, by which keep-first and keep-last go.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    wanted = [x.split() for x in schema.split(", ")]
    picked = [F.col(n).try_cast(t).alias(n) for n, t in wanted if columns is None or n in columns]
    return with_order(df).select(*picked, "seq") if ordered else df.select(*picked)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return with_order(spark.read.schema(schema).json(paths))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Second-level paths and their first level."""
    lines = spark.read.text(path).select(taxonomy_level2(F.col("value")).alias("path")).where(F.col("path").isNotNull())
    return lines.withColumn("l1", F.split("path", " > ")[0])


def image_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths of the files under ``path``; contents are not read, and empty files, which hold no image, are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("model_id", "modality").parquet(path)


def read_vectors(spark: SparkSession, path: str, model_id: str, modality: str) -> DataFrame:
    """The vectors of one model and modality; only their folder is read."""
    return spark.read.parquet(path).where((F.col("model_id") == model_id) & (F.col("modality") == modality))


def has_vectors(spark: SparkSession, path: str, model_id: str, modality: str) -> bool:
    return complete(spark, path) and not read_vectors(spark, path, model_id, modality).isEmpty()


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric tables are a few rows of JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def save_corpus(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The published corpus at ``path``: ``build()`` gives its rows (``catalog.corpus``) where there is none."""
    return build_if_missing(spark, path, build, rebuild)


def save_gallery(corpus_rows: DataFrame, path: str, order: str = "seq", rebuild: bool = False) -> DataFrame:
    """The published gallery at ``path``, of ``corpus_rows``."""
    return build_if_missing(corpus_rows.sparkSession, path, lambda: gallery(corpus_rows, order), rebuild)


def save_items(gallery_rows: DataFrame, attributes: DataFrame, path: str, order: str = "seq", rebuild: bool = False) -> DataFrame:
    """The published items at ``path``: gallery rows with clean prices and attributes."""
    priced = gallery_rows.withColumn("price", clean_price(F.col("price")))
    return build_if_missing(gallery_rows.sparkSession, path, lambda: with_attributes(priced, attributes, order), rebuild)


MANIFEST = "built_at string, items long, labelled long, models map<string,string>, photo_weight double, palette array<string>"


def write_bundle(
    items: DataFrame, vectors: dict[str, DataFrame], path: str, *, models: dict[str, str] | None = None, photo_weight: float = BLEND, palette: tuple[str, ...] = PALETTE, built_at: str | None = None
) -> str:
    """Publish ``items``, a table of vectors of each kind, and ``manifest`` as one version; its folder.

    Raises where items and vectors do not match one to one; the version before then stays the current one.
    """
    kept, counts = export_bundle(items, vectors)
    when = built_at or datetime.now(UTC).isoformat(timespec="seconds")
    names = F.from_json(F.lit(json.dumps(models or {})), "map<string,string>")
    said = counts.select(F.lit(when).alias("built_at"), "items", "labelled", names.alias("models"), F.lit(photo_weight).alias("photo_weight"), F.array(*[F.lit(c) for c in palette]).cast("array<string>").alias("palette"))

    def write(folder: str) -> None:
        kept.write.parquet(f"{folder}/items")
        for kind, table in vectors.items():
            table.write.parquet(f"{folder}/{kind}")
        write_metrics(said, f"{folder}/manifest")

    return publish(items.sparkSession, path, write)


def read_bundle(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> dict[str, DataFrame]:
    """``items``, the vectors of ``kinds`` and ``manifest`` of the current version, all of one version."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(path)
    return {x: spark.read.parquet(f"{folder}/{x}") for x in ("items", *kinds)} | {"manifest": spark.read.schema(MANIFEST).json(f"{folder}/manifest")}


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
