"""Catalog preparation: corpus, gallery, export items, joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.colors import query_colors
from ..sources.scratch import small
from .ranking import first_of


def us_corpus(products: DataFrame, locale: str = "us", order: str = "seq") -> DataFrame:
    """Products of a locale with id and title, the first row of each id."""
    rows = products.where((F.col("product_locale") == locale) & F.col("product_id").isNotNull() & F.col("product_title").isNotNull())
    return first_of(rows, ["product_id"], [F.col(order)])


def task_slice(examples: DataFrame, version: str, locale: str, split: str) -> DataFrame:
    return examples.where((F.col(version) == 1) & (F.col("product_locale") == locale) & (F.col("split") == split))


def with_products(examples: DataFrame, products: DataFrame) -> DataFrame:
    return examples.join(products, ["product_locale", "product_id"], "left")


def corpus(catalog: DataFrame, enriched: DataFrame, images: DataFrame, order: str = "seq") -> DataFrame:
    """Clean titles, descriptions and prices, and the local image where the inventory has it."""
    rows = catalog.where(F.col("global_product_id").isNotNull() & F.col("most_recent_product_name").isNotNull())
    rows = first_of(rows, ["global_product_id"], [F.col(order)])
    texts = first_of(enriched, ["global_product_id"], [F.col(order)]).select("global_product_id", "text_description")
    have = images.select(F.col("name").alias("_name")).distinct()
    joined = rows.join(texts, "global_product_id", "left").withColumn("_file", T.base_name(F.col("outpath"))).join(have, F.col("_file") == F.col("_name"), "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return joined.select(
        T.id_text(F.col("global_product_id")).alias("product_id"), T.clean_title(F.col("most_recent_product_name")).alias("title"),
        text("most_recent_product_description").alias("description"), text("text_description").alias("ai_description"), text("advertiser_program_name").alias("merchant"),
        T.to_number(F.col("most_recent_price").cast("string")).alias("price"), text("linked_product_url").alias("url"), text("most_recent_product_image").alias("image_url"),
        F.coalesce("_name", F.lit("")).alias("local_image"), F.col(order),
    ).where(F.length("title") > 0)


def gallery(corpus_rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows with an image: the first of each image, then of those the first of each lower-case title."""
    one = first_of(corpus_rows.where("local_image <> ''"), ["local_image"], [F.col(order)])
    return first_of(one.withColumn("_t", F.lower("title")), ["_t"], [F.col(order)]).drop("_t")


def readable(content: Column) -> Column:
    """Whether image bytes begin like JPEG, PNG, GIF or WebP."""
    head = F.hex(F.substring(content, 1, 12))
    return head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A") | head.startswith("474946383") | (head.startswith("52494646") & head.endswith("57454250"))


def with_attributes(gallery_rows: DataFrame, attributes: DataFrame, order: str = "seq") -> DataFrame:
    """Closed-method attributes, later ones winning; missing ones are ``''``."""
    last = first_of(attributes.where("method = 'closed'"), ["product_id"], [F.col(order).desc()]).select("product_id", "color", "color_name", "category")
    out = gallery_rows.join(last, "product_id", "left").fillna("", ["color", "color_name", "category"])
    return out.withColumn("category_l1", T.category_level1(F.col("category")))


def queries_of(queries: DataFrame, gallery_rows: DataFrame, generator: str | None = None, with_color: bool = False) -> DataFrame:
    """Queries whose product is in the gallery; of one writer, and only those that name a colour, where asked."""
    rows = queries.join(gallery_rows.select("product_id"), "product_id", "left_semi")
    if generator is not None:
        rows = rows.where(F.col("generator") == generator)
    return rows.where(F.size(query_colors(F.col("query"))) > 0) if with_color else rows


def of_merchant(results: DataFrame, merchant: str) -> DataFrame:
    return results.where(F.col("merchant") == merchant)


def card(items: DataFrame) -> DataFrame:
    """What a result shows: local image before remote, empty attributes as null, short description, rounded score."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return items.select(
        "product_id", "title", "merchant", T.clean_price(F.col("price")).alias("price"), F.coalesce(blank("local_image"), blank("image_url")).alias("image"),
        blank("color").alias("color"), blank("category").alias("category"), F.substring("description", 1, 1200).alias("description"), F.round("score", 4).alias("score"),
    )


def lookup(items: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found items, unknown ids)``, each once."""
    ids = wanted.select("product_id").distinct()
    return items.join(ids, "product_id", "left_semi"), ids.join(items, "product_id", "left_anti")


def rejected_filters(requests: DataFrame, items: DataFrame, palette: tuple[str, ...]) -> DataFrame:
    """``query_id, reason`` of ``requests(query_id, color, category)`` that name an unknown colour or category."""
    known = items.select(F.explode(F.array("category", "category_l1")).alias("category")).where("category <> ''").distinct()
    color = requests.where(F.col("color").isNotNull() & ~F.col("color").isin(*palette)).select("query_id", F.lit("color").alias("reason"))
    category = requests.where("category is not null").join(small(known, 128), "category", "left_anti").select("query_id", F.lit("category").alias("reason"))
    return color.unionByName(category)


def facet_filter(color: Column | None, category: Column | None) -> Column:
    """Colour equality and category at the level that the filter names, both where given."""
    keep = F.lit(True)
    if color is not None:
        keep = keep & (color.isNull() | (F.col("color") == color))
    if category is not None:
        own = F.when(F.contains(category, F.lit(" > ")), F.col("category")).otherwise(F.col("category_l1"))
        keep = keep & (category.isNull() | (own == category))
    return keep


def facet_counts(items: DataFrame) -> DataFrame:
    """``facet, value, n`` for colour and both category levels, without empty values, in one pass."""
    sets = [["color"], ["category_l1"], ["category"]]
    counted = items.groupingSets(sets, "color", "category_l1", "category").agg(F.count("*").alias("n"), F.grouping("color").alias("gc"), F.grouping("category_l1").alias("g1"))
    facet = F.when(F.col("gc") == 0, "color").when(F.col("g1") == 0, "category_l1").otherwise("category")
    value = F.when(F.col("gc") == 0, F.col("color")).when(F.col("g1") == 0, F.col("category_l1")).otherwise(F.col("category"))
    return counted.select(facet.alias("facet"), value.alias("value"), "n").where("value <> ''")


def bundle_faults(items: DataFrame, vectors: dict[str, DataFrame]) -> dict[str, int]:
    """What keeps ``items`` and their ``vectors`` from matching one to one, in one grouping by product; only counts that are not 0."""
    rows = items.select("product_id", F.lit("item").alias("kind"))
    for kind, table in vectors.items():
        rows = rows.unionByName(table.select("product_id", F.lit(kind).alias("kind")))
    kinds = ["item", *vectors]
    each = rows.groupBy("product_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    counts = [F.count_if(F.col(k) > 1).alias(f"ids of {k} rows are repeated") for k in kinds]
    for k in vectors:
        counts += [F.count_if((F.col("item") > 0) & (F.col(k) == 0)).alias(f"items have no {k} vector"), F.count_if((F.col("item") == 0) & (F.col(k) > 0)).alias(f"{k} vectors have no item")]
    found = each.agg(*counts, F.count_if(F.col("product_id").isNull()).alias("rows have no id")).first().asDict()
    return {fault: n for fault, n in found.items() if n}


def export_bundle(items: DataFrame, vectors: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Items and the one-row manifest; raises where items and vectors of every kind do not match one to one."""
    if faults := bundle_faults(items, vectors):
        raise ValueError("; ".join(f"{n} {fault}" for fault, n in faults.items()))
    return items, items.agg(F.count("*").alias("items"), F.count_if(F.col("color") != "").alias("labelled"))
