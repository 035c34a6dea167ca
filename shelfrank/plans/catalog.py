"""Registered queries of catalog preparation, profile, facets and text functions, with their SQL twins."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colors
from ..functions import text as T
from ..operators import catalog, enrich, evaluate, images, lexical, profile
from ..operators.ranking import first_of
from ..sources import artifacts, tables
from ..sources.scratch import scratch_path
from . import retrieval
from .retrieval import items, table


def _examples(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").count()
    split = F.when(F.col("user_id") % 5 == 0, "test").otherwise("train")
    return table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), (F.col("event_id") % n + 1).cast("string").alias("product_id"), (F.col("user_id") % 3).cast("string").alias("product_locale"),
        F.col("event_type").alias("esci_label"), (F.col("event_id") % 2).cast("int").alias("small_version"), F.lit(1).alias("large_version"), split.alias("split"), "event_id",
    )


def _products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("product_locale"), F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_title"), F.col("p_brand").alias("product_brand"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows from parts, with repeated titles and images."""
    local = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat("p_name", F.lit("-"), F.col("p_size").cast("string")))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("ai_description"))
    rows = table(spark, d, "part").select("p_partkey", T.clean_title(F.concat(F.lit(" Amazon.com: "), F.col("p_name"), F.lit(" - Etsy "))).alias("title"), F.col("p_brand").alias("merchant"), T.clean_price(F.col("p_retailprice").cast("double")).alias("price"), local.alias("local_image"))
    return rows.join(texts, "p_partkey", "left").select(F.col("p_partkey").alias("seq"), T.id_text(F.col("p_partkey")).alias("product_id"), "title", "merchant", "price", "local_image", T.clean_description(F.col("ai_description"), 600).alias("ai_description"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).drop("seq")


def gallery(spark: SparkSession, d: str) -> DataFrame:
    return catalog.gallery(_corpus(spark, d)).select("product_id", "title", "merchant", "local_image")


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("ai_description") != "(none)").alias("enriched"), F.count_if(F.col("local_image") != "").alias("with_image"))


def judged_join(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.with_products(catalog.task_slice(_examples(spark, d), "small_version", "0", "train"), _products(spark, d))
    return rows.groupBy("product_brand").agg(F.count("*").alias("judgements"), F.count_distinct("product_title").alias("titles"))


def first_product(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first: the earliest judgement of each query."""
    return first_of(_examples(spark, d), ["query_id"], [F.col("event_id")]).select("query_id", "product_id", "esci_label")


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.label_shares(_examples(spark, d), "esci_label")


def locale_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(_examples(spark, d), "product_locale")


def query_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_queries(_examples(spark, d), ["small_version", "large_version"])


def query_depth(spark: SparkSession, d: str) -> DataFrame:
    return profile.depth(_examples(spark, d))


def query_lengths(spark: SparkSession, d: str) -> DataFrame:
    return profile.length_summary(table(spark, d, "conversations"), "text")


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.length_histogram(table(spark, d, "conversations"), "text")


def missing_rates(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return profile.missing_rates(joined, ["text", "lang", "quality", "toxic"])


def completeness(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").where("lang = 'en'")
    return profile.completeness(joined, ["text", "source", "quality", "toxic"])


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return profile.split_leakage(_examples(spark, d))


def positive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return profile.positive_pairs(_examples(spark, d), F.col("esci_label") == "click")


def facets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facet_counts(items(spark, d))


def part_colors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.groupBy("p_name").agg(F.count("*").alias("n")).select("p_name", "n", colors.normalize_color(F.col("p_name")).alias("color"), F.array_join(colors.query_colors(F.col("p_name")), ",").alias("asked"))


def json_replies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Sure: "), F.coalesce(F.col("props").cast("string"), F.lit("")), F.lit(" done")).alias("reply"))
    return enrich.styles_of(e, ["event_id"]).groupBy("style").agg(F.count("*").alias("n"), F.count_distinct("query").alias("texts"))


def work_list(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit("text"), F.lit("image"))).alias("source"))
    done = table(spark, d, "events").select(F.col("event_id").alias("p_partkey"), F.when(F.col("user_id") % 2 == 0, "text").otherwise("image").alias("source"))
    return enrich.work_list(wanted, done, ["p_partkey", "source"])


def _paint(prompt: str) -> str:
    """Stands for a model: a chatty reply that follows from the prompt; it refuses one prompt in sixteen."""
    code = hashlib.md5(prompt.encode()).hexdigest()
    if code[0] == "0":
        raise ValueError("refused")
    return f'Sure: {{"color": "{("red", "blue", "plaid")[int(code[1:3], 16) % 3]}"}} done'


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Colours of all parts, asked for twice of a journaled model: titles first, then titles and photos."""
    p = table(spark, d, "part")
    prompt = T.render("Colour of {name} by {source}?", {"name": F.col("p_name"), "source": F.col("source")})
    wanted = p.select("p_partkey", "p_name", F.explode(F.array(F.lit("text"), F.lit("image"))).alias("source")).select("p_partkey", "source", prompt.alias("prompt"))
    journal = scratch_path(spark, "journal")
    ask = lambda rows: enrich.annotate(rows, ["p_partkey", "source"], "prompt", _paint, journal=journal)
    ask(wanted.where("source = 'text'")).write.format("noop").mode("overwrite").save()
    said = F.from_json(T.json_part(F.col("reply")), "map<string,string>")["color"]
    return ask(wanted).select("p_partkey", "source", F.when(said.isin(*colors.PALETTE), said).alias("color"), "error")


def whole_images(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the data of image files of four formats; one in five lacks its last bytes, one has a byte changed."""
    i, data = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("png", "jpeg", "gif", "webp")]), (i % 4 + 1).cast("int"))
    files = table(spark, d, "documents").select("doc_id", kind.alias("asked"), images.wrapped(data, kind).alias("file"))
    size = F.octet_length("file")
    cut = F.substring(F.col("file"), F.lit(1), (size - 1 - i % 10).cast("int"))
    other = F.when(F.hex(F.substring(F.col("file"), size - 13, F.lit(1))) == "00", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))  # never the byte that is there
    changed = F.concat(F.substring(F.col("file"), F.lit(1), size - 14), other, F.substring(F.col("file"), size - 12, F.lit(13)))
    bytes_ = F.when(i % 5 == 0, cut).when((i % 5 == 1) & (F.col("asked") == "png"), changed).otherwise(F.col("file"))
    return files.select("doc_id", size.cast("long").alias("n_bytes"), images.image_kind(bytes_).alias("kind"))


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of targets whose colour is one that the query asks for, by source of the query."""
    q = retrieval.target_queries(spark, d).select("query_id", "target_id", "source")
    i = items(spark, d).select(F.col("item_id").alias("target_id"), "color")
    palette = F.array(*[F.lit(c) for c in colors.PALETTE])
    asked = F.when(F.col("query_id") % 4 != 0, F.col("color")).otherwise(F.element_at(palette, (F.array_position(palette, F.col("color")) % len(colors.PALETTE) + 1).cast("int")))
    return q.join(i, "target_id").where("color <> ''").withColumn("asked", asked).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("asked") == F.col("color")).cast("int")), 6).alias("agreement"))


def method_agreement(spark: SparkSession, d: str) -> DataFrame:
    return enrich.agreement(_two_methods(spark, d))


def query_sizes(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.target_queries(spark, d).groupBy("generator", "source").agg(F.count("*").alias("queries"), F.count_distinct("target_id").alias("products"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).withColumnRenamed("item_id", "product_id")
    return catalog.export_bundle(rows, {"photo": rows.select("product_id"), "title": rows.select("product_id")})[1]


def document_text(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"), F.size(T.tokenize(F.col("text"))).cast("long").alias("tokens"), T.slug(F.col("text")).alias("slug"), T.clean_description(F.col("text"), 600).alias("description"))


def embedded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of whole texts from the default encoder, summed up by their length."""
    e = enrich.embed(retrieval.titles(spark, d), "doc_id", "title", "hashed-64")
    return e.select("doc_id", "model_id", "modality", F.size("embedding").cast("long").alias("d"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))


def us_corpus(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.when(k % 13 != 0, k % 97).cast("string").alias("product_id"), F.when(k % 11 != 0, F.col("p_name")).alias("product_title"), F.when(k % 2 == 0, "us").otherwise("es").alias("product_locale"), k.alias("seq"))
    return catalog.us_corpus(rows)


def clean_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.clean_query(F.col("text")).alias("query")).where("query is not null")
    return rows.withColumn("searchable", F.size(T.tokenize(F.col("query"))) > 0)


def rejected_filters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    color, category = F.when(k % 3 == 0, "white").when(k % 3 == 1, "teal"), F.when(k % 4 == 0, "L1").when(k % 4 == 1, "L2 > 2").when(k % 4 == 2, "L9")
    requests = table(spark, d, "events").select(k.alias("query_id"), color.alias("color"), category.alias("category"))
    return catalog.rejected_filters(requests, items(spark, d), colors.PALETTE)


def valid_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(k % 3 == 0, "red").when(k % 3 == 1, "teal").alias("color"), F.when(k % 2 == 0, "L1 > 1").otherwise("L9 > 9").alias("category"))
    return enrich.valid_labels(rows, colors.PALETTE, items(spark, d).where("category <> ''").select(F.col("category").alias("path")))


def cards(spark: SparkSession, d: str) -> DataFrame:
    c = _corpus(spark, d).withColumns({"image_url": F.concat(F.lit("http://img/"), "product_id"), "color": F.coalesce(colors.normalize_color(F.col("title")), F.lit("")), "category": F.lit(""), "description": F.col("ai_description"), "score": F.col("seq") / 7})
    return catalog.card(c)


def lookups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"))
    found, unknown = catalog.lookup(rows, table(spark, d, "events").select((F.col("user_id") * 7).alias("product_id")))
    return found.select("product_id", F.lit(True).alias("known")).unionByName(unknown.select("product_id", F.lit(False).alias("known")))


def judged_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = _examples(spark, d).withColumn("esci_label", F.substring(F.lit("ESCI"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1)))
    return profile.judged_titles(rows.select("query_id", "product_id", "product_locale", "esci_label").distinct(), _products(spark, d))


def _made_attributes(spark: SparkSession, d: str) -> DataFrame:
    k, palette = F.col("event_id"), F.array(*[F.lit(c) for c in colors.PALETTE])
    n = table(spark, d, "part").count()
    return table(spark, d, "events").select(
        (k * 3 % n).cast("string").alias("product_id"), F.when(k % 4 == 0, "open").otherwise("closed").alias("method"), F.element_at(palette, (k % 16 + 1).cast("int")).alias("color"),
        F.lit("").alias("color_name"), F.concat(F.lit("L"), (k % 5).cast("string"), F.lit(" > "), (k % 7).cast("string")).alias("category"), k.alias("seq"),
    )


def attributes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_attributes(catalog.gallery(_corpus(spark, d)).select("product_id"), _made_attributes(spark, d)).select("product_id", "color", "category", "category_l1")


def catalog_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Items of a gallery of a corpus, each published and read by the next; the corpus is there when it is asked for again."""
    path = scratch_path(spark, "catalog")
    tables.save_corpus(spark, f"{path}/corpus", lambda: _corpus(spark, d))
    rows = tables.save_corpus(spark, f"{path}/corpus", lambda: _corpus(spark, d).where("false"))
    shown = tables.save_gallery(rows, f"{path}/gallery")
    return tables.save_items(shown, _made_attributes(spark, d), f"{path}/items").select("product_id", "title", "price", "color", "category", "category_l1")


def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    return profile.table_sizes({n: table(spark, d, n) for n in ("events", "part", "documents", "conversations", "embeddings")})


def task_rows(spark: SparkSession, d: str) -> DataFrame:
    return catalog.task_slice(_examples(spark, d), "small_version", "1", "test").select("query_id", "product_id", "esci_label", "event_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Judgements whose queries are texts; some texts belong to several ids."""
    label = F.substring(F.lit("ESCI"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1))
    return _examples(spark, d).select("query_id", F.concat(F.lit("q"), (F.col("query_id") % 50).cast("string")).alias("query"), "product_id", label.alias("esci_label"), F.col("event_id").alias("seq"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    """How many right answers each query has at both levels; queries of one text share them."""
    return evaluate.answer_counts(*evaluate.test_set(_judged(spark, d)))


def gallery_queries(spark: SparkSession, d: str) -> DataFrame:
    """One writer's queries of gallery products that name a colour."""
    k = F.col("p_partkey")
    said = table(spark, d, "part").select(k.cast("string").alias("product_id"), F.concat(F.lit("a "), F.col("p_name")).alias("query"), F.when(k % 3 == 0, "A").otherwise("B").alias("generator"))
    return catalog.queries_of(said, gallery(spark, d), "A", with_color=True)


def merchant_results(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.bm25(spark, d).join(retrieval.titles(spark, d).select("doc_id", "merchant"), "doc_id")
    return catalog.of_merchant(found, "src1").select("query_id", "doc_id", "rank")


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Last part, slug and display cut of every url; its path read as a taxonomy line."""
    x = F.col("url")
    line = F.concat(F.col("page_id").cast("string"), F.lit(" - "), F.regexp_replace(F.regexp_replace(x, "^.*?://[^/]*/", ""), "/+", " > "))
    path = T.taxonomy_level2(line)
    return table(spark, d, "pages").select("page_id", T.base_name(x).alias("base"), T.slug(x).alias("slug"), F.substring(F.coalesce(x, F.lit("")), 1, 95).alias("shown"), path.alias("path"), T.category_level1(path).alias("level1"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.render("Title: {title}. Brand: {brand}.", {"title": F.col("p_name"), "brand": F.col("p_brand")}).alias("prompt"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return enrich.usage(e.select(F.col("user_id").alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"), F.when(F.col("event_type") == "error", "x").alias("error")))


def catalog_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus operator over a catalog, enriched texts and an image inventory."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("global_product_id"), F.col("p_brand").alias("advertiser_program_name"), F.concat(F.lit(" Amazon.com: "), F.col("p_name"), F.lit(" - Etsy ")).alias("most_recent_product_name"),
        F.when(k % 5 != 0, F.col("p_brand")).alias("most_recent_product_description"), F.concat(F.lit("http://x/"), k.cast("string")).alias("linked_product_url"),
        F.col("p_retailprice").cast("string").alias("most_recent_price"), F.lit(None).cast("string").alias("most_recent_product_image"), F.concat(F.lit("/images/"), k.cast("string"), F.lit(".jpg")).alias("outpath"), k.alias("seq"),
    )
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("global_product_id"), F.col("text").alias("text_description"), F.col("doc_id").alias("seq"))
    images = table(spark, d, "part").where(k % 7 != 0).select(F.concat(k.cast("string"), F.lit(".jpg")).alias("name"))
    return catalog.corpus(rows, texts, images).drop("seq")


def gallery_counts(spark: SparkSession, d: str) -> DataFrame:
    g = catalog.gallery(_corpus(spark, d))
    return g.agg(F.count("*").alias("items"), F.count_distinct("merchant").alias("merchants"), F.count_if(F.col("ai_description") != "(none)").alias("described"))


def described_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of products that have a description, joined to it."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    ids = texts.where(F.length("description") > 0).join(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", "left_semi").select("id")
    return evaluate.sample_ids(ids, 300).join(texts, "id", "left").select("id", F.md5("description").alias("described"))


def label_shares(spark: SparkSession, d: str) -> DataFrame:
    """Items with a colour, and queries whose target has one."""
    labelled = items(spark, d).agg(F.count("*").alias("items"), F.round(F.avg((F.col("color") != "").cast("int")), 6).alias("labelled"))
    asked = retrieval.target_queries(spark, d).join(items(spark, d).select(F.col("item_id").alias("target_id"), "color"), "target_id").agg(F.count_if(F.col("color") != "").alias("color_queries"))
    return labelled.crossJoin(asked)  # one row each


def _two_methods(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.coalesce(colors.normalize_color(F.col("p_name")), F.lit("")).alias("color"))
    shifted = p.withColumn("color", F.when(F.col("product_id") % 5 == 0, "clear").otherwise(F.col("color")))
    return p.withColumn("method", F.lit("closed")).unionByName(shifted.withColumn("method", F.lit("open")))


def method_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return enrich.disagreements(_two_methods(spark, d))


# ---------------------------------------------------------------- written and read again


#: Bytes of text in a CSV file, about.
CSV_BYTES = 32 << 20


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes and line ends as several CSV files, read by a glob with a schema."""
    path = scratch_path(spark, "csv")
    texts = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.repartition(max(3, -(-size // CSV_BYTES)), "doc_id")  # a file with line ends in its fields is read by one task
    texts.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = tables.read_csv(spark, f"{path}/*.csv", "doc_id long, text string, n_chars long")
    return back.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"), "n_chars")


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    for part in (0, 1):  # results are appended
        tables.append_results(table(spark, d, "conversations").where(F.col("turn") % 2 == part), path)
    return tables.read_jsonl(spark, path, "conv_id long, turn int, role string, text string").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


def vector_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two modalities; one of them is read back."""
    path, i = scratch_path(spark, "vectors"), items(spark, d)
    both = [i.select("item_id", F.lit("joint").alias("model_id"), F.lit(m).alias("modality"), F.col(f"{m}_vector").alias("embedding")) for m in ("photo", "title")]
    tables.write_vectors(both[0].unionByName(both[1]), path)
    e = F.col("embedding")
    return tables.read_vectors(spark, path, "joint", "title").select("item_id", F.size(e).cast("long").alias("d"), _weighted("embedding").alias("weighted"), F.round(F.element_at(e, 1), 6).alias("first"), F.round(F.element_at(e, -1), 6).alias("last"))


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A search over an index that was written and read."""
    path = scratch_path(spark, "index")
    lexical.write_index(table(spark, d, "documents"), path)
    return lexical.search(lexical.read_index(spark, path), retrieval.text_queries(spark, d), 50)


def metric_tables(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    tables.write_metrics(locale_counts(spark, d), path)
    return spark.read.schema("value string, n long").json(path)


def _bundle(rows: DataFrame, path: str) -> None:
    vectors = {x: rows.select("product_id", F.col(f"{x}_vector").alias("embedding")) for x in ("photo", "title")}
    tables.write_bundle(rows.select("product_id", "color", "category"), vectors, path, models={"photo": "joint", "title": "joint"}, built_at="2024-01-01T00:00:00+00:00")


def _weighted(e: str):  # noqa: ANN202
    """One number that every component counts in by its place."""
    return F.round(F.aggregate(F.zip_with(F.col(e), F.sequence(F.lit(1), F.size(e)), lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x), 5)


def bundle_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Items and both vectors of a bundle that was published twice, read from its current version."""
    path, rows = scratch_path(spark, "bundle"), items(spark, d).withColumnRenamed("item_id", "product_id")
    _bundle(rows.withColumn("color", F.lit("")), path)
    _bundle(rows, path)
    read = tables.read_bundle(spark, path, ("photo", "title"))
    out = read["items"]
    for x in ("photo", "title"):
        out = out.join(read[x].select("product_id", _weighted("embedding").alias(x)), "product_id")
    said = read["manifest"].select("photo_weight", F.element_at("models", "photo").alias("model"), F.array_join("palette", ",").alias("palette"), "built_at")
    return out.crossJoin(F.broadcast(said))  # one row


def file_order(spark: SparkSession, d: str) -> DataFrame:
    """First and last row of each key over CSV files of three folders, in the order of folders and rows."""
    path, i = scratch_path(spark, "ordered"), F.col("doc_id")
    rows = table(spark, d, "documents").select((i % 50).alias("key"), "doc_id", F.col("lang").alias("text"))
    for k in range(3):
        rows.where(i % 3 == k).repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id").write.option("header", True).csv(f"{path}/{2 - k}")
    back = tables.read_csv(spark, f"{path}/*/*.csv", "key long, doc_id long", ordered=True)
    ends = [first_of(back, ["key"], [order]).select("key", F.col("doc_id").alias(name)) for name, order in (("first_id", F.col("seq")), ("last_id", F.col("seq").desc()))]
    return ends[0].join(ends[1], "key")


def taxonomy_file(spark: SparkSession, d: str) -> DataFrame:
    """Second-level paths of a taxonomy file that is made of the items' categories and deeper and shallower lines."""
    path = scratch_path(spark, "taxonomy")
    c = items(spark, d).where("category <> ''").select("category", "category_l1").distinct()
    name = F.concat(F.lit("7 - "), F.col("category"))
    c.select(F.explode(F.array(name, F.concat(name, F.lit(" > deep")), F.concat(F.lit("8 - "), F.col("category_l1")), F.concat(F.lit("# "), F.col("category")))).alias("value")).write.text(path)
    return tables.read_taxonomy(spark, path)


def image_files(spark: SparkSession, d: str) -> DataFrame:
    """Which parts have an image file, by an inventory of names; a part's image is one of ten files, or not there at all."""
    path, k = scratch_path(spark, "images"), F.col("p_partkey")
    p = table(spark, d, "part")
    bodies = p.select((k % 12).alias("kind")).distinct().where("kind < 10").select("kind", F.lit("x").alias("value"))
    bodies.write.partitionBy("kind").text(path)
    found = tables.image_inventory(spark, path).select(F.regexp_extract("path", "kind=([0-9]+)/", 1).cast("long").alias("kind"), "length").where("length > 0").select("kind").distinct()
    have = p.select("p_partkey", (k % 12).alias("kind")).join(found.withColumn("have", F.lit(True)), "kind", "left")
    return have.select("p_partkey", F.coalesce("have", F.lit(False)).alias("have"))


def built_once(spark: SparkSession, d: str) -> DataFrame:
    """Built where it is missing, kept where it is not, and built anew where asked."""
    path, made = scratch_path(spark, "artifact"), []
    count = lambda n: locale_counts(spark, d).withColumn("build", F.lit(n))
    for n, rebuild in ((1, False), (2, False), (3, True), (4, False)):
        made.append(artifacts.build_if_missing(spark, path, lambda n=n: count(n), rebuild).select(F.lit(n).alias("run"), "value", "n", "build"))
    return reduce(DataFrame.unionByName, made)


def lower_titles(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a model that was trained on lower-case text, loaded in each worker; upper-case texts give the same."""
    texts = retrieval.titles(spark, d).select("doc_id", F.upper("title").alias("title"))
    e = enrich.embed(texts, "doc_id", "title", "vowels", load=lambda: lambda xs: np.array([[x.count(v) for v in "aeiou"] for x in xs]), lower=True)
    return e.select("doc_id", "model_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


def embedded_images(spark: SparkSession, d: str) -> DataFrame:
    """Image bytes as vectors: how often each upper half of a byte occurs."""
    files = table(spark, d, "documents").select("doc_id", images.wrapped(F.col("text").cast("binary"), F.lit("jpeg")).alias("file"))
    count = lambda: lambda xs: np.array([np.bincount(np.frombuffer(x, np.uint8) >> 4, minlength=16) for x in xs])
    e = enrich.embed(files, "doc_id", "file", "nibbles", modality="photo", blank=b"", load=count)
    return e.select("doc_id", "model_id", "modality", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


def export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table of a written bundle, and the manifest's own counts."""
    path, rows = scratch_path(spark, "bundle"), items(spark, d).withColumnRenamed("item_id", "product_id")
    _bundle(rows, path)
    read = tables.read_bundle(spark, path, ("photo", "title"))
    counts = [read[x].agg(F.lit(x).alias("part"), F.count("*").alias("n")) for x in ("items", "photo", "title")]
    said = read["manifest"]
    counts += [said.select(F.lit(f"manifest {c}").alias("part"), F.col(c).alias("n")) for c in ("items", "labelled")]
    return reduce(DataFrame.unionByName, counts)


EXAMPLES = """ex AS (SELECT user_id AS query_id, CAST(event_id % (SELECT count(*) FROM part) + 1 AS VARCHAR) AS product_id, CAST(user_id % 3 AS VARCHAR) AS product_locale, event_type AS esci_label,
event_id % 2 AS small_version, 1 AS large_version, CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, event_id FROM events)"""
CLEAN = "trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
CORPUS = f"""docs AS (SELECT doc_id, {CLEAN.format(x='text')} AS t FROM documents),
corpus AS (SELECT p_partkey AS seq, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title, p_brand AS merchant,
CASE WHEN CAST(p_retailprice AS DOUBLE) > 0 AND CAST(p_retailprice AS DOUBLE) <= 100000 THEN CAST(p_retailprice AS DOUBLE) END AS price,
CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || '-' || p_size END AS local_image,
CASE WHEN lower(coalesce(t, '')) IN ('', 'na') THEN '(none)' ELSE substr(t, 1, 600) END AS ai_description
FROM part LEFT JOIN docs ON doc_id = p_partkey)"""
I = retrieval.ITEMS
WEIGHTED = "round(list_sum(list_transform(range(1, len({x}) + 1), lambda i: i * {x}[i])), 5)"
_BY = ", ".join(f"'{w}': '{c}'" for w, c in colors.BY_WORD.items())
_SURE = ", ".join(f"'{w}': '{c}'" for w, c in colors.BY_WORD.items() if w not in colors.AMBIGUOUS)
NAMED = "list_filter(list_transform(regexp_extract_all({t}, '[a-z]+(?:-[a-z]+)?'), lambda w: MAP {{{m}}}[w]), lambda c: c IS NOT NULL)"
COLOR = f"""nm AS (SELECT p_name, count(*) AS n, lower(p_name) AS t, {NAMED.format(t='lower(p_name)', m=_BY)} AS named, {NAMED.format(t='lower(p_name)', m=_SURE)} AS sure FROM part GROUP BY p_name),
col AS (SELECT p_name, n, CASE WHEN (t LIKE '% and %' OR t LIKE '%/%' OR t LIKE '%,%' OR t LIKE '%&%') AND len(list_distinct(named)) > 1 THEN 'multicolor' WHEN len(named) > 0 THEN named[-1] END AS color,
CASE WHEN contains(t, 'rose gold') THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(sure)), ','), '') END AS asked FROM nm)"""

QUERIES = {
    "p3_corpus": corpus, "w2_gallery": gallery, "a14_corpus_counts": corpus_counts, "j1_judged_products": judged_join, "w2_keep_first": first_product, "a3_label_shares": label_counts,
    "a2_locale_counts": locale_counts, "a4_distinct_queries": query_counts, "a5_depth": query_depth, "a6_query_lengths": query_lengths, "a7_length_histogram": length_histogram, "a8_missing_rates": missing_rates,
    "a9_completeness": completeness, "a10_split_leakage": split_leakage, "a11_positive_pairs": positive_pairs, "a12_facets": facets, "f7_colors": part_colors, "f20_json_replies": json_replies, "j8_work_list": work_list, "x4_annotations": annotations, "s7_whole_images": whole_images,
    "e11_label_agreement": label_agreement, "e13_method_agreement": method_agreement, "a15_query_sizes": query_sizes, "a17_manifest": manifest, "f1_document_text": document_text, "x1_embedded_titles": embedded_titles,
    "p1_us_corpus": us_corpus, "p10_clean_queries": clean_queries, "p11_rejected_filters": rejected_filters, "p13_valid_labels": valid_labels, "p15_cards": cards, "p16_lookup": lookups,
    "j3_judged_titles": judged_titles, "j4_attributes": attributes, "a1_table_sizes": table_sizes, "a16_usage": usage,
    "p2_task_slice": task_rows, "e1_test_set": truth, "p5_gallery_queries": gallery_queries, "p14_merchant_results": merchant_results, "f5_url_parts": url_parts, "f21_prompts": prompts,
    "p3_catalog_corpus": catalog_corpus, "a14_gallery_counts": gallery_counts, "e14_described_sample": described_sample, "e11_label_shares": label_shares, "e13_disagreements": method_disagreements,
    "s2_csv_round_trip": csv_round_trip, "s4_jsonl_round_trip": jsonl_round_trip, "s9_vector_round_trip": vector_round_trip, "s10_index_round_trip": index_round_trip,
    "s12_metric_tables": metric_tables, "s13_export_bundle": export_round_trip, "s13_bundle_vectors": bundle_vectors, "s3_file_order": file_order, "s5_taxonomy_file": taxonomy_file, "s6_image_files": image_files,
    "s14_built_once": built_once, "s8_catalog_artifacts": catalog_artifacts, "f14_lower_titles": lower_titles, "x2_embedded_images": embedded_images,
}

ORACLE_SQL = {
    "p3_corpus": f"WITH {CORPUS} SELECT product_id, title, merchant, price, local_image, ai_description FROM corpus",
    "w2_gallery": f"""WITH {CORPUS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_image ORDER BY seq) AS k FROM corpus WHERE local_image <> '') WHERE k = 1)
SELECT product_id, title, merchant, local_image FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY seq) AS m FROM a) WHERE m = 1""",
    "a14_corpus_counts": f"WITH {CORPUS} SELECT count(*) AS total, count(*) FILTER (ai_description <> '(none)') AS enriched, count(*) FILTER (local_image <> '') AS with_image FROM corpus",
    "j1_judged_products": f"""WITH {EXAMPLES} SELECT p_brand AS product_brand, count(*) AS judgements, count(DISTINCT p_name) AS titles FROM ex LEFT JOIN part ON product_id = CAST(p_partkey AS VARCHAR)
WHERE small_version = 1 AND product_locale = '0' AND split = 'train' GROUP BY p_brand""",
    "w2_keep_first": f"WITH {EXAMPLES} SELECT query_id, product_id, esci_label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY event_id) AS k FROM ex) WHERE k = 1",
    "a3_label_shares": f"WITH {EXAMPLES} SELECT esci_label AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ex), 1) AS pct FROM ex WHERE esci_label IS NOT NULL GROUP BY esci_label",
    "a2_locale_counts": f"WITH {EXAMPLES} SELECT product_locale AS value, count(*) AS n FROM ex WHERE product_locale IS NOT NULL GROUP BY 1",
    "a4_distinct_queries": f"WITH {EXAMPLES} SELECT count(DISTINCT query_id) AS all_queries, count(DISTINCT query_id) FILTER (small_version = 1) AS small_version, count(DISTINCT query_id) FILTER (large_version = 1) AS large_version FROM ex",
    "a5_depth": f"WITH {EXAMPLES} SELECT product_locale, split, count(*) AS judgements, count(DISTINCT query_id) AS queries, round(count(*)::DOUBLE / count(DISTINCT query_id), 6) AS depth FROM ex GROUP BY ALL",
    "a6_query_lengths": r"""WITH n AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM (SELECT DISTINCT text FROM conversations))
SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, CAST(quantile_cont(n, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS q50, CAST(quantile_cont(n, 0.75) AS DOUBLE) AS q75, max(n) AS max FROM n""",
    "a7_length_histogram": r"SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, count(*) AS n FROM (SELECT DISTINCT text FROM conversations) GROUP BY 1 ORDER BY 1 LIMIT 15",
    "a8_missing_rates": """WITH j AS (SELECT text, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'text' AS field, round(avg((text IS NULL)::INT), 6) AS missing FROM j
UNION ALL SELECT 'lang', round(avg((lang IS NULL)::INT), 6) FROM j UNION ALL SELECT 'quality', round(avg((quality IS NULL)::INT), 6) FROM j UNION ALL SELECT 'toxic', round(avg((toxic IS NULL)::INT), 6) FROM j""",
    "a9_completeness": " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS filled, count(*) AS total, round(100.0::DOUBLE * count({c}) / count(*), 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en'" for c in ("text", "source", "quality", "toxic")
    ),
    "a10_split_leakage": f"WITH {EXAMPLES} SELECT count(*) AS leaking FROM (SELECT query_id FROM ex GROUP BY query_id HAVING count(DISTINCT split) > 1)",
    "a11_positive_pairs": f"WITH {EXAMPLES} SELECT count(*) AS pairs, count(DISTINCT query_id) AS queries, count(DISTINCT product_id) AS products FROM ex WHERE esci_label = 'click'",
    "a12_facets": f"""WITH {I} SELECT 'color' AS facet, color AS value, count(*) AS n FROM items WHERE color <> '' GROUP BY color UNION ALL SELECT 'category', category, count(*) FROM items WHERE category <> '' GROUP BY category
UNION ALL SELECT 'category_l1', category_l1, count(*) FROM items WHERE category_l1 <> '' GROUP BY category_l1""",
    "f7_colors": f"WITH {COLOR} SELECT p_name, n, color, asked FROM col",
    "f20_json_replies": "SELECT 'k' AS style, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS texts FROM events",
    "s7_whole_images": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 57 + n WHEN 1 THEN 32 + n WHEN 2 THEN 26 + n + (n + 254) // 255 ELSE 20 + n + n % 2 END AS n_bytes,
CASE WHEN doc_id % 5 = 0 OR (doc_id % 5 = 1 AND doc_id % 4 = 0) THEN NULL ELSE (['png', 'jpeg', 'gif', 'webp'])[doc_id % 4 + 1] END AS kind FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)""",
    "x4_annotations": """SELECT p_partkey, source, CASE WHEN h[1] <> '0' THEN (['red', 'blue', NULL])[('0x' || h[2:3])::INT % 3 + 1] END AS color, CASE WHEN h[1] = '0' THEN 'refused' END AS error
FROM (SELECT p_partkey, source, md5('Colour of ' || coalesce(p_name, '') || ' by ' || source || '?') AS h FROM part, (SELECT unnest(['text', 'image']) AS source))""",
    "j8_work_list": """SELECT p_partkey, source FROM part, (SELECT unnest(['text', 'image']) AS source) EXCEPT SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'text' ELSE 'image' END FROM events""",
    "e11_label_agreement": f"WITH {I} SELECT source, count(*) AS n, round(avg((query_id % 4 <> 0)::INT), 6) AS agreement FROM tq JOIN items ON item_id = target_id AND color <> '' GROUP BY source",
    "e13_method_agreement": f"""WITH {COLOR}, p AS (SELECT p_partkey, coalesce(color, '') AS a, CASE WHEN p_partkey % 5 = 0 THEN 'clear' ELSE coalesce(color, '') END AS b FROM part JOIN col USING (p_name))
SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS agreement FROM p""",
    "a15_query_sizes": f"WITH {I} SELECT generator, source, count(*) AS queries, count(DISTINCT target_id) AS products FROM tq GROUP BY ALL",
    "a17_manifest": f"WITH {I} SELECT count(*) AS items, count(*) FILTER (color <> '') AS labelled FROM items",
    "f1_document_text": f"""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS words, len({retrieval.TOKENS.format(x='text')}) AS tokens,
regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
CASE WHEN lower({CLEAN.format(x='text')}) IN ('', 'na') THEN '(none)' ELSE substr({CLEAN.format(x='text')}, 1, 600) END AS description FROM documents""",
    "p1_us_corpus": """WITH r AS (SELECT CAST(CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 97 END AS VARCHAR) AS product_id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS product_title,
CASE WHEN p_partkey % 2 = 0 THEN 'us' ELSE 'es' END AS product_locale, p_partkey AS seq FROM part)
SELECT product_id, product_title, product_locale, seq FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq) AS k FROM r WHERE product_locale = 'us' AND product_id IS NOT NULL AND product_title IS NOT NULL) WHERE k = 1""",
    "p10_clean_queries": f"""WITH c AS (SELECT conv_id, turn, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 200) AS query FROM conversations)
SELECT conv_id, turn, query, len({retrieval.TOKENS.format(x='query')}) > 0 AS searchable FROM c WHERE query <> ''""",
    "p11_rejected_filters": f"""WITH {I}, r AS (SELECT event_id AS query_id, CASE event_id % 3 WHEN 0 THEN 'white' WHEN 1 THEN 'teal' END AS color, CASE event_id % 4 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2 > 2' WHEN 2 THEN 'L9' END AS category FROM events)
SELECT query_id, 'color' AS reason FROM r WHERE color = 'teal' UNION ALL
SELECT query_id, 'category' FROM r WHERE category IS NOT NULL AND category NOT IN (SELECT category FROM items UNION SELECT category_l1 FROM items)""",
    "p13_valid_labels": f"""WITH {I} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'red' END AS color, CASE WHEN event_id % 2 = 0 AND 'L1 > 1' IN (SELECT category FROM items) THEN 'L1 > 1'
WHEN event_id % 2 = 1 AND 'L9 > 9' IN (SELECT category FROM items) THEN 'L9 > 9' END AS category FROM events""",
    "p15_cards": f"""WITH {CORPUS}, {COLOR} SELECT product_id, title, merchant, price, coalesce(nullif(local_image, ''), 'http://img/' || product_id) AS image, color, CAST(NULL AS VARCHAR) AS category,
ai_description AS description, round(seq / 7, 4) AS score FROM corpus JOIN col ON p_name = title""",
    "p16_lookup": "SELECT user_id * 7 AS product_id, user_id * 7 IN (SELECT p_partkey FROM part) AS known FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "j3_judged_titles": f"""WITH {EXAMPLES}, e AS (SELECT DISTINCT query_id, product_id, substr('ESCI', event_id % 4 + 1, 1) AS esci_label FROM ex)
SELECT query_id, product_id, esci_label, coalesce(p_name, '') AS title, row_number() OVER (PARTITION BY query_id ORDER BY instr('ESCI', esci_label), product_id) AS place FROM e LEFT JOIN part ON product_id = CAST(p_partkey AS VARCHAR)""",
    "j4_attributes": f"""WITH {CORPUS}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_image ORDER BY seq) AS k FROM corpus WHERE local_image <> '') WHERE k = 1),
h AS (SELECT product_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY seq) AS m FROM g) WHERE m = 1),
m AS (SELECT CAST(event_id * 3 % (SELECT count(*) FROM part) AS VARCHAR) AS product_id, max(event_id) AS k FROM events WHERE event_id % 4 <> 0 GROUP BY 1)
SELECT product_id, coalesce(([{retrieval.PALETTE}])[k % 16 + 1], '') AS color, coalesce('L' || (k % 5) || ' > ' || (k % 7), '') AS category, coalesce('L' || (k % 5), '') AS category_l1 FROM h LEFT JOIN m USING (product_id)""",
    "a1_table_sizes": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS \"rows\", (SELECT count(*) FROM (DESCRIBE {t})) AS columns" for t in ("events", "part", "documents", "conversations", "embeddings")),
    "a16_usage": "SELECT CAST(sum(user_id) AS BIGINT) AS tokens_in, CAST(sum(event_id % 50) AS BIGINT) AS tokens_out, round(avg(user_id), 6) AS mean_in, count(*) FILTER (event_type = 'error') AS failures FROM events",
    "p2_task_slice": f"WITH {EXAMPLES} SELECT query_id, product_id, esci_label, event_id FROM ex WHERE small_version = 1 AND product_locale = '1' AND split = 'test'",
    "e1_test_set": f"""WITH {EXAMPLES}, e AS (SELECT query_id, 'q' || (query_id % 50) AS query, product_id, substr('ESCI', event_id % 4 + 1, 1) AS l FROM ex WHERE query_id IS NOT NULL),
t AS (SELECT DISTINCT 'strict' AS relevance, query, product_id FROM e WHERE l = 'E' UNION ALL SELECT DISTINCT 'lenient', query, product_id FROM e WHERE l IN ('E', 'S'))
SELECT relevance, query_id, count(*) AS answers FROM (SELECT DISTINCT query_id, query FROM e) JOIN t USING (query) GROUP BY ALL""",
    "p5_gallery_queries": f"""WITH {CORPUS}, {COLOR}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_image ORDER BY seq) AS k FROM corpus WHERE local_image <> '') WHERE k = 1),
g AS (SELECT product_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY seq) AS m FROM a) WHERE m = 1)
SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'a ' || p_name AS query, 'A' AS generator FROM part JOIN col USING (p_name) WHERE p_partkey % 3 = 0 AND asked <> '' AND CAST(p_partkey AS VARCHAR) IN (SELECT product_id FROM g)""",
    "p14_merchant_results": f"WITH {retrieval.BM25} SELECT query_id, doc_id, rank FROM bm25 JOIN titles USING (doc_id) WHERE merchant = 'src1'",
    "f5_url_parts": r"""WITH l AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^.*?://[^/]*/', ''), '/+', ' > ', 'g') AS p FROM pages),
k AS (SELECT *, CASE WHEN len(string_split(p, ' > ')) = 2 THEN p END AS path FROM l)
SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(coalesce(url, ''), 1, 95) AS shown, path, coalesce(string_split(path, ' > ')[1], '') AS level1 FROM k""",
    "f21_prompts": "SELECT p_partkey, 'Title: ' || coalesce(p_name, '') || '. Brand: ' || coalesce(p_brand, '') || '.' AS prompt FROM part",
}

ORACLE_SQL |= {
    "p3_catalog_corpus": """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS description, coalesce(text, '') AS ai_description,
p_brand AS merchant, CAST(p_retailprice AS DOUBLE) AS price, 'http://x/' || p_partkey AS url, '' AS image_url, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey || '.jpg' ELSE '' END AS local_image
FROM part LEFT JOIN documents ON doc_id = p_partkey""",
    "a14_gallery_counts": f"""WITH {CORPUS}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_image ORDER BY seq) AS k FROM corpus WHERE local_image <> '') WHERE k = 1),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY seq) AS m FROM a) WHERE m = 1)
SELECT count(*) AS items, count(DISTINCT merchant) AS merchants, count(*) FILTER (ai_description <> '(none)') AS described FROM g""",
    "e14_described_sample": """SELECT id, md5(text) AS described FROM (SELECT doc_id AS id, text FROM documents WHERE len(text) > 0 AND doc_id IN (SELECT p_partkey FROM part)
ORDER BY md5('0:' || doc_id), doc_id LIMIT 300)""",
    "e11_label_shares": f"""WITH {I} SELECT (SELECT count(*) FROM items) AS items, (SELECT round(avg((color <> '')::INT), 6) FROM items) AS labelled,
(SELECT count(*) FROM tq JOIN items ON item_id = target_id WHERE color <> '') AS color_queries""",
    "e13_disagreements": f"""WITH {COLOR} SELECT p_partkey AS product_id, coalesce(color, '') AS closed, 'clear' AS open FROM part JOIN col USING (p_name) WHERE p_partkey % 5 = 0 AND coalesce(color, '') <> 'clear'""",
    "s2_csv_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text, n_chars FROM documents",
    "s4_jsonl_round_trip": "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations",
    "s9_vector_round_trip": f"WITH {I} SELECT item_id, CAST(len(tv) AS BIGINT) AS d, {WEIGHTED.format(x='tv')} AS weighted, round(tv[1], 6) AS first, round(tv[-1], 6) AS last FROM items",
    "s10_index_round_trip": retrieval.ORACLE_SQL["r2_bm25_search"],
    "s12_metric_tables": ORACLE_SQL["a2_locale_counts"],
    "s13_bundle_vectors": f"""WITH {I} SELECT item_id AS product_id, color, category, {WEIGHTED.format(x='pv')} AS photo, {WEIGHTED.format(x='tv')} AS title, 0.7::DOUBLE AS photo_weight, 'joint' AS model,
'{",".join(colors.PALETTE)}' AS palette, '2024-01-01T00:00:00+00:00' AS built_at FROM items""",
    "s3_file_order": """SELECT doc_id % 50 AS key, arg_min(doc_id, (2 - doc_id % 3) * 1000000000000 + doc_id) AS first_id, arg_max(doc_id, (2 - doc_id % 3) * 1000000000000 + doc_id) AS last_id FROM documents GROUP BY 1""",
    "s5_taxonomy_file": f"WITH {I} SELECT DISTINCT category AS path, category_l1 AS l1 FROM items WHERE category <> ''",
    "s6_image_files": "SELECT p_partkey, p_partkey % 12 < 10 AS have FROM part",
    "s8_catalog_artifacts": f"""WITH {CORPUS}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_image ORDER BY seq) AS k FROM corpus WHERE local_image <> '') WHERE k = 1),
h AS (SELECT product_id, title, price FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY seq) AS m FROM g) WHERE m = 1),
m AS (SELECT CAST(event_id * 3 % (SELECT count(*) FROM part) AS VARCHAR) AS product_id, max(event_id) AS k FROM events WHERE event_id % 4 <> 0 GROUP BY 1)
SELECT product_id, title, price, coalesce(([{retrieval.PALETTE}])[k % 16 + 1], '') AS color, coalesce('L' || (k % 5) || ' > ' || (k % 7), '') AS category, coalesce('L' || (k % 5), '') AS category_l1 FROM h LEFT JOIN m USING (product_id)""",
    "s14_built_once": f"""WITH {EXAMPLES} SELECT run, product_locale AS value, count(*) AS n, CASE WHEN run < 3 THEN 1 ELSE 3 END AS build FROM ex, (SELECT unnest([1, 2, 3, 4]) AS run) GROUP BY run, product_locale""",
    "f14_lower_titles": """SELECT doc_id, 'vowels' AS model_id, array_to_string(list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: length(t) - length(replace(t, v, ''))), ',') AS vector
FROM (SELECT doc_id, lower(upper(coalesce(text, ''))) AS t FROM documents)""",
    "x2_embedded_images": """SELECT doc_id, 'nibbles' AS model_id, 'photo' AS modality, array_to_string(list_transform(['0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'A', 'B', 'C', 'D', 'E', 'F'],
  lambda d: length(h) - length(replace(h, d, ''))), ',') AS vector FROM (SELECT doc_id, regexp_replace(CASE WHEN text IS NOT NULL THEN 'FFD8FFE000104A46494600010100000100010000FFDA0008010100003F00' || hex(text) || 'FFD9' ELSE '' END, '(.).', '\\1', 'g') AS h FROM documents)""",
    "x1_embedded_titles": f"""WITH titles AS (SELECT doc_id, text AS title FROM documents), c AS (SELECT doc_id, {retrieval.CODES.format(x='title')} AS h FROM titles),
v AS (SELECT doc_id, {retrieval.HASHED.format(x='h')} AS v FROM c), u AS (SELECT doc_id, {retrieval.UNIT.format(x='v')} AS u FROM v)
SELECT doc_id, 'hashed-64' AS model_id, 'title' AS modality, 64::BIGINT AS d, round(list_dot_product(u, u), 4) AS length FROM u""",
    "s13_export_bundle": f"""WITH {I} SELECT unnest(['items', 'photo', 'title', 'manifest items']) AS part, count(*) AS n FROM items UNION ALL SELECT 'manifest labelled', count(*) FROM items WHERE color <> ''""",
}

QUERIES["p14_merchant_results_whole"] = merchant_results  # an earlier name
ORACLE_SQL["p14_merchant_results_whole"] = ORACLE_SQL["p14_merchant_results"]
