"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, line_dedup, media, merkle, mixing, near_dup, packing, repair, secrets, token_codes, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents")).drop("source")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.grade(documents, toxicity.train(documents, _table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(_table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(_table(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.spelled_twice(pages))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(documents, counts=True).drop("source")


def op10_line_dedup_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the pipeline cuts: also lines on over a hundredth of a source."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(documents, low_ratio=line_dedup.LOW_RATIO, counts=True).drop("source")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(_table(spark, sf_dir, "documents"))


def op12_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.file_digests(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_media": op2_media,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_secrets": op6_secrets,
    "op7_multi_index": op7_multi_index,
    "op8_url_filter": op8_url_filter,
    "op9_near_dup": op9_near_dup,
    "op10_line_dedup": op10_line_dedup,
    "op10_line_dedup_low": op10_line_dedup_low,
    "op11_merkle": op11_merkle,
    "op12_token_codes": op12_token_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op10_line_dedup_low": line_dedup.LOW_ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
}
