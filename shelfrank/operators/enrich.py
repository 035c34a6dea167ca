"""Enrichment with models that the caller supplies, as resumable jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_part
from .annotate import annotate, may_pass

__all__ = ["annotate", "may_pass"]

#: Words whose hashes a Python worker keeps; some 50 MB.
KEPT_WORDS = 1 << 18
_CODES: dict[bytes, int] = {}


def _codes(words: list[bytes]) -> np.ndarray:
    """The first 32 bits of the words' MD5, -1 for an empty word."""
    if len(_CODES) > KEPT_WORDS:
        _CODES.clear()
    codes = list(map(_CODES.get, words))
    for i in [i for i, code in enumerate(codes) if code is None]:
        word = words[i]
        codes[i] = _CODES[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") if word else -1
    return np.array(codes, np.int64)


def hashed_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """Deterministic text vectors: signed token hashes, of length 1. A word that is in many of the texts is looked up once."""
    words = pc.ascii_split_whitespace(pa.array([text.lower() for text in texts], pa.large_string()))  # at ASCII blanks only
    each = words.flatten().dictionary_encode()
    codes = _codes(each.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
    place = np.where(codes < 0, 2 * size, codes % size * 2 + (codes >> 31))  # minus and plus of each dimension, and a place for empty words
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    n = np.bincount(row * (2 * size + 1) + place[each.indices.to_numpy()], minlength=len(texts) * (2 * size + 1)).reshape(len(texts), 2 * size + 1)
    out = (n[:, 1:-1:2] - n[:, :-1:2]).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


Encode = Callable[[list], np.ndarray]
#: Texts or images that an encoder gets at once, of like length.
ENCODED_AT_ONCE = 256
_LOADED: dict[str, Encode] = {}


def loaded(model_id: str, load: Callable[[], Encode]) -> Encode:
    """The encoder of ``model_id``: loaded at its first use in a Python worker and kept for all later tasks there."""
    if model_id not in _LOADED:
        _LOADED[model_id] = load()
    return _LOADED[model_id]


def by_length(encode: Encode, values: list, at_once: int = ENCODED_AT_ONCE) -> np.ndarray:
    """The vectors of ``values`` in their order; the encoder gets values of like length together."""
    order = sorted(range(len(values)), key=lambda i: len(values[i]))
    parts = [np.asarray(encode([values[i] for i in order[at : at + at_once]]), np.float32) for at in range(0, len(order), at_once)]
    out = np.concatenate(parts)
    out[order] = out.copy()
    return out


def embed(
    df: DataFrame, key: str, text: str, model_id: str, encode: Encode = hashed_encoder, modality: str = "title", blank: str | bytes = "", lower: bool = False, *, load: Callable[[], Encode] | None = None
) -> DataFrame:
    """``key, model_id, modality, embedding``; rows of different models never meet, as joins use model_id.

    ``text`` may be bytes (images) as well; ``blank`` stands for nulls and has the same type. ``lower`` is for models
    that were trained on lower-case text. A large model comes by ``load``, a function that makes the encoder: it runs
    once in each Python worker, whatever the number of tasks, and only the function travels with them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_by = encode if load is None else enrich.loaded(model_id, load)
        for batch in batches:
            if len(batch):
                vectors = by_length(run_by, [blank if x is None else x for x in batch["text"]])
                yield pd.DataFrame({key: batch[key], "model_id": model_id, "modality": modality, "embedding": list(vectors)})

    from . import enrich  # by its name: what a worker has loaded stays in the module, not in a copy of this function

    rows = df.select(key, (F.lower(F.col(text)) if lower else F.col(text)).alias("text"))
    return rows.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, model_id string, modality string, embedding array<float>")


def work_list(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def styles_of(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """One row per style and query text of a reply; blank texts go."""
    said = F.from_json(json_part(F.col(reply)), "map<string,string>")
    return replies.select(*keys, F.explode(said).alias("style", "query")).withColumn("query", F.trim("query")).where("query <> ''")


def valid_labels(rows: DataFrame, palette: tuple[str, ...], taxonomy: DataFrame) -> DataFrame:
    """Labels outside the vocabularies become null."""
    known = taxonomy.select(F.col("path").alias("_path")).distinct()
    out = rows.withColumn("color", F.when(F.col("color").isin(*palette), F.col("color"))).join(known, F.col("category") == F.col("_path"), "left")
    return out.withColumn("category", F.col("_path")).drop("_path")


def usage(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.avg("tokens_in"), 6).alias("mean_in"), F.count_if(F.col("error").isNotNull()).alias("failures"))


def agreement(rows: DataFrame) -> DataFrame:
    """How often two methods give a product one colour. ``rows(product_id, method, color)``."""
    a, b = (rows.where(F.col("method") == m).select("product_id", F.col("color").alias(m)) for m in ("closed", "open"))
    return a.join(b, "product_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("closed") == F.col("open")).cast("int")), 6).alias("agreement"))


def disagreements(rows: DataFrame) -> DataFrame:
    """``product_id, closed, open`` where the two methods differ. ``rows(product_id, method, color)``."""
    a, b = (rows.where(F.col("method") == m).select("product_id", F.col("color").alias(m)) for m in ("closed", "open"))
    return a.join(b, "product_id").where(F.col("closed") != F.col("open"))
