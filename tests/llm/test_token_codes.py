"""Token files against the tokenizer, by document, by slice and by single token."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import queries, token_codes
from shelfrank.llm.packing import tokenizer_file


def plain(rows):
    """``doc_id, start, n_tokens, ids_crc32`` in order, from the whole tokenizer."""
    from tokenizers import Tokenizer

    whole, out, start = Tokenizer.from_file(tokenizer_file()), [], 0
    order = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), (r[1] or "").encode())
    for i, text in sorted(rows, key=order):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [8, 16])
def test_every_token_and_slice(bits):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = rng.integers(0, 1 << rng.integers(1, 33, n), dtype=np.uint64).astype(np.uint32) if n else np.zeros(0, np.uint32)
        own = token_codes.TokenFile(token_codes.encode(ids, np.array([n // 2, n]), bits))
        assert [own.token(i) for i in range(n)] == ids.tolist() and own.ends.tolist() == [n // 2, n]
        for _ in range(50):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert own.tokens(a, b).tolist() == ids[a:b].tolist()
        with pytest.raises(IndexError):
            own.token(n)


def test_single_tokens_read_few_bytes():
    """A token is found from the parts of a file around it: all other chunks may be anything."""
    ids = np.random.default_rng(1).integers(0, 49408, 20_000).astype(np.uint32)
    own = token_codes.TokenFile(token_codes.encode(ids, np.array([20_000])))
    i = 12_345
    levels = []
    for chunks, bitmap, ranks in own.levels:
        near = np.full_like(chunks, 255)
        near[i] = chunks[i]
        block = i // token_codes.RANK_EVERY * token_codes.RANK_EVERY // 8
        bits = np.full_like(bitmap, 255)
        bits[block : block + 64] = bitmap[block : block + 64]
        levels.append((near, bits, ranks))
        if not bitmap[i // 8] >> i % 8 & 1:
            break
        i = own._rank(bitmap, ranks, i)
    own.levels = levels
    assert own.token(12_345) == ids[12_345]


def test_query_equals_the_tokenizer(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in queries.op12_token_codes(spark, data).collect())
    assert got == [x[:4] for x in plain([tuple(r) for r in docs.collect()])]


def test_small_files_places_and_awkward_rows(spark, tmp_path):
    rows = [(i, f"word {i} and some more" * (i % 5)) for i in range(60)] + [(None, None), (None, "x"), (3, "same"), (3, "same"), (5, ""), (99, "w " * 30_000), (7, "É <|endoftext|> Ⅷ ñandú")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, part int").repartition(5)
    path, want = f"file://{tmp_path}/files", plain(rows)
    token_codes.write_files(docs, path, file_ids=100)
    files = token_codes.read_files(spark, path).cache()
    assert files.count() >= 4 and files.where("n_ids > 100").count() == 1
    assert sorted((tuple(r) for r in token_codes.documents_in(files).collect()), key=lambda r: r[1]) == [x[:4] for x in want]
    every = np.concatenate([x[4] for x in want])
    asked = spark.range(0, len(every) + 50, 37).select(F.col("id").alias("place"))
    assert {r.place: r.token for r in token_codes.tokens_at(files, asked).collect()} == {i: every[i] for i in range(0, len(every), 37)}


def test_empty_table(spark):
    assert token_codes.file_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
