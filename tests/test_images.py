"""Whole images of four formats: cut anywhere they are not, and what the walkers must not stumble over."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


PNG = images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1\2")) + chunk(b"IEND", b"")
#: Two scans, with stuffed 0xFF, restart markers and a fill byte.
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xff\xc0\0\4xy\xff\xda\0\4cd12\xff\0 34\xff\xd0 56\xff\xda\0\2" b"789\xff\xd9"
GIF = b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b"\x21\xf9\4\0\0\0\0\0" + b"\x2c" + bytes(9) + b"\2\3abc\1d\0" + b"\x3b"
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8 " + struct.pack("<I", 3) + b"abc\0"
WHOLE = {"png": PNG, "jpeg": JPEG, "gif": GIF, "webp": WEBP}


@pytest.mark.parametrize("kind", WHOLE)
def test_cut_anywhere_it_is_not_whole(kind):
    data = WHOLE[kind]
    assert images.kind_of(data) == images.kind_of(data + b"more") == kind
    assert all(images.kind_of(data[:n]) is None for n in range(len(data)))


def test_other_bytes_are_no_images():
    assert [images.kind_of(x) for x in (None, b"", b"GIF", b"not an image at all", b"RIFF\0\0\0\0WAVE", b"\xff\xd8" + bytes(20))] == [None] * 6
    bad = bytearray(PNG)
    bad[-20] ^= 1
    assert images.kind_of(bytes(bad)) is None and images.kind_of(images.PNG + PNG[33:]) is None
    assert images.kind_of(b"\xff\xd8\xff\xe0\0\4ab\xff\xd9xxxx") is None  # nothing scanned


def test_wrapped_bytes_are_whole_and_files_are_filtered(spark):
    rows = [(k * 10 + n, k, "é x" * n) for k, _ in enumerate(WHOLE) for n in (0, 1, 2, 85, 86, 700)]
    kinds = F.element_at(F.array(*[F.lit(x) for x in WHOLE]), F.col("k") + 1)
    files = spark.createDataFrame(rows, "id int, k int, t string").select("id", kinds.alias("asked"), images.wrapped(F.col("t").cast("binary"), kinds).alias("content"))
    files = files.unionByName(spark.createDataFrame([(99, "x", bytearray(b"no")), (98, "x", None)], "id int, asked string, content binary"))
    got = images.readable_images(files).collect()
    assert len(got) == len(rows) and all(r.kind == r.asked for r in got)


def test_a_changed_byte_is_another_byte(spark, tmp_path):
    """Document 16 is a PNG of which one byte of the checksum is changed; here that byte is 0 before."""
    import struct
    import zlib

    import __spark_entry__ as entry

    text = next(x for x in map(str, range(10_000)) if struct.pack(">I", zlib.crc32(b"IDAT" + x.encode()))[2] == 0)
    spark.createDataFrame([(16, text), (36, "plain")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.kind for r in entry.queries()["s7_whole_images"](spark, f"file://{tmp_path}").collect()] == [None, None]
