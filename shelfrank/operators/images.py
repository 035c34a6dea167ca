"""Which image files are whole: their structure is walked to the end, pixels are not decoded.

PNG: every chunk's checksum, from header to end chunk. JPEG: segments by length, then scans up to the end marker. GIF:
blocks and sub-blocks up to the trailer. WebP: the lengths of the file and of its chunks. Bytes behind an image's own
end are allowed, as readers allow them. Null and empty contents are no image.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the formats: first bytes, and JPEG markers that stand alone.
PNG, GIFS, JPEG = b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a"), b"\xff\xd8"
ALONE = {0x01, *range(0xD0, 0xD8)}
START_OF_SCAN, END_OF_IMAGE = 0xDA, 0xD9


def _png(data: memoryview) -> bool:
    at, first = len(PNG), True
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, end = bytes(data[at + 4 : at + 8]), at + 8 + n
        if first != (kind == b"IHDR") or end + 4 > len(data) or zlib.crc32(data[at + 4 : end]) != struct.unpack_from(">I", data, end)[0]:
            return False
        if kind == b"IEND":
            return True
        at, first = end + 4, False
    return False


def _jpeg(raw: bytes) -> bool:
    at, scanned = 2, False
    while at + 2 <= len(raw):
        if raw[at] != 0xFF:
            return False
        marker = raw[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker == END_OF_IMAGE:
            return scanned
        elif marker in ALONE:
            at += 2
        else:
            if at + 4 > len(raw) or (n := struct.unpack_from(">H", raw, at + 2)[0]) < 2:
                return False
            at += 2 + n
            if marker == START_OF_SCAN:  # up to a marker that is not part of the scan
                scanned = True
                while (at := raw.find(b"\xff", at)) >= 0 and at + 1 < len(raw) and (raw[at + 1] == 0 or raw[at + 1] in ALONE):
                    at += 2
                if at < 0:
                    return False
    return False


def _gif(data: memoryview) -> bool:
    def table(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 0x80 else 0

    if len(data) < 13:
        return False
    at, pictures = 13 + table(data[10]), 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return pictures > 0
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 <= len(data):
            at += 11 + table(data[at + 9])
            pictures += 1
        else:
            return False
        while True:  # sub-blocks
            if at >= len(data):
                return False
            n = data[at]
            at += n + 1
            if n == 0:
                break
    return False


def _webp(data: memoryview) -> bool:
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    at, pictures = 12, 0
    if end > len(data):
        return False
    while at + 8 <= end:
        kind, n = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + n + n % 2
        pictures += kind in (b"VP8 ", b"VP8L", b"ANMF")
    return at == end and pictures > 0


def kind_of(raw: bytes | None) -> str | None:
    """``png``, ``jpeg``, ``gif`` or ``webp`` of a whole image; None for anything else."""
    if not raw or len(raw) < 12:
        return None
    data = memoryview(raw)
    if raw.startswith(PNG):
        return "png" if _png(data) else None
    if raw.startswith(JPEG):
        return "jpeg" if _jpeg(raw) else None
    if raw.startswith(GIFS):
        return "gif" if _gif(data) else None
    if raw.startswith(b"RIFF") and raw[8:12] == b"WEBP":
        return "webp" if _webp(data) else None
    return None


def image_kind(content: Column) -> Column:
    """The format of every whole image; null for other bytes."""

    @F.pandas_udf("string")
    def kinds(contents: pd.Series) -> pd.Series:
        return contents.map(kind_of)

    return kinds(content)


def readable_images(files: DataFrame, content: str = "content") -> DataFrame:
    """The rows of ``files`` whose bytes are a whole image, with its ``kind``."""
    return files.withColumn("kind", image_kind(F.col(content))).where("kind is not null")


# ---------------------------------------------------------------- containers from bytes, by expressions


def _big(n: Column, size: int = 4) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def _little(n: Column) -> Column:
    big = _big(n)
    return F.concat(*[F.substring(big, k, 2) for k in (7, 5, 3, 1)])


def wrapped(data: Column, kind: Column) -> Column:
    """``data`` (bytes without 0xFF) as the picture data of a file of ``kind``; its structure is whole, its pixels are not."""
    own, n = F.hex(data), F.octet_length(data)

    def chunk(name: str, body: Column) -> Column:
        typed = F.concat(F.lit(name.encode().hex()), body)
        return F.concat(_big(F.octet_length(F.unhex(body))), typed, _big(F.crc32(F.unhex(typed))))

    png = F.concat(F.lit(PNG.hex()), chunk("IHDR", F.lit(struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0).hex())), chunk("IDAT", own), chunk("IEND", F.lit("")))
    jpeg = F.concat(F.lit("ffd8ffe000104a46494600010100000100010000ffda0008010100003f00"), own, F.lit("ffd9"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(n / 255).cast("int") - 1), lambda i: F.concat(_big(F.least(F.lit(255), n - i * 255), 1), F.substr(own, i * 510 + 1, F.lit(510))))
    gif = F.concat(F.lit((b"GIF89a" + bytes(7)).hex() + "2c" + bytes(9).hex() + "08"), F.when(n > 0, F.array_join(parts, "")).otherwise(F.lit("")), F.lit("003b"))
    body = F.concat(F.lit(b"WEBPVP8 ".hex()), _little(n), own, F.when(n % 2 == 1, F.lit("00")).otherwise(F.lit("")))
    webp = F.concat(F.lit(b"RIFF".hex()), _little(F.length(body) / 2), body)
    return F.unhex(F.when(kind == "png", png).when(kind == "jpeg", jpeg).when(kind == "gif", gif).otherwise(webp))
