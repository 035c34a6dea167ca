"""WARC archives: write captures as records, read archives back, and assemble transactions.

Writing: every page gives a request, a response (or revisit) and a metadata record; request and metadata point to the
response by ``WARC-Concurrent-To``. Spark's text writer makes the files: a record's text ends with the two line ends
that WARC wants, which serve as the line separator. Reading: each file is split by ``Content-Length``. Assembly: one
grouping by the identifier of the response gives one nested row per capture.

Of the pages, only digests are grouped and joined; payloads stay where they are. Files may have any number of gzip
members (commonly one for each record) and are unpacked as a stream, record by record.

A null payload is empty. A null url leaves out ``WARC-Target-URI``; line ends in urls are percent-encoded. Of equal
payloads the smallest (page_id, url) is the response; equal rows keep identities of their own, and a null page_id comes
last. A file that ends within a record gives the records before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, hub_join, materialize, scratch_path
from .near_dup import components

CRLF = "\r\n"
#: Most bytes of payload in one archive file (a larger payload has a file of its own). Payloads are written in classes
#: of size, so that a number of records bounds the bytes.
FILE_BYTES, CLASSES = 32 << 20, (1 << 14, 1 << 18, 1 << 22, 1 << 25)
#: Packed bytes that are unpacked at a time.
CHUNK = 1 << 16
#: Fixed date of made records: equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``data``: 40 bits at a time, eight digits each."""
    digest = F.sha1(data)
    parts = [F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0"), HEX32, BASE32) for k in range(4)]
    return F.concat(*parts)


def _uuid(*parts: Column) -> Column:
    x = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cut = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def captures(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """One row per page with its digest, and for revisits the page and record that they refer to.

    Rows are known by their content and a number among equal ones, never by their place in the input. A narrow row per
    page is saved; revisits come from these alone. The pages themselves are only joined to the payloads that occur more
    than once (broadcast within a bound of bytes), to tell which of their pages is the response.
    """
    url = F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    own = ["page_id", "url", "digest", "payload_bytes"]
    large, tiny = rows.where(F.col("payload_bytes") >= min_bytes), rows.where(F.col("payload_bytes") < min_bytes)
    narrow = materialize(large.groupBy(*own).agg(F.count("*").alias("copies")), "warc-narrow")
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("o"), "page_id", "url", "copies")
    first = narrow.groupBy("digest").agg(F.min(order).alias("first"), F.sum("copies").alias("rows"), F.count("*").alias("n")).where("rows > 1")
    first = materialize(first, "warc-first")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))

    def capture(page_id: str, url: str, k: Column) -> Column:
        return _uuid(F.lit("capture"), F.col(page_id), F.col(url), F.col("digest"), k)

    def responses(found: DataFrame, k: Column) -> DataFrame:
        return found.select(*own, "payload", F.lit(False).alias("revisit"), capture("page_id", "url", k).alias("capture_id"), F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("long").alias("refers_page"))

    again = hub_join(narrow, first.drop("rows"), "digest", "page_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).where(~(is_first & (F.col("k") == 0)))
    revisits = again.select(
        *own, F.lit("").alias("payload"), F.lit(True).alias("revisit"), capture("page_id", "url", F.col("k")).alias("capture_id"),
        capture("first.page_id", "first.url", F.lit(0)).alias("refers_to"), F.col("first.page_id").alias("refers_page"),
    )
    heads = first.select(F.col("digest").alias("_digest"), "first")
    few = bounded(heads, F.octet_length("first.url") + 32)
    known = large.join(heads if few is None else F.broadcast(few), F.col("digest") == F.col("_digest"), "left")
    out = responses(known.where(F.col("first").isNull() | (is_first & (F.col("first.copies") == 1))), F.lit(0)).unionByName(revisits)
    if not first.where("first.copies > 1").isEmpty():  # equal rows at the head of a group: one of them is the response
        out = out.unionByName(responses(known.where(is_first & (F.col("first.copies") > 1)).dropDuplicates(["digest"]), F.lit(0)))
    if min_bytes > 0:
        each = tiny.groupBy(*own, "payload").agg(F.count("*").cast("int").alias("copies"))
        out = out.unionByName(responses(each.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))), F.col("k")))
    return out


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF * 2), block)


def write_archives(rows: DataFrame, path: str, classes: list[int] | None = None) -> None:
    """Write ``captures`` rows as ``.warc.gz`` files under ``path``; ``classes`` are the numbers of the size classes there are."""
    url, to = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.col("capture_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    request = _record(F.lit("request"), _uuid(F.lit("request"), F.col("capture_id")), [url, to, ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")))
    response = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("capture_id"),
        [url, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.col("refers_to")),
         ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))),
    )
    fields = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("refers-page: "), F.col("refers_page").cast("string")), F.lit(""))
    metadata = _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("capture_id")), [url, to, ("Content-Type", F.lit("application/warc-fields"))], fields)
    texts = F.explode(F.array(request, response, metadata)).alias("value")
    for c in range(len(CLASSES) + 1) if classes is None else sorted({0, *classes}):
        most = max(1, FILE_BYTES // CLASSES[c]) if c < len(CLASSES) else 1
        part = rows.where(size_class(F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))) == c).select(texts)
        part.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * most).text(path)


def size_class(n_bytes: Column) -> Column:
    """Number of the first of CLASSES that holds a payload, or of one more for larger ones."""
    out = F.lit(len(CLASSES))
    for c in range(len(CLASSES) - 1, -1, -1):
        out = F.when(n_bytes <= CLASSES[c], c).otherwise(out)
    return out


def _headers(block: bytes) -> dict[str, str]:
    """Names in lower case; values of a repeated name are joined by blanks."""
    out: dict[str, str] = {}
    for k, sep, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)):
        if sep:
            name = k.strip().lower()
            out[name] = f"{out[name]} {v.strip()}" if name in out else v.strip()
    return out


class Damaged(ValueError):
    """A file cannot be read on from here."""


def unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a plain or gzip file piece by piece; every gzip member, however many there are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    while len(view):
        member = zlib.decompressobj(31)
        at, n = 0, len(view)
        while not member.eof and at < n:
            try:
                yield member.decompress(view[at : at + CHUNK])
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from e
            at += CHUNK
        if not member.eof:
            return  # the file ends within a member
        view = view[min(at, n) - len(member.unused_data) :]
        if len(view) and view[0] == 0:  # padding between or after members
            view = memoryview(bytes(view).lstrip(b"\0"))


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each whole record of a file that comes in ``pieces``; one record is held at a time."""
    data, at, more = bytearray(), 0, iter(pieces)

    def grow() -> bool:
        nonlocal at
        for piece in more:
            del data[:at]
            at = 0
            data.extend(piece)
            return True
        return False

    while True:
        while True:  # line ends between records
            while len(data) - at < 4 and grow():
                pass
            if data[at : at + 2] != b"\r\n":
                break
            at += 2
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not grow():
                return
        head = bytes(data[at:end])
        if not head.startswith(b"WARC/"):
            raise Damaged("a record does not begin with its version")
        headers = _headers(head.partition(b"\r\n")[2])
        begin = len(head) + 4
        length = headers.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", length):
            raise Damaged("a record without a length")
        size = begin + int(length)
        while len(data) - at < size:
            if not grow():
                return
        yield headers, bytes(data[at + begin : at + size])
        at += size


_RECORD = pa.schema([(c, pa.string()) for c in ("type", "record_id", "concurrent_to", "refers_to", "url", "header_digest", "digest")]
                    + [("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("refers_page", pa.int64()), ("payload", pa.string()), ("error", pa.string())])


def _number(fields: dict[str, str], name: str) -> int | None:
    said = fields.get(name, "")
    return int(said) if re.fullmatch("-?[0-9]{1,18}", said) else None


def read_archives(spark: SparkSession, path: str, *, payload: bool = False, glob: str = "*.{txt,txt.gz,warc,warc.gz}") -> DataFrame:
    """One row per record of the files whose names fit ``glob``; digests and lengths are computed from the stored payload (of a revisit: its headers say them).

    ``concurrent_to`` has all identifiers of a record, parted by blanks. Where a file is damaged, a row with ``type``
    ``damaged`` and the ``error`` follows the records before it; a damaged member or record ends its file only.
    """

    def rows(content: bytes) -> Iterator[dict]:
        records = parse_records(unpacked(content))
        while True:
            try:
                h, block = next(records)
            except StopIteration:
                return
            except Damaged as e:
                yield {"type": "damaged", "error": str(e)}
                return
            kind = h.get("warc-type")
            row = {"type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "url": h.get("warc-target-uri")}
            if kind in ("response", "revisit"):
                head, _, body = block.partition(b"\r\n\r\n")
                row |= {"header_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": len(body)}
                if kind == "response":
                    row |= {"digest": base64.b32encode(hashlib.sha1(body).digest()).decode(), "payload": body.decode("utf-8", "replace") if payload else None}
                else:
                    row |= {"digest": row["header_digest"], "payload_bytes": _number(_headers(head), "content-length") or 0}
            elif kind == "metadata":
                fields = _headers(block)
                row |= {"page_id": _number(fields, "page-id"), "refers_page": _number(fields, "refers-page")}
            yield row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                part = []
                for row in rows(content.as_py()):
                    part.append(row)
                    if len(part) == 2000:
                        yield pa.RecordBatch.from_pylist(part, _RECORD)
                        part = []
                yield pa.RecordBatch.from_pylist(part, _RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _RECORD)
    return files.select("content").mapInArrow(read, ddl)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``request``, ``response`` and ``metadata``, joined through concurrent-to identifiers.

    Identifiers count in both directions: records that reach each other over any number of them are one capture, known by
    its response, else by its smallest record. Mostly requests and metadata name their response and nothing else; only
    records that are linked otherwise are followed from link to link. A capture has a handful of records, so groups are
    small. Records that point to nothing here make a row of their own; damaged places make none.
    """
    named = F.when(F.col("concurrent_to") != "", F.split("concurrent_to", " "))
    main = F.col("type").isin("response", "revisit")
    records = records.where("type is null or type <> 'damaged'")
    narrow = materialize(records.select("type", "record_id", "concurrent_to"), "warc-links")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce(named[0], F.col("record_id")))
    # who names more than one, is named by a response, or names what is no response, is linked otherwise
    odd = narrow.where((F.size(named) > 1) | (main & named.isNotNull())).select("record_id", F.explode(named).alias("to"))
    others = narrow.where(~main & (F.size(named) == 1)).select("record_id", named[0].alias("to"))
    astray = others.join(narrow.where(~main).select(F.col("record_id").alias("to")), "to", "left_semi")
    links = materialize(odd.unionByName(astray).where("record_id is not null"), "warc-links")
    if not links.isEmpty():
        touched = links.select(F.explode(F.array("record_id", "to")).alias("to")).distinct()
        near = others.join(touched, "to", "left_semi").unionByName(others.join(touched.withColumnRenamed("to", "record_id"), "record_id", "left_semi"))
        edges = links.unionByName(near.select("record_id", "to"))
        labels = components(edges.select(F.col("record_id").alias("a"), F.col("to").alias("b")))
        response = labels.join(narrow.where(main).select(F.col("record_id").alias("node")), "node").groupBy("label").agg(F.min("node").alias("_capture"))
        whole = labels.join(response, "label", "left").select(F.col("node").alias("record_id"), F.coalesce("_capture", "label").alias("_capture"))
        records = records.join(whole, "record_id", "left")
        key = F.coalesce("_capture", key)

    def one(kinds: tuple[str, ...], *names: str) -> Column:
        return F.max(F.when(F.col("type").isin(*kinds), F.struct("record_id", *names)))

    return records.groupBy(key.alias("capture_id")).agg(
        one(("request",), "url").alias("request"),
        one(("response", "revisit"), "type", "url", "digest", "header_digest", "payload_bytes", "refers_to", "payload").alias("response"),
        one(("metadata",), "page_id", "refers_page").alias("metadata"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back and return a flat row per capture."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    sizes = pages.agg(F.collect_set(size_class(F.coalesce(F.octet_length(F.col("html")), F.lit(0)))).alias("c")).first()["c"]  # at most len(CLASSES) + 1
    write_archives(captures(pages), path, sizes)
    whole = transactions(materialize(read_archives(spark, path), "warc-records"))  # archives are parsed once
    return whole.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("metadata.refers_page").alias("refers_to"),
    )


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
