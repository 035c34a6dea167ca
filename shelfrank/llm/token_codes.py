"""Token ids in files that give any token without decoding a block: directly addressable codes.

An id is split into chunks of CHUNK_BITS bits, lowest first. Level 1 of a file has the first chunk of every id and a
bitmap that says which ids go on; level 2 has the second chunk of those, with a bitmap of its own, and so on. A rank
directory (ones before every RANK_EVERY bits) tells where an id that goes on lies in the next level: reading a token is
one chunk, one bit and one rank per level. Frequent ids are small in common vocabularies, so most end early.

A file: the magic, then little-endian the numbers of ids, documents and levels, the ends of the documents (in ids),
and per level its number of chunks, the chunks, the bitmap and the directory, each at a multiple of 8 bytes.

Texts are dealt to ranges by document id, and tokenized and written there in that order, in files of about FILE_IDS ids (a
longer document has its file to itself). Files are rows of a Parquet
table, so any store that Spark writes will do; ``(part, file)`` orders them, and one count per range, at the driver,
gives each its first id.

A null text is empty: just the end id. Null document ids come first; rows of one id are ordered by a checksum of their text, and
equal rows are documents of their own. Extra columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches
from .packing import WordIds, token_bytes, tokenizer_file

MAGIC = b"DACIDS1\0"
#: Bits in a chunk (8 or 16: a chunk is a whole number), and bits of a bitmap between two entries of its directory.
CHUNK_BITS, RANK_EVERY = 8, 512
#: Ids in a file, about.
FILE_IDS = 1 << 20


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode(ids: np.ndarray, ends: np.ndarray, bits: int = CHUNK_BITS) -> bytes:
    """The file of ``ids``, whose documents end before ``ends``."""
    kind, rest, levels = np.dtype(f"<u{bits // 8}"), ids.astype(np.uint32), []
    while True:
        on = rest >> bits > 0
        ones = np.add.reduceat(on, np.arange(0, len(on), RANK_EVERY)) if len(on) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + _padded((rest & ((1 << bits) - 1)).astype(kind).tobytes()) + _padded(np.packbits(on, bitorder="little").tobytes()) + ranks.tobytes())
        rest = rest[on] >> bits
        if not len(rest):
            break
    return MAGIC + struct.pack("<QQII", len(ids), len(ends), len(levels), bits) + ends.astype("<u8").tobytes() + b"".join(levels)


class TokenFile:
    """Reads ids of a file of ``encode``. Opening it reads no chunk."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n, documents, n_levels, self.bits = struct.unpack_from("<QQII", data, 8)
        at = 32
        self.ends = np.frombuffer(data, "<u8", documents, at)
        at += 8 * documents
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks, at = np.frombuffer(data, f"<u{self.bits // 8}", n, at + 8), at + 8
            at += -(-n * self.bits // 64) * 8
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += -(-n // 64) * 8
            ranks = np.frombuffer(data, "<u8", -(-n // RANK_EVERY) + 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit ``i``: an entry of the directory and the few bytes after it."""
        block = i // RANK_EVERY
        ones = int(ranks[block]) + int.from_bytes(bitmap[block * RANK_EVERY // 8 : i // 8].tobytes(), "little").bit_count()
        return ones + (int(bitmap[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def token(self, i: int) -> int:
        """The id at place ``i``; of every level one chunk and one bit are read."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << k * self.bits
            if not bitmap[i // 8] >> i % 8 & 1:
                return out
            i = self._rank(bitmap, ranks, i)
        raise ValueError("an id goes on behind the last level")

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of a slice, as little-endian 32-bit numbers: only its own part of each level is read."""
        out, at = np.zeros(max(0, stop - start), "<u4"), np.arange(max(0, stop - start))
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[start:stop].astype(np.uint32) << np.uint32(k * self.bits)
            on = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            at = at[on]
            start = self._rank(bitmap, ranks, start)
            stop = start + len(at)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _writer(path: str, file_ids: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files of a sorted range: ``part, file, inside, n_ids, doc_ids, data``; ``inside`` counts the range's ids before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, inside = TaskContext.get().partitionId(), 0, 0
        words = WordIds(path)
        keys, held, ends, n = [], [], [], 0

        def file(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal number, inside, n
            data = encode(np.frombuffer(b"".join(held), "<u4"), np.asarray(ends), bits)
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int64()), (inside, pa.int64()), (n, pa.int64()), (list(keys), pa.list_(kind)), (data, pa.binary()))]
            number, inside, n = number + 1, inside + n, 0
            keys.clear(), held.clear(), ends.clear()
            return pa.record_batch(row, names=["part", "file", "inside", "n_ids", "doc_ids", "data"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = token_bytes(text.as_py(), words)
                if n and n + len(own) // 4 > file_ids:
                    yield file(kind)
                keys.append(key)
                held.append(own)
                n += len(own) // 4
                ends.append(n)
        if n:
            yield file(kind)

    return run


def write_files(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, file_ids: int = FILE_IDS, bits: int = CHUNK_BITS) -> None:
    """Write the token files of ``documents`` under ``path``, in ascending order of their ids."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")), F.col("text")]
    ranged = texts.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    kind = texts.schema["doc_id"].dataType.simpleString()
    files = ranged.mapInArrow(_writer(tokenizer or tokenizer_file(), file_ids, bits), f"part int, file long, inside long, n_ids long, doc_ids array<{kind}>, data binary")
    files.write.mode("overwrite").option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` with the number of ids before each, ``first``."""
    files = spark.read.parquet(path)
    rows, before = [], 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row for each range that was written
        rows.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "part int, before long")
    return files.join(F.broadcast(offsets), "part").withColumn("first", F.col("before") + F.col("inside")).drop("before", "inside")


def documents_in(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in ``read_files`` rows, each read by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for first, keys, data in zip(batch["first"], batch["doc_ids"], batch["data"], strict=True):
                own = TokenFile(memoryview(data.as_buffer()))
                starts = np.concatenate([[0], own.ends[:-1]]).astype(np.int64) + first.as_py()
                found = [own.document(k) for k in range(len(own.ends))]
                lengths, sums = [len(x) for x in found], [zlib.crc32(x.tobytes()) for x in found]
                yield pa.record_batch([pa.array(keys.as_py(), kind), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return files.select("first", "doc_ids", "data").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """``place, token`` of every global place asked for in ``places(place)``; places that no file has give no row.

    Every range of a million places is looked up in the files that reach into it, by a join on that range's number.
    """
    span = 1 << 20
    reach = F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((F.col("first") + F.col("n_ids") - 1) / span)))
    known = files.where("n_ids > 0").select("part", "file", "first", "n_ids", reach.alias("range"))
    asked = places.select("place", F.floor(F.col("place") / span).alias("range")).join(known, "range").where("place >= first and place < first + n_ids")
    each = asked.groupBy("part", "file").agg(F.collect_set(F.col("place") - F.col("first")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, wanted, data in zip(batch["first"], batch["places"], batch["data"], strict=True):
                own, at = TokenFile(memoryview(data.as_buffer())), wanted.as_py()
                yield pa.record_batch([pa.array([first.as_py() + i for i in at], pa.int64()), pa.array([own.token(i) for i in at], pa.int64())], names=["place", "token"])

    return files.join(each, ["part", "file"]).select("first", "places", "data").mapInArrow(run, "place long, token long")


def file_digests(documents: DataFrame) -> DataFrame:
    """All ``documents`` written as token files and read back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-files")
    write_files(documents, path)
    return documents_in(read_files(spark, path))
