"""BM25 over tables: an index of blocks of postings, a search that answers a table of queries.

Documents are dealt to ranges by a hash of their id. A block is a term's postings in one range, with the largest of its
weights; a frequent term is in one block of every range, so no task gets it whole. Blocks are stored in buckets by a
hash of their term, so a search reads the buckets of its terms only. Before postings are unpacked, a query's ranges are
judged by the blocks' weights alone: where their sum cannot reach what k documents of one block have for certain,
the blocks of the range are passed over for that query.

Where there is no index, and the queries' terms are few, none is made for them: the texts are read once for these terms
alone (``write_matches``) and scored from that (``scan``).
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokenize
from ..sources.scratch import BROADCAST_BYTES, materialize, scratch_path, small
from .ranking import best_first, top_k

K1, B = 1.2, 0.75
#: Documents in a range: at least, and at most; between them so many that there are about RANGES.
LEAST_DOCS, MOST_DOCS, RANGES = 512, 1 << 15, 64
#: Ranges of which one is searched first, for a bar to the scores of all.
BAR_PART = 16
#: Bytes of text in a range, about.
RANGE_BYTES = 32 << 20
#: Postings that a bucket of terms holds, about, and the most buckets.
BUCKET_POSTINGS, MOST_BUCKETS = 1 << 22, 1 << 12
#: Words that a text must share with a passage in a row to be compared with it, if the passage has so many inside.
ANCHOR = 4
#: Bytes of a query's term, of an anchor, and of a query and a range in a broadcast, about.
TERM_BYTES, ANCHOR_BYTES, PAIR_BYTES = 128, 64, 32
#: Makes a blank of every byte of a lower-case text that is in no token.
BLANKS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
STOPS = tuple(word.encode() for word in STOP_WORDS)
#: Tokens that are counted at once, about.
TOKENS_AT_ONCE = 1 << 20
#: Bytes of text that are split at once, about.
PIECE_BYTES = 4 << 20
#: Changes with the tables of an index: one of another layout is not read.
LAYOUT = 3


class Index(NamedTuple):
    """Tables of an index.

    ``blocks(bucket, term, range, n, marks, posting)``, where ``posting`` lists documents and weights, and ``marks`` are the
    first, second, fourth, ... largest weights; ``terms(term, df, idf)``; the one-row ``stats(n, avgdl, ranges, buckets)``.
    """

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def _blocks(kind: str) -> str:
    return f"term string, range int, n long, marks array<double>, posting array<struct<doc:{kind},weight:double>>"


def _words(text: bytes | None) -> list[bytes]:
    """All tokens of a lower-case text, stop words too: as ``tokenize`` finds them, at a fraction of its cost."""
    return (text or b"").translate(BLANKS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of lower-case texts: their number, their tokens without stop words, and their bytes."""
    for batch in batches:
        total = size = 0
        for value in batch.column("text").cast(pa.binary()):
            words = _words(text := value.as_py())
            total += len(words) - sum(map(words.count, STOPS))
            size += len(text or b"")
        yield pa.record_batch({"n": [batch.num_rows], "total": [total], "size": [size]})


def _postings(texts: pa.Array | pa.ChunkedArray, codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Places of texts, codes of their terms and how often they are there, by place and code; and the texts' lengths.

    ``codes`` gets all terms. Stop words, which have the first codes, are left out.
    """
    parts, lengths, code, rows = [], [], array("i"), []

    def flush() -> None:
        """The texts since the last time, which are whole, to one posting a term."""
        of, row = np.array(code, np.int32), np.repeat(np.arange(len(lengths) - len(rows), len(lengths)), np.array(rows, np.int64))
        keep = of >= len(STOPS)
        each, tf = np.unique(row[keep] * len(codes) + of[keep], return_counts=True)
        parts.append(tuple(x.astype(np.int32) for x in (each // len(codes), each % len(codes), tf)))
        del code[:], rows[:]

    for value in texts.cast(pa.binary()):
        words = _words(value.as_py())
        code.extend(map(codes.__getitem__, words))
        rows.append(len(words))
        lengths.append(len(words) - sum(map(words.count, STOPS)))
        if len(code) >= TOKENS_AT_ONCE:
            flush()
    flush()
    return *map(np.concatenate, zip(*parts, strict=True)), lengths


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, of about PIECE_BYTES of text at once."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        for begin, end in pairwise([0, *np.flatnonzero(np.diff(upto // PIECE_BYTES)) + 1, batch.num_rows]):
            yield batch.slice(begin, end - begin)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What is between ASCII blanks of texts, also what is empty at their ends, and the place of the text of each."""
    words = pc.ascii_split_whitespace(texts)
    return words.flatten(), np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())


def _coded(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word in ``known``, or -1."""
    return pc.fill_null(pc.index_in(words, known), -1).to_numpy()


def _blanked(texts: pa.Array) -> pa.Array:
    """Lower-case texts with a blank for every byte that is in no token: all at once, as they lie in memory; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    blanked = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(BLANKS) if data else b""
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(blanked)])


def _matched(terms: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From lower-case texts to their lengths and their postings of ``terms``, which have the codes behind stop words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([*STOP_WORDS, *terms, ""], pa.large_string())
        for batch in _pieces(batches):
            words, at = _split(_blanked(batch.column("text")))
            of = _coded(words, known)
            keep = (of >= len(STOPS)) & (of < len(known) - 1)
            lengths = np.bincount(at[keep | (of < 0)], minlength=batch.num_rows)
            each, tf = np.unique(at[keep] * len(known) + of[keep], return_counts=True)
            row, code, tf = (x.astype(np.int32) for x in (each // len(known), each % len(known), tf))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            posting = pa.StructArray.from_arrays([pa.array(code), pa.array(tf)], ["code", "tf"])
            yield pa.record_batch([batch.column("doc_id"), pa.array(lengths, pa.int64()), size, pa.ListArray.from_arrays(ends, posting)], names=["doc_id", "total", "size", "posting"])

    return run


def _inverted(avgdl: float, k1: float, b: float) -> Callable[[pa.Table], pa.Table]:
    """From the lower-case texts of the documents of a range to its blocks."""

    def run(table: pa.Table) -> pa.Table:
        codes: dict[bytes, int] = defaultdict(count().__next__)
        for word in STOPS:
            codes[word]
        row, code, tf, lengths = _postings(table["text"], codes)
        # a range has millions of postings: small types, few arrays of them at once
        weights = (k1 * (1 - b + b * np.array(lengths, float) / avgdl))[row]
        weights += tf
        np.divide(tf, weights, out=weights)
        np.negative(weights, out=weights)
        order = np.lexsort((weights, code))
        sizes = np.bincount(code, minlength=len(codes))
        del code, tf
        weights, row = np.negative(weights[order]), row[order]
        del order
        terms = [word.decode() for word, n in zip(codes, sizes, strict=True) if n]
        sizes = sizes[sizes > 0]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        # the marks of a block of n: places 0, 1, 3, ... in it, and the last one
        n_marks = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int) + 1
        mark_ends = np.concatenate([[0], np.cumsum(n_marks)])
        nth = np.arange(mark_ends[-1]) - np.repeat(mark_ends[:-1], n_marks)
        marks = weights[np.minimum((1 << nth) - 1, np.repeat(sizes, n_marks) - 1) + np.repeat(ends[:-1], n_marks)] if len(terms) else weights
        docs = table["doc_id"].combine_chunks()
        posting = pa.StructArray.from_arrays([(pa.concat_arrays(docs.chunks) if isinstance(docs, pa.ChunkedArray) else docs).take(pa.array(row)), pa.array(weights)], ["doc", "weight"])
        at = lambda x: pa.array(x.astype(np.int32))
        return pa.table({
            "term": pa.array(terms, pa.string()), "range": pa.array([table["range"][0].as_py()] * len(terms), pa.int32()), "n": pa.array(sizes, pa.int64()),
            "marks": pa.ListArray.from_arrays(at(mark_ends), pa.array(marks)), "posting": pa.ListArray.from_arrays(at(ends), posting),
        })

    return run


def write_index(corpus: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> None:
    """Write the tables of an index under ``path``; counts include documents without tokens.

    Texts are read twice: for their number and mean length, and, dealt to ranges, for the blocks.
    """
    spark = corpus.sparkSession
    texts = corpus.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    counts = texts.select("text").mapInArrow(_counted, "n long, total long, size long")
    n, total, size = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in counts.columns]).first()
    ranges = ranges_of(n, size)
    buckets = min(MOST_BUCKETS, max(1, total // BUCKET_POSTINGS))
    dealt = by_range(texts.withColumn("range", range_of(F.col("doc_id"), ranges)), ranges)
    blocks = dealt.groupBy("slot", "range").applyInArrow(_inverted(max(total, 1) / max(n, 1), k1, b), _blocks(kind))
    blocks = blocks.withColumn("bucket", bucket_of(F.col("term"), F.lit(buckets)))
    if buckets > 1:  # a bucket's files are few, and sorted, so that a reader can skip parts of them
        blocks = blocks.repartition(F.col("bucket"), F.col("range") % 8).sortWithinPartitions("bucket", "term")
    blocks.write.partitionBy("bucket").parquet(f"{path}/blocks")
    read_blocks(spark, path, kind).groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", idf_of(n)).write.parquet(f"{path}/terms")
    spark.createDataFrame([(n, total / n if n else None, ranges, buckets, kind)], "n long, avgdl double, ranges int, buckets int, doc_kind string").coalesce(1).write.parquet(f"{path}/stats")


def idf_of(n: int) -> Column:
    return F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def ranges_of(n: int, size: int) -> int:
    """How many ranges ``n`` documents of ``size`` bytes are dealt to."""
    return max(1, -(-n // min(MOST_DOCS, max(LEAST_DOCS, n // RANGES))), -(-size // RANGE_BYTES))


def range_of(doc_id: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(ranges)).cast("int")


def by_range(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` with a ``slot``, dealt to one task for each slot: as many ranges to each task, where a hash would not."""
    slots = min(ranges, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.withColumn("slot", F.pmod("range", F.lit(slots))).repartitionById(slots, F.col("slot"))


def read_blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{_blocks(kind)}, bucket int").parquet(f"{path}/blocks")


def bucket_of(term: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def read_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats")
    return Index(read_blocks(spark, path, stats.first()["doc_kind"]), spark.read.parquet(f"{path}/terms"), stats)


def build_index(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> Index:
    """An index in the scratch folder."""
    path = scratch_path(corpus.sparkSession, "bm25")
    write_index(corpus, path, doc_id, text, k1, b)
    return read_index(corpus.sparkSession, path)


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``query_id, term, qtf``: a repeated term counts each time."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def hopeless(met: DataFrame, k: int) -> DataFrame:
    """``query_id, range`` whose documents are not among the best ``k``, by blocks' largest weights alone.

    ``met(query_id, range, w, marks)``: the blocks of each query's terms. If a block has k weights of x and more, k
    documents score x at least; a range whose largest weights sum up to less (by more than rounding) is hopeless.
    """
    at = F.lit((k - 1).bit_length())  # the mark of k weights or more, or the last one
    sure = F.when(F.col("n") >= k, F.col("w") * F.coalesce(F.get("marks", at), F.element_at("marks", -1)))
    each = met.groupBy("query_id", "range").agg(F.sum(F.col("w") * F.col("marks")[0]).alias("most"), F.max(sure).alias("sure"))
    bar = F.max("sure").over(Window.partitionBy("query_id"))
    return each.withColumn("bar", bar).where(F.col("most") < F.col("bar") - 1e-5).select("query_id", "range")


def search(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """``query_id, doc_id, score, rank``: only documents that share a term, at most ``k`` per query.

    Query terms are broadcast within a bound of bytes, which also leaves out the buckets without any of them; beyond it
    they are joined by term.
    """
    stats = index.stats.first()
    terms = materialize(query_terms(queries), "query-terms")
    n, far = terms.count(), lambda df: df
    near = F.broadcast if n * TERM_BYTES <= BROADCAST_BYTES else far  # the next table has no more rows
    bucket = bucket_of(F.col("term"), F.lit(stats["buckets"])).alias("bucket")
    asked = near(materialize(index.terms.join(near(terms), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), bucket), "query-weights"))
    on = ["bucket", "term"]
    blocks = index.blocks.select(*on, "range", "posting")
    if near is not far:  # only blocks of the queries' terms are shuffled
        blocks = blocks.join(near(asked.select(*on)), on, "left_semi")
    # compact rows are shuffled by range, so scores are summed up where they arise and only top rows travel
    met = by_range(blocks, stats["ranges"]).join(asked, on)
    if stats["ranges"] > 1:
        over = hopeless(index.blocks.select(*on, "range", "n", "marks").join(asked, on), k)
        fits = n * stats["ranges"] * PAIR_BYTES <= BROADCAST_BYTES  # a query has a term, and passes over a range, once
        met = met.join((F.broadcast if fits else far)(over), ["query_id", "range"], "left_anti")
    hits = met.select("slot", "query_id", "w", F.inline("posting").alias("doc_id", "weight"))
    scored = hits.groupBy("slot", "query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("weight")), 6).alias("score"))
    return top_k(scored, k, ["query_id"], best_first()).select("query_id", "doc_id", "score", "rank")


def few_terms(queries: DataFrame) -> list[str] | None:
    """The different terms of ``queries`` if those of all queries are within the bound of a broadcast, else None."""
    most = BROADCAST_BYTES // TERM_BYTES
    terms = query_terms(queries).select("term").limit(most + 1).collect()
    return sorted({r["term"] for r in terms}) if len(terms) <= most else None


def write_matches(corpus: DataFrame, path: str, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``doc_id, total, size, posting`` of every document: its length, its bytes, and its ``terms``, by one reading."""
    texts = corpus.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts.mapInArrow(_matched(terms), f"doc_id {kind}, total long, size long, posting array<struct<code:int,tf:int>>").write.parquet(path)


def scan(matches: DataFrame, terms: list[str], queries: DataFrame, k: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """As ``search``, without an index: for queries of ``few_terms``, over what ``write_matches`` found of them.

    Documents are dealt to ranges, and a document's postings come together, so sums stay small and near. The best ``k`` of
    one part of the ranges give each query a score that the best ``k`` of all have at least.
    """
    n, total, size = matches.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges_of(n, size)
    df = matches.select(F.inline("posting")).groupBy("code").agg(F.count("*").alias("df"))
    named = matches.sparkSession.createDataFrame(pa.table({"code": pa.array(range(len(STOPS), len(STOPS) + len(terms)), pa.int32()), "term": pa.array(terms, pa.string())}))
    known = F.broadcast(named).join(F.broadcast(df), "code").select("code", "term", idf_of(n).alias("idf"))  # no more rows than terms
    asked = F.broadcast(materialize(query_terms(queries).join(F.broadcast(known), "term").select("query_id", "code", (F.col("qtf") * F.col("idf")).alias("w")), "query-weights"))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("total") / F.lit(max(total, 1) / max(n, 1)))
    dealt = matches.select("doc_id", "total", "posting", range_of(F.col("doc_id"), ranges).alias("range"))

    def scored(rows: DataFrame) -> DataFrame:
        """A range is a task: its sums are as many for larger tables."""
        each = rows.repartitionById(ranges, F.col("range")).select("range", "doc_id", norm.alias("norm"), F.inline("posting"))
        hits = each.select("range", "doc_id", "code", (F.col("tf") / (F.col("tf") + F.col("norm"))).alias("weight")).join(asked, "code")
        return hits.groupBy("range", "doc_id", "query_id").agg(F.round(F.sum(F.col("w") * F.col("weight")), 6).alias("score"))

    found = scored(dealt)
    if some := ranges // BAR_PART:  # what scores less than the last of the best k of some ranges needs no sorting
        bar = top_k(scored(dealt.where(F.col("range") < some)), k, ["query_id"], best_first()).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        found = found.join(F.broadcast(materialize(bar, "query-bars")), "query_id", "left").where("bar IS NULL OR score >= bar")
    return top_k(found, k, ["query_id"], best_first()).select("query_id", "doc_id", "score", "rank")


def _held(said: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents to those that contain a passage. ``said(query_id, passage, run)``: ``run`` are the words that are looked for.

    A run's words are followed one by one from all places of a text at once, so only places where its first ones are go on.
    """
    runs = [tuple(run) for run in said["run"].to_pylist()]
    words = sorted({word for run in runs for word in run})
    place, nodes, ends = {word: n for n, word in enumerate(words)}, {(): 0}, defaultdict(list)
    for n, run in enumerate(runs):
        for k in range(len(run)):
            nodes.setdefault(run[: k + 1], len(nodes))
        ends[nodes[run]].append(n)
    steps = sorted((nodes[run[:-1]] * len(words) + place[run[-1]], node) for run, node in nodes.items() if run)
    keys, then = np.array(steps, np.int64).reshape(-1, 2).T
    last = np.isin(np.arange(len(nodes)), list(ends))
    passages, ids = [passage.encode() for passage in said["passage"].to_pylist()], said["query_id"].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.large_string())
        for batch in _pieces(batches):
            each, at = _split(batch.column("text").cast(pa.large_string()))
            code, texts, found = _coded(each, known), batch.column("text").cast(pa.large_binary()), []
            begin = np.flatnonzero(code >= 0)
            node = np.zeros(len(begin), np.int64)
            for k in range(ANCHOR):
                here = np.minimum(begin + k, len(code) - 1)
                key = np.where((at[here] == at[begin]) & (code[here] >= 0) & (here == begin + k), node * len(words) + code[here], -1)
                step = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                on = keys[step] == key
                begin, node = begin[on], then[step[on]]
                found.append(np.stack([at[begin], node], 1)[last[node]])
            pairs = [(row, n) for row, node in np.unique(np.concatenate(found), axis=0).tolist() for n in ends[node]]
            right = np.array([(row, n) for row, n in pairs if passages[n] in texts[row].as_py()], np.int64).reshape(-1, 2)
            yield pa.record_batch([ids.take(pa.array(right[:, 1])), batch.column("doc_id").take(pa.array(right[:, 0]))], names=["query_id", "doc_id"])

    return run


def holding(corpus: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, doc_id`` of every document that contains a passage literally. ``passages(query_id, passage)``.

    The words inside a passage, without its first and last, are whole words of each text that contains it. So runs of
    up to ANCHOR such words give the candidates, and only candidates are compared as text. Passages within the bound of a
    broadcast go to the texts, which are read once and not shuffled; more of them meet the texts by equal hashes of the
    runs. Passages of one or two words have no word inside: their texts are found among all (there is nothing to look up).
    """
    parts = F.split("passage", r"\s+")
    run = lambda words, at, n: F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])
    marked = passages.where("passage IS NOT NULL").select("query_id", "passage", F.least(F.size(parts) - 2, F.lit(ANCHOR)).alias("inner"), parts.alias("words"))
    size_of = lambda rows: rows.agg(F.coalesce(F.sum(F.octet_length("passage") + ANCHOR_BYTES), F.lit(0))).first()[0]
    long, short = marked.where("inner >= 1"), marked.where("inner < 1").select("query_id", "passage")
    texts = corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = f"query_id {passages.schema['query_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}"
    found = []
    if not long.isEmpty() and size_of(long) <= BROADCAST_BYTES:
        said = long.select("query_id", "passage", F.slice("words", F.lit(2), F.col("inner")).alias("run")).toArrow()
        found.append(texts.where(F.col("text").isNotNull()).mapInArrow(_held(said), kinds))
    elif lengths := sorted(r["inner"] for r in long.select("inner").distinct().collect()):  # at most ANCHOR
        texts = texts.repartition("doc_id")  # as the join below wants them
        anchor = F.coalesce(*[F.when(F.col("inner") == n, run(F.col("words"), F.lit(1), n)) for n in lengths])
        anchors = long.select("query_id", anchor.alias("anchor"))
        each = texts.select("doc_id", F.split("text", r"\s+").alias("words"))

        def runs(n: int) -> Column:
            every = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda at: run(F.col("words"), at, n))
            return F.when(F.size("words") >= n, every).otherwise(F.array().cast("array<bigint>"))

        pairs = each.select("doc_id", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]))).alias("anchor")).join(small(anchors, ANCHOR_BYTES, passages), "anchor").select("doc_id", "query_id").distinct()
        # candidates are few: their passages come to them by key, whatever the number of passages
        found.append(texts.join(pairs, "doc_id").join(passages.select("query_id", "passage"), "query_id").where(F.contains("text", "passage")).select("query_id", "doc_id"))
    if not short.isEmpty():
        few = F.broadcast(short) if size_of(short) <= BROADCAST_BYTES else short
        found.append(texts.join(few, F.contains("text", "passage")).select("query_id", "doc_id"))
    return reduce(DataFrame.unionByName, found) if found else texts.where("false").join(passages, F.lit(True)).select("query_id", "doc_id")
