"""Approximate nearest neighbours with an inverted multi-index.

Both halves of the vectors are quantised separately; a cell is a pair of centroids. A query visits cells in order of
summed nearness of its halves to the two centroids, taken from a heap, until enough vectors are gathered; the gathered
vectors are ranked again by the exact inner product in double precision.

How many vectors are enough is calibrated on the training sample: the smallest share that finds ``RECALL`` of the true
neighbours there. Codebooks are fitted on a bounded sample; every vector is indexed. Neighbouring cells make blocks of
vectors of bounded size, and queries of neighbouring cells make chunks (a crowded cell is split either way); a block
goes only to the chunks that visit it, and a task ranks one block for one chunk.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part.
Every row is a vector of its own: rows of one id are each other's candidates, and each such query row gets its own
list under that id. Equal scores are ordered by the smaller id. Fewer vectors than ``k`` give fewer rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: The fit's bounds: vectors in the sample, and centroids of each half.
SAMPLE, MAX_CENTROIDS = 16_000, 128
#: Share of true neighbours that the calibration wants, and the shares of all vectors that it tries.
RECALL, SHARES = 0.96, (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Vectors in a block and queries in a chunk: at least (unless there are fewer), and at most so many bytes of doubles.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Blocks wanted of a large table, for parallel work; beyond that blocks grow, so that fewer copies are sent.
BLOCKS = 1000
#: Scores this close may be equal: they are computed again in one fixed order.
CLOSE = 1e-9


def valid_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, row, vec`` with doubles, of the vectors that take part; ``row`` is a number of the row's own."""
    v = F.col("vec")
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(sound)
    common = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1)
    return rows.join(F.broadcast(common), F.size(v) == F.col("d")).select("vec_id", F.monotonically_increasing_id().alias("row"), "vec")


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def cells_of(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    half = first.shape[1]
    return nearest(x[:, :half], first) * len(second) + nearest(x[:, half:], second)


def visit(query: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed nearness until they hold ``enough`` vectors: the multi-sequence algorithm."""
    half = first.shape[1]
    a, b = first @ query[:half], second @ query[half:]
    by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b, width = a.tolist(), b.tolist(), len(second)
    heap, out, got = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)], [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = by_a[i] * width + by_b[j]
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        if j + 1 < len(by_b):
            heapq.heappush(heap, (-(a[by_a[i]] + b[by_b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(by_a):
            heapq.heappush(heap, (-(a[by_a[i + 1]] + b[by_b[0]]), i + 1, 0))
    return out


def calibrated(sample: np.ndarray, first: np.ndarray, second: np.ndarray, k: int) -> float:
    """The smallest share of vectors to gather that finds RECALL of the sample's own neighbours."""
    n = len(sample)
    if n <= 4 * k:
        return 1.0
    cells = cells_of(sample, first, second)
    counts = np.bincount(cells, minlength=len(first) * len(second))
    asked = np.arange(0, n, max(1, n // 150))
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-scores, k, axis=1)[:, :k]
    place = np.full((len(asked), len(counts)), n, np.int64)  # vectors gathered before a cell is reached
    for q, i in enumerate(asked):
        gathered = 0
        for cell in visit(sample[i], first, second, counts, n):
            place[q, cell] = gathered
            gathered += counts[cell]
    before = np.take_along_axis(place, cells[true], axis=1)
    return next((s for s in SHARES if (before < s * n).mean() >= RECALL), 1.0)


def deal(counts: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each cell: neighbouring cells share a part until it is full, a crowded one has several."""
    start, parts, part, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, size in enumerate(counts.tolist()):
        if held and held + size > per:
            part, held = part + 1, 0
        start[cell], parts[cell] = part, max(1, -(-size // per))
        if parts[cell] > 1:
            part, held = part + int(parts[cell]), 0
        else:
            held += size
    return start, parts


Found = list[tuple[int, int, int, int, float]]


def top_rows(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, cells: np.ndarray, q_ids: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, wanted: list[np.ndarray], k: int) -> Found:
    """``(query, its row, vector, its row, score)``: the k best of a block for each query, among the cells it visits."""
    kinds, at = np.unique(cells, return_inverse=True)
    out: Found = []
    for lo in range(0, len(queries), 256):
        part = queries[lo : lo + 256]
        scores = part @ vectors.T
        for i in range(len(part)):
            own, q = scores[i], lo + i
            own[~np.isin(kinds, wanted[q])[at] | (rows == q_rows[q])] = -np.inf
            least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
            near = np.flatnonzero((own >= least - CLOSE) & (own > -np.inf))
            exact = (vectors[near] * part[i]).sum(axis=1)
            best = np.lexsort((rows[near], ids[near], -exact))[:k]
            n = len(best)
            out += zip([int(q_ids[q])] * n, [int(q_rows[q])] * n, ids[near][best].tolist(), rows[near][best].tolist(), exact[best].tolist(), strict=True)
    return out


def _counts(indexed: DataFrame, cells: int) -> np.ndarray:
    counts = np.zeros(cells, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most MAX_CENTROIDS squared
        counts[r["cell"]] = r["count"]
    return counts


def search(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each vector whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    vectors = materialize(valid_vectors(embeddings, id_col, vector_col), "ann-vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toPandas()
    x = np.array(sample["vec"].tolist(), float)
    half = max(1, x.shape[1] // 2)
    centroids = int(min(MAX_CENTROIDS, len(x), 2 ** np.ceil(np.log2(n + 1) / 3.2)))
    first, second = k_means(x[:, :half], centroids, 1), k_means(x[:, half:], centroids, 2)
    enough = int(min(n, max(10 * k, np.ceil(calibrated(x, first, second, k) * n))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells_of(np.array(batch["vec"].tolist(), float), first, second))

    indexed = materialize(vectors.mapInPandas(assign, "vec_id long, row long, vec array<double>, cell long"), "ann-index")
    discard(vectors)
    asked = indexed.where(F.col("vec_id") % every == 0)
    counts, queries = _counts(indexed, centroids * centroids), _counts(asked, centroids * centroids)
    per = lambda total: int(max(1, min(BLOCK_BYTES // (8 * x.shape[1]), max(BLOCK, total // BLOCKS))))
    start, parts = deal(counts, per(n))
    q_start, q_parts = deal(queries, per(int(queries.sum())))

    def salted(batch: pd.DataFrame, start: np.ndarray, parts: np.ndarray) -> np.ndarray:
        cell = batch["cell"].to_numpy()
        return start[cell] + (batch["row"].to_numpy() * 2654435761 >> 8) % parts[cell]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(block=salted(batch, start, parts))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query, row, vec, chunk in zip(batch["vec_id"], batch["row"], batch["vec"], salted(batch, q_start, q_parts), strict=True):
                by_block: dict[int, list[int]] = {}
                for cell in visit(np.asarray(vec, float), first, second, counts, enough):
                    for b in range(int(start[cell]), int(start[cell] + parts[cell])):
                        by_block.setdefault(b, []).append(cell)
                rows += [(query, row, vec, b, int(chunk), cells) for b, cells in by_block.items()]
            yield pd.DataFrame(rows, columns=["query_id", "query_row", "query", "block", "chunk", "cells"])

    routed = asked.mapInPandas(route, "query_id long, query_row long, query array<double>, block long, chunk long, cells array<long>")
    routed = materialize(routed, "ann-routed")
    blocks = indexed.mapInPandas(place, "vec_id long, row long, vec array<double>, cell long, block long")
    visited = routed.select("block", "chunk").distinct().groupBy("block").agg(F.collect_list("chunk").alias("chunks"))  # blocks are bounded in size, so is their product with chunks
    blocks = blocks.join(visited, "block").withColumn("chunk", F.explode("chunks")).drop("chunks")

    def rank(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "query_row", "vec_id", "row", "score"]
        if not len(own) or not len(asking):
            return pd.DataFrame([], columns=columns)
        vecs, qs = np.array(own["vec"].tolist(), float), np.array(asking["query"].tolist(), float)
        rows = top_rows(own["vec_id"].to_numpy(), own["row"].to_numpy(), vecs, own["cell"].to_numpy(), asking["query_id"].to_numpy(), asking["query_row"].to_numpy(), qs, [np.asarray(c) for c in asking["cells"]], k)
        return pd.DataFrame(rows, columns=columns)

    found = blocks.groupBy("block", "chunk").cogroup(routed.groupBy("block", "chunk")).applyInPandas(rank, "query_id long, query_row long, vec_id long, row long, score double")
    order = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
