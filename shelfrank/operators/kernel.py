"""What the vector kernels share: blocks of queries against blocks of items as tasks, filters, and running top lists.

Queries and items stay tables: each is dealt to blocks by a hash of its id, and a task gets one block of either, of at
most TILE_BYTES of vectors. There are about TASKS tasks, so a row is shuffled as often whatever the size of the tables,
until blocks reach their bound. Scores exist as one matrix of at most QUERIES_AT_ONCE x ITEM_BLOCK doubles (4 MB);
reducers emit a few rows per query and task.

Vectors that are null, hold null or are not finite take no part, neither as items nor as queries; nor do vectors of
another length than the longest item vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and items whose scores are held at once.
QUERIES_AT_ONCE, ITEM_BLOCK = 512, 1024
#: Queries and items in a block: at least, if there are so many, and at most; between them so many that there are TASKS.
LEAST_QUERIES, QUERY_BLOCK = 256, 1 << 14
LEAST_ITEMS, MOST_ITEMS = 2048, 1 << 16
TASKS = 192
#: Bytes of a block's vectors, as doubles. A task holds a block of queries and one of items, each up to twice.
TILE_BYTES = 64 << 20
Block = dict[str, np.ndarray]


class Shape(NamedTuple):
    """How many queries and items there are, and how long their vectors are, by column of the items."""

    n_queries: int
    n_items: int
    lengths: dict[str, int]


def usable(vector: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(F.col(vector).cast("array<double>"), bad), F.lit(True))


def shape(queries: DataFrame, items: DataFrame, vectors: tuple[str, ...]) -> Shape:
    """Two counts; ``vectors`` are the vector columns of the items."""
    sizes = [F.max(F.when(usable(v), F.size(v))).alias(v) for v in vectors]
    row = items.agg(F.count("*").alias("_n"), *sizes).first()
    return Shape(queries.count(), row["_n"], {v: row[v] or 0 for v in vectors})


def _arrays(table: pa.Table, vectors: tuple[str, ...]) -> Block:
    """Columns as arrays; those of ``vectors`` as matrices."""
    matrix = lambda c: pc.list_flatten(table[c]).to_numpy().astype(float).reshape(table.num_rows, -1)
    return {c: matrix(c) if c in vectors else table[c].to_pandas().to_numpy() for c in table.column_names}


def deal(n_queries: int, n_items: int, query_bytes: int, item_bytes: int) -> tuple[int, int]:
    """How many blocks of queries and of items: about TASKS pairs of them, as many bytes of either going to all tasks."""
    some = lambda n, per: max(1, -(-n // max(per, 1)))
    even = math.sqrt(TASKS * max(n_items, 1) * item_bytes / (max(n_queries, 1) * query_bytes))
    blocks = max(min(round(even), some(n_items, LEAST_ITEMS)), 1)
    chunks = min(some(TASKS, blocks), some(n_queries, LEAST_QUERIES))
    blocks = min(some(TASKS, chunks), some(n_items, LEAST_ITEMS))  # few queries leave more tasks to the items
    return max(chunks, some(n_queries, min(QUERY_BLOCK, TILE_BYTES // query_bytes))), max(blocks, some(n_items, min(MOST_ITEMS, TILE_BYTES // item_bytes)))


def _meet(queries: DataFrame, items: DataFrame, chunks: int, blocks: int, task: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``task`` on every block of queries and every block of items."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.withColumn("_chunk", dealt("query_id", chunks)).withColumn("_block", each(blocks))
    rows = items.withColumn("_block", dealt("item_id", blocks)).withColumn("_chunk", each(chunks))
    key = ["_chunk", "_block"]  # the number is given, as small tables can be much work
    asked, rows = (x.repartition(chunks * blocks, *key) for x in (asked, rows))
    return asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(lambda left, right: task(left, right) if left.num_rows and right.num_rows else pa.table({}), ddl)


def by_blocks(
    queries: DataFrame, items: DataFrame, asking: dict[str, tuple[str, ...]], run: Callable[[Block, Block], dict[str, np.ndarray]], ddl: str, known: Shape | None = None
) -> DataFrame:
    """The rows of ``run(queries, items)`` for every block of items and QUERIES_AT_ONCE queries of every block of queries.

    ``asking`` gives for each vector column of the items the columns of the queries that meet it. The items are read
    once, whatever the number of queries; their rows go once to each block of queries, and queries once to each block of
    items. Only two counts come to the driver, none where the shape is ``known``.
    """
    known = known or shape(queries, items, tuple(asking))
    pairs = [(q, own) for own, them in asking.items() for q in them]
    fits = lambda v, own: usable(v) & (F.size(v) == known.lengths[own])
    per_vector = lambda own: max(8 * known.lengths[own], 1)
    chunks, blocks = deal(known.n_queries, known.n_items, max(sum(per_vector(own) for _, own in pairs), 1), max(sum(map(per_vector, asking)), 1))
    for q, own in pairs:
        queries = queries.where(fits(q, own))
    for own in asking:
        items = items.where(fits(own, own))
    vectors = (*asking, *(q for q, _ in pairs))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _arrays(right, vectors)
        return pa.concat_tables([pa.table(run(_arrays(part, vectors), rows)) for part in _slices(left)])

    return _meet(queries, items, chunks, blocks, task, ddl)


def _slices(table: pa.Table) -> list[pa.Table]:
    return [table.slice(at, QUERIES_AT_ONCE) for at in range(0, table.num_rows, QUERIES_AT_ONCE)]


#: Model, modality of the query and modality of the target.
Types = dict[str, tuple[str, str, str]]


def by_types(
    queries: DataFrame, items: DataFrame, types: Types, run: Callable[[str, Block, Block], dict[str, np.ndarray]], ddl: str, targets: DataFrame | None = None
) -> DataFrame:
    """As ``by_blocks`` for several search types at once: the rows of ``run(type, queries, items)``.

    ``queries(model_id, modality, query_id, vector)``, ``items(model_id, modality, item_id, item_vector)``. A vector is
    shuffled for all types together. With ``targets(query_id, target_id)``, queries also have ``target_id`` and
    ``target_vector``, and those without a usable one are left out.
    """
    asking, owning = sorted({(m, a) for m, a, _ in types.values()}), sorted({(m, o) for m, _, o in types.values()})
    number = lambda kinds: F.coalesce(*[F.when((F.col("model_id") == m) & (F.col("modality") == x), n) for n, (m, x) in enumerate(kinds)])
    marked = items.select("item_id", number(owning).alias("kind"), F.col("item_vector").cast("array<double>").alias("vector")).where("kind is not null")
    asked = queries.select("query_id", number(asking).alias("kind"), F.col("vector").cast("array<double>").alias("vector")).where("kind is not null").where(usable("vector"))
    found = {r["kind"]: r for r in marked.groupBy("kind").agg(F.count("*").alias("n"), F.max(F.when(usable("vector"), F.size("vector"))).alias("length")).collect()}  # a handful of kinds
    lengths = [(found[n]["length"] or 0) if n in found else 0 for n in range(len(owning))]
    rows = marked.where(usable("vector") & (F.size("vector") == F.element_at(F.array(*[F.lit(x) for x in lengths]), F.col("kind") + 1)))
    per_item = max(8 * sum(lengths), 1)
    per_query = max(8 * sum(lengths[owning.index((m, o))] for m, _, o in types.values()), 1)
    asked = asked.withColumns({"target": F.lit(False), "target_id": F.lit(None).cast("long")})
    if targets is not None:
        own = targets.join(rows, F.col("target_id") == F.col("item_id")).select("query_id", "kind", "vector", F.lit(True).alias("target"), "target_id")
        asked = asked.unionByName(own)
    n_queries = queries.select("query_id").distinct().count()
    chunks, blocks = deal(n_queries, max((r["n"] for r in found.values()), default=0), per_query, per_item)
    meet = {name: (asking.index((m, a)), owning.index((m, o))) for name, (m, a, o) in types.items()}
    has_targets = targets is not None

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for name, (a, o) in meet.items():
            stored = _of_kind(right, o, lengths[o])
            block = _of_kind(left.filter(pc.invert(left["target"])), a, lengths[o])
            if has_targets:
                own = _of_kind(left.filter(left["target"]), o, lengths[o])
                _, at, of_own = np.intersect1d(block["query_id"], own["query_id"], return_indices=True)
                block = {"query_id": block["query_id"][at], "vector": block["vector"][at], "target_id": own["target_id"][of_own], "target_vector": own["vector"][of_own]}
            stored["item_vector"] = stored.pop("vector")
            for begin in range(0, len(block["query_id"]) if len(stored["item_id"]) else 0, QUERIES_AT_ONCE):
                got = run(name, {c: x[begin : begin + QUERIES_AT_ONCE] for c, x in block.items()}, stored)
                out.append(pa.table(got | {"type": pa.array([name] * len(got["query_id"]), pa.string())}))
        return pa.concat_tables(out) if out else pa.table({})

    return _meet(asked, rows, chunks, blocks, task, f"{ddl}, type string")


def _of_kind(table: pa.Table, kind: int, length: int) -> Block:
    picked = table.filter(pc.and_(pc.equal(table["kind"], kind), pc.equal(pc.list_value_length(table["vector"]), length)))
    ids = [c for c in ("query_id", "item_id", "target_id") if c in picked.column_names]
    return {"vector": pc.list_flatten(picked["vector"]).to_numpy().reshape(picked.num_rows, length)} | {c: picked[c].to_numpy() for c in ids}


def item_blocks(batch: Block) -> Iterator[Block]:
    n = len(next(iter(batch.values())))
    for at in range(0, n, ITEM_BLOCK):
        yield {c: x[at : at + ITEM_BLOCK] for c, x in batch.items()}


def facets(queries: DataFrame) -> list[str]:
    """Columns of items that the filters of ``queries`` ask for."""
    return [c for c in ("color", "category", "category_l1") if c.split("_")[0] in queries.columns]


def masked(scores: np.ndarray, block: Block, batch: Block) -> None:
    """Sets to -inf what does not pass the ``color`` and ``category`` of its query; a null filter keeps all."""
    asked = [block[c] for c in ("color", "category") if c in block]
    rows: dict[tuple, list[int]] = {}
    for i, wants in enumerate(zip(*asked, strict=True)):
        rows.setdefault(wants, []).append(i)
    for at in rows.values():  # queries of the same filters
        scores[np.ix_(at, ~kept(block, at[0], batch))] = -np.inf


def kept(block: Block, i: int, batch: Block) -> np.ndarray:
    """Which items of ``batch`` pass the ``color`` and ``category`` of query ``i``; a null filter keeps all."""
    keep = np.ones(len(batch["item_id"]), bool)
    if "color" in block and block["color"][i] is not None:
        keep &= batch["color"] == block["color"][i]
    if "category" in block and (want := block["category"][i]) is not None:
        keep &= batch["category" if " > " in want else "category_l1"] == want
    return keep


class Best:
    """The best ``most[i]`` items of each query so far: higher scores first, then smaller ids.

    What may belong to them is gathered for all queries, and sorted once it is as much as all lists together.
    """

    def __init__(self, most: np.ndarray):
        self.most, self.k = most, int(most.max(initial=1))
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # row, id, score
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.least = np.full(len(most), -np.inf)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of all queries with the items ``ids``; -inf takes no part."""
        near = (scores >= self.least[:, None]) & (scores > -np.inf)
        if len(ids) > 2 * self.k and np.count_nonzero(near) > 2 * self.k * len(self.most):
            near &= scores >= np.partition(scores, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]]
        i, j = np.nonzero(near)
        self.more.append((i, ids[j], scores[i, j]))
        self.waiting += len(i)
        if self.waiting >= self.k * len(self.most):
            self._sort()

    def _sort(self) -> None:
        row, ids, scores = (np.concatenate(x) for x in zip(self.kept, *self.more, strict=True))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        first = np.searchsorted(row, np.arange(len(self.most)))
        keep = np.arange(len(row)) - first[row] < self.most[row]
        self.kept, self.more, self.waiting = (row[keep], ids[keep], scores[keep]), [], 0
        n = np.bincount(self.kept[0], minlength=len(self.most))
        full = n == self.most
        self.least[full] = self.kept[2][(np.cumsum(n) - 1)[full]]

    def rows(self, query_ids: np.ndarray, **more: np.ndarray) -> dict[str, np.ndarray]:
        self._sort()
        row, ids, scores = self.kept
        return {"query_id": query_ids.astype(np.int64)[row], "item_id": ids, "score": scores} | {c: x[row] for c, x in more.items()}
