"""Near-duplicate detection with SetSketch registers.

Each document's set of word shingles becomes a SetSketch: per register the exponentially spaced, truncated minimum of
an exponential hash (so sketches merge by the larger register). Bands of registers give candidate pairs, a joint
likelihood of both registers and set sizes drops hopeless ones, and the full sets decide the rest.

Inside a bucket, documents are first compared with one pivot, the smallest; linked documents merge into components.
Buckets that still hold several components are gathered to clusters, and documents of different components of a cluster
are compared exactly in blocks of bounded size, which emit only the links that merge. So every pair of components that
shares a bucket is decided, no group is emitted as pairs, and the largest component of a cluster is never compared with
itself. Equal texts are one node from the start.

Words are runs of non-blank characters with A-Z lowered; fewer words than a shingle form one shingle; a text without
words (or null) has an empty set and is linked with nothing. Rows of one id and equal words are one node, rows of one
id and other words are nodes of their own; a row without id gets a null component and is kept. An empty table gives an
empty result.

Hot keys are split: a bucket, component, class of copies or pivot of very many rows is joined in parts (``hub_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, boxed, discard, hub_join, materialize, small, small_batches

#: Registers come in bands; pairs that agree on one whole band are candidates.
BANDS, PER_BAND = 28, 5
REGISTERS = BANDS * PER_BAND
#: SetSketch parameters: base, rate and largest register value (16 bits).
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Candidates stay unless similarities at or above the threshold are this much less likely than the best one (in logs).
LOG_LIKELIHOOD_GAP = 12.0
#: Members that are compared with one copy of their pivot, and documents in a block, about.
PIVOT_GROUP, BLOCK = 512, 512


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MULTIPLY = (_constants(REGISTERS, 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_FLIP = (_constants(REGISTERS, 2) >> np.uint64(16)).astype(np.uint32)
_BAND = _constants(REGISTERS, 3).reshape(BANDS, PER_BAND)
_WORD = _constants(64, 4)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """``bytes`` methods know only ASCII letters and blanks, which is what is wanted."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    total = each[: n - size + 1] * _WORD[0]  # word hashes are random already: one multiplier for each place will do
    for k in range(1, size):
        total += each[k : n - size + 1 + k] * _WORD[k]
    return np.unique(mixed(total))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set: one smallest hash per register, on an exponential scale."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = short[at : at + 1024]
        np.minimum(low, ((part[:, None] ^ _FLIP[None, :]) * _MULTIPLY[None, :]).min(axis=0), out=low)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number per band."""
    parts = sketch.reshape(BANDS, PER_BAND).astype(np.uint64)
    return mixed((mixed(parts * _BAND + _BAND)).sum(axis=1, dtype=np.uint64) + _BAND[:, 0]).view(np.int64)


def sketches(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``doc_id, row, n, key, sketch, bands``: one pass over all texts; ``key`` stands for the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                n, key, sketch, bands = [], [], [], []
                for x in batch.column(1).slice(at, 1000):
                    words = words_of(x.as_py())
                    shingles = shingle_set(words, size)
                    n.append(len(shingles))
                    if not words:
                        key.append(None), sketch.append(None), bands.append(None)
                        continue
                    own = registers(shingles)
                    key.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sketch.append(own.tobytes())
                    bands.append(band_keys(own))
                columns = [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.record_batch([batch.column(0).slice(at, 1000), *columns], names=["doc_id", "n", "key", "sketch", "bands"])

    small_batches(documents.sparkSession)
    picked = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = picked.mapInArrow(run, "doc_id long, n long, key binary, sketch binary, bands array<long>")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "nd-sketches")


def _log_equal(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def plausible(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float, least: float) -> bool:
    """Whether a similarity of at least ``least`` explains both sketches nearly as well as any other does."""
    most = min(n_a, n_b) / max(n_a, n_b)
    if most < least:
        return False
    u = n_a / (n_a + n_b)
    grid = np.linspace(0, most, 201)
    more, fewer = _log_equal(u - (1 - u) * grid), _log_equal((1 - u) - u * grid)
    tiny = 1e-9
    likely = (a > b).sum() * np.log(np.maximum(more, tiny)) + (a < b).sum() * np.log(np.maximum(fewer, tiny)) + (a == b).sum() * np.log(np.maximum(1 - more - fewer, tiny))
    return float(likely[grid >= least - 1e-9].max(initial=-np.inf)) >= float(likely.max()) - LOG_LIKELIHOOD_GAP


def _grouped(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` plus ``group``: the partners of a pivot ``a`` in groups of about PIVOT_GROUP."""
    heavy = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > PIVOT_GROUP).select("a", F.ceil(F.col("n") / PIVOT_GROUP).cast("int").alias("parts")), "nd-hubs")
    group = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    out = materialize(pairs.join(small(heavy, 64), "a", "left").select("a", group.alias("group"), "b"), "nd-pairs")
    discard(heavy)
    return out


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, group, b)`` that size ratio and joint likelihood leave; a pivot's sketch goes to each of its groups."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    pivots = pairs.select("a", "group").distinct().join(side("a"), "a")
    both = pairs.join(pivots, ["a", "group"]).join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    @F.pandas_udf("boolean")
    def fits(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        sets = zip(a, b, n_a, n_b, strict=True)
        return pd.Series([plausible(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), m, n, percent / 100) for x, y, m, n in sets], dtype=bool)

    return both.where(fits("s_a", "s_b", "n_a", "n_b")).select("a", "group", "b")


def _with_texts(documents: DataFrame, id_col: str, text_col: str, asked: DataFrame, row_bytes: int) -> DataFrame:
    """``asked(rep, key, ...)`` with the ``text`` of each row's document.

    ``asked`` is broadcast within BROADCAST_BYTES; beyond that the texts asked for, and only those, are shuffled by id.
    """
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    most = BROADCAST_BYTES // row_bytes
    if asked.limit(most + 1).count() <= most:
        asked = F.broadcast(asked)
    else:
        rows = rows.join(small(asked.select(F.col("rep").alias("_id")).distinct(), 32), "_id", "left_semi")
    return rows.join(asked, F.col("_id") == F.col("rep")).drop("_id", "rep")


def _verified(documents: DataFrame, id_col: str, text_col: str, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``edges(a, b)`` of ``pairs(a, group, b)`` whose full sets are similar enough; ``a`` is the pivot of many ``b``.

    A pivot's text goes once to each of its groups of about ``PIVOT_GROUP`` members, a member's text once per pair.
    """
    members = pairs.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "group")
    pivots = pairs.select(F.col("a").alias("node"), F.col("a").alias("pivot"), "group").distinct()
    asked = materialize(members.unionByName(pivots).join(nodes.select("node", "rep", "key"), "node"), "nd-asked")
    rows = _with_texts(documents, id_col, text_col, asked, 120)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            pivot, group, node = (batch.column(k).to_pylist() for k in range(3))
            found: tuple[list[int], list[int]] = ([], [])
            for i, (p, g, n) in enumerate(zip(pivot, group, node, strict=True)):
                words = words_of(batch.column(4)[i].as_py())
                if xxhash.xxh3_128_digest(b" ".join(words)) != batch.column(3)[i].as_py():
                    continue  # another text of the same id
                shingles = shingle_set(words, size)
                if p == n:
                    at, own = (p, g), shingles
                elif at == (p, g) and similar(own, shingles, percent):
                    found[0].append(p), found[1].append(n)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    dealt = rows.select("pivot", "group", "node", "key", "text").repartition("pivot", "group").sortWithinPartitions("pivot", "group", F.col("node") != F.col("pivot"))
    out = materialize(dealt.mapInArrow(check, "a long, b long").distinct(), "nd-edges")
    discard(asked)
    return out


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def block_links(nodes: list[int], labels: list[int], sketch: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different labels, exactly, among the documents of a block; one link for each merge."""
    n, size = len(nodes), np.array([len(s) for s in sets])
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    group = {x: x for x in set(labels)}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    known, out = np.array(labels), []
    for i in range(n - 1):
        later = np.flatnonzero((known[i + 1 :] != known[i]) & (np.minimum(size[i], size[i + 1 :]) * 100 >= np.maximum(size[i], size[i + 1 :]) * percent)) + i + 1
        if len(later):
            later = later[(sketch[later] == sketch[i]).mean(axis=1) >= least]
        for j in later:
            a, b = root(labels[i]), root(labels[j])
            if a != b and similar(sets[i], sets[j], percent):
                group[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    return out


def _block_edges(documents: DataFrame, id_col: str, text_col: str, open_nodes: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between labels inside each cluster of ``open_nodes(cluster, node, label)``, block by block.

    Documents of a cluster's largest label need no comparison among themselves; they and the rest are dealt to blocks
    of about ``BLOCK`` documents, and every pair of blocks that can hold a link is one small group.
    """
    sizes = open_nodes.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    plan = largest.select("cluster", F.col("top.label").alias("top"), blocks(F.col("all") - F.col("top.n")).alias("rest"), blocks(F.col("top.n")).alias("many"), F.col("all").alias("n"))
    plan = materialize(plan, "nd-plan")
    rows = hub_join(open_nodes, plan, "cluster", "node").withColumn("in_top", F.col("label") == F.col("top"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("in_top"), F.col("many")).otherwise(F.col("rest"))).cast("int")
    rows = rows.withColumn("own", own)
    rest, many = F.sequence(F.lit(0), F.col("rest") - 1), F.sequence(F.lit(0), F.col("many") - 1)
    with_rest = F.transform(rest, lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
    with_top = F.transform(many, lambda j: F.struct(F.col("own").alias("x"), (-1 - j).alias("y")))
    from_top = F.transform(rest, lambda i: F.struct(i.alias("x"), (-1 - F.col("own")).alias("y")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("in_top"), from_top).otherwise(F.concat(with_rest, with_top))))
    asked = rows.select("cluster", "at.x", "at.y", "node", "label").join(nodes.select("node", "rep", "key", "sketch"), "node")
    asked = materialize(asked, "nd-blocks")

    def link(batch: pa.Table) -> pa.Table:
        part = batch.to_pydict()
        keep, sets = {}, []
        for i, (node, text, key) in enumerate(zip(part["node"], part["text"], part["key"], strict=True)):
            words = words_of(text)
            if node not in keep and xxhash.xxh3_128_digest(b" ".join(words)) == key:
                keep[node] = i
                sets.append(shingle_set(words, size))
        at = list(keep.values())
        sketch = np.array([np.frombuffer(part["sketch"][i], np.uint16) for i in at]).reshape(len(at), REGISTERS)
        found = block_links([part["node"][i] for i in at], [part["label"][i] for i in at], sketch, sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    texts = _with_texts(documents, id_col, text_col, asked, 480).select("cluster", "x", "y", "node", "label", "key", "sketch", "text")
    out = materialize(texts.groupBy("cluster", "x", "y").applyInArrow(link, "a long, b long").distinct(), "nd-more")
    discard(plan, asked)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for all nodes of ``edges(a, b)``.

    Alternating stars: neighbours above a node are hung on its smallest neighbour, then those below; the number of
    rounds grows with the logarithm of the longest path. A hub's neighbours are joined in parts, and its minimum comes
    from an aggregate that is combined before the shuffle.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "nd-stars")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    said = mark(now)
    while said[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "nd-low")
        large = hub_join(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")  # from here on ``u`` is never a hub: it has one neighbour for each one that it had below
        small_star = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialize(small_star.where("u <> v").distinct(), "nd-stars")
        then = mark(after)
        discard(low, now)
        now, before, said = after, said, then
        if then == before:
            break
    # a node points to its root, and a root to itself; no union here, as Spark may take one for partitioned by node
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("label")), F.struct(F.col("v").alias("node"), F.col("v").alias("label"))))
    out = materialize(now.select(ends.alias("x")).select("x.*").groupBy("node").agg(F.min("label").alias("label")), "nd-labels")
    discard(now)
    return out


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _judged(documents: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, key, component_id, kept_key`` of every row; ``key`` stands for the words in order.

    ``kept_key`` is that of the text which stays of the component: of its smallest id, and of that id's texts the one
    with the smallest key.
    """
    seen = sketches(documents, id_col, text_col, size)
    named = seen.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(named.groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nd-classes")
    nodes = materialize(seen.join(classes.select("node", "rep"), F.col("row") == F.col("node")).select("node", "rep", "key", "n", "sketch", "bands"), "nd-nodes")
    linked = components(_all_links(documents, nodes, id_col, text_col, size, percent))
    labels = materialize(_with_labels(classes.withColumnRenamed("n", "rows"), linked), "nd-classes")
    first = materialize(labels.groupBy("label").agg(F.min(F.struct("rep", "key")).alias("best"), F.count("*").alias("n")), "nd-first")
    by_key = hub_join(labels, first, "label", "node").select("key", F.col("best.rep").alias("component_id"), F.col("best.key").alias("kept_key"), F.col("rows").alias("n"))
    by_key = materialize(by_key, "nd-by-key")
    discard(classes, nodes, linked, labels, first)
    rows = seen.select("doc_id", F.col("n").alias("n_shingles"), "key", "row")
    one = ["doc_id", "n_shingles", "key", "component_id", "kept_key"]
    joined = hub_join(rows.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()), by_key, "key", "row").select(one)
    alone = rows.where(F.col("key").isNull() | F.col("doc_id").isNull())
    return joined.unionByName(alone.select("doc_id", "n_shingles", "key", F.col("doc_id").alias("component_id"), F.col("key").alias("kept_key")))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``documents``."""
    judged = _judged(documents, id_col, text_col, size, percent)
    return judged.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _all_links(documents: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Verified ``edges(a, b)`` that connect every pair of linked nodes."""
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "low", "n")
    shared = materialize(shared, "nd-shared")
    members = materialize(hub_join(banded, shared, "bucket", "node"), "nd-members")
    # only nodes that share a bucket are ever compared: their sketches are looked up each round
    compared = materialize(nodes.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), "nd-compared")
    pairs = _grouped(members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    likely = materialize(_likely_pairs(pairs, compared, percent), "nd-likely")
    edges = _verified(documents, id_col, text_col, compared, likely, size, percent)
    labels = components(edges)
    here = materialize(_with_labels(members.select("bucket", "node"), labels), "nd-here")
    several = here.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("node").alias("low"), F.count("*").alias("n")).where("x < y").select("bucket", "low", "n")
    several = materialize(several, "nd-several")
    unlike = materialize(hub_join(here, several, "bucket", "node").select("node", "label", "low").distinct(), "nd-open")
    discard(shared, members, pairs, likely, labels, here, several)
    clusters = components(unlike.select(F.col("node").alias("a"), F.col("low").alias("b"))).select("node", F.col("label").alias("cluster"))
    open_nodes = materialize(unlike.select("node", "label").distinct().join(clusters, "node"), "nd-clusters")
    if not open_nodes.isEmpty():
        more = _block_edges(documents, id_col, text_col, open_nodes, compared, size, percent)
        edges = edges.unionByName(more)
    discard(compared, unlike, open_nodes)
    return edges


def _words_key(text: Column) -> Column:
    @F.pandas_udf("binary")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_128_digest(b" ".join(w)) if (w := words_of(t)) else None for t in texts], dtype=object)

    return key(text)


def drop_near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` without those that another text of their component stands for.

    Of each component one text stays (see ``_judged``), and repeated rows of its id with equal words are one. Every row
    is judged by its own words: of rows that share an id, one can go and another stay. Rows without words or id stay.
    """
    judged = _judged(documents, id_col, text_col, size, percent).where(F.col("doc_id").isNotNull())
    stays = F.col("key").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("kept_key")))
    judged = materialize(judged.groupBy("doc_id", "key").agg(F.count("*").alias("rows"), F.bool_or(stays).alias("stays")), "nd-judged")
    by_id = judged.groupBy(F.col("doc_id").alias("_gone")).agg((F.sum("rows") > 1).alias("_again"), F.bool_or("stays").alias("_stays"))
    acts = materialize(by_id.where("_again or not _stays").select("_gone", "_again"), "nd-gone")
    rows = boxed(documents).join(small(acts, 64), F.col("doc")[id_col] == F.col("_gone"), "left")
    stay = rows.where(F.col("_gone").isNull()).select("doc.*")
    if acts.where("_again").isEmpty():
        return stay
    ids = acts.where("_again").select(F.col("_gone").alias("doc_id"))
    known = materialize(judged.where("stays").join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_known")), "nd-again")
    again = rows.where("_again").withColumn("_key", _words_key(F.col("doc")[text_col].cast("string")))
    again = again.join(small(known, 80), (F.col("_gone") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_known")))
    worded, blank = again.where(F.col("_key").isNotNull()), again.where(F.col("_key").isNull())
    return stay.unionByName(worded.dropDuplicates(["_gone", "_key"]).select("doc.*")).unionByName(blank.select("doc.*"))
