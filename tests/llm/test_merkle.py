"""Manifest proofs against a plain tree, over several levels of blocks, and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from shelfrank.llm import common, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    doc, source, lang, n, text = row[:5]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, None if n is None else n + more, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        at = i ^ 1
        other = nodes[at] if at < len(nodes) else ""
        yield (other, "") if at < i else ("", other)
        i >>= 1


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = levels([leaf(r) for r in by[lang]])
    upper, out = levels([trees[lang][-1][0] for lang in order]), []
    for k, lang in enumerate(order):
        for i, r in enumerate(by[lang]):
            path = [*siblings(trees[lang], i), *siblings(upper, k)]
            now = leaf(r, r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for a, b in path:
                now = h(a + now + b)
            out.append((r[0], leaf(r), trees[lang][-1][0], upper[-1][0], h("".join(a + b for a, b in path)), now, now == upper[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in merkle.tampered_proofs(df).collect()), key=str)


@pytest.mark.parametrize("bits", [2, 8])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, bits):
    """Trees of 0 to 300 rows, of one block and of up to five levels of blocks of four."""
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "WIDTH", 1 << bits)
    rows = [(k, f"s{k % 3}", lang, 10 * k, f"text é {k}") for lang, n in (("en", 301), ("de", 17), ("fr", 1), ("", 2), ("é", 5), ("z", 4)) for k in range(n)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (3, "a", None, 5, ""), (3, "a", None, 5, ""), (3, "b", None, None, "long " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, rank int").repartition(5)
    assert found(df) == plain(rows)


def test_hot_tree_is_split_and_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 5)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 2000)
    rows = [(k, "s", f"l{k % 50}" if k % 3 else "hot", k, f"t{k}") for k in range(400)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table_and_changed_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.tampered_proofs(none).count() == 0
    one = spark.createDataFrame([(1, "s", "en", 3, "abc")], SCHEMA)
    assert found(one) == plain([(1, "s", "en", 3, "abc")])
    roots = {merkle.manifest(merkle.leaves(spark.createDataFrame([(1, "s", "en", 3, t), (2, "s", "de", 3, "x")], SCHEMA))).first().root for t in ("abc", "abd")}
    assert len(roots) == 2
