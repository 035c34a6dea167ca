"""Operators on awkward rows by value, another tokenizer, and pipeline stages against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfrank.llm import line_dedup, media, mixing, near_dup, packing, secrets

KEY = "token=" + "aB3dE5gH7jK9" * 2
ROWS = [
    (1, "a b c d e f\nsame line", "s1"), (2, None, None), (3, "", "s1"), (4, "a b c d e f\nsame line", "s2"), (4, "a b c d e f\nsame line", "s2"), (None, f"x {KEY} y", "s2"),
    (5, "w " * 60_000, "s3"), (6, " \t\n", "s1"), (7, "ÉÈ été", None), (7, "other words", "s1"),
]
CLASH = ("node", "label", "_keys", "_id", "row", "size", "last", "score", "place", "target", "hash", "kind", "lines", "n")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in CLASH})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixing_values(rows):
    """Sizes, targets and what each source takes, with a null source and sources without words."""
    got = mixing.mixed_sizes(rows).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), len(words(t))) for i, t, _ in ROWS)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest, left = total - sum(capped.values()), sum(w for s, w in weight.items() if s not in capped)
        more = {s: 3 * sizes[s] for s in order if s not in capped and rest * weight[s] / left > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: capped.get(s, rest * weight[s] / left) for s in order}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_media_values(rows):
    """Sizes and digests of every row, the very long one and repeated ids included."""
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest(), zlib.crc32(media.padded((t or "").encode())[-16:])) for i, t, _ in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_digests(rows).collect()) == want


def test_secrets_values(rows):
    got = sorted((str(r.doc_id), r.n_assign, r.spans) for r in secrets.scan_digests(rows).collect())
    span = f"assign:2:{2 + len(KEY)}"
    assert got == sorted((str(i), int(i is None), span if i is None else "") for i, _, _ in ROWS)


def test_near_duplicate_values(rows):
    """Set sizes and components; rows of one id are judged by their own words."""
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dup.near_duplicates(rows, size=3, percent=85).collect())
    want = [("1", 6, "1"), ("4", 6, "1"), ("4", 6, "1"), ("2", 0, "2"), ("3", 0, "3"), ("6", 0, "6"), ("5", 1, "5"), ("None", 1, "None"), ("7", 1, "7"), ("7", 1, "7")]
    assert got == sorted(want)


def test_line_values(spark):
    """Hosts with null, empty and repeated texts: lines on more than half of a host's pages go, wherever they stand in a page."""
    rows = [(i, "h" if i < 12 else None, f"own {i}\nfoot\n\nfoot" if i % 2 else f"foot\nown {i}") for i in range(24)] + [(90, "h", None), (91, "h", ""), (92, None, "foot")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert all("foot" not in (got[i] or "").split("\n") and f"own {i}" in got[i].split("\n") for i in range(24)) and got[90] is None and got[91] == "" and not got[92]


def test_another_tokenizer_is_used_as_it_is(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["Hello  World, it's 1234\n", "ÉÈ été ½", "", None, "a <|endoftext|> b"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path, with_ids=True).collect()
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += r.ids
    assert {i: x for i, x in ids.items()} == {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert packing.WordIds(packing.tokenizer_file()).known and not packing.WordIds(path).known


def test_waiting_tokens_are_summed_as_they_come():
    packer = packing.Packer()
    for k in range(3000):
        packer.add(k, 1 + k * 7919 % 900)
        assert packer.held == {t: sum(p[0] for p in packer.waiting[t]) for t in packer.tiers} or k % 100
    packer.flush()
    assert packer.tokens == sum(packer.held.values()) == sum(p[0] for t in packer.waiting.values() for p in t)
    packer.flush(end=True)
    assert packer.tokens == 0 and sum(p[0] for _, pieces in packer.take() for p in pieces) == sum(1 + k * 7919 % 900 for k in range(3000))


# ------------------------------------------------------------------ stages of the pipeline


def test_toxicity_mixing_and_packing_stages(spark, data):
    """Toxicity keeps what its model grades 0; mixing repeats and thins out whole documents to the targets; packing loses nothing."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from shelfrank.llm import toxicity

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}

    def severity(t):
        counts = toxicity.counts_of(t, model.names)
        import numpy as np

        score = sum(float(model.value(np.array([n]))[0]) * model.weights[k] for k, n in counts.items())
        return sum(model.chances(np.array([score]))[0] >= 0.5) if t else 0

    clean = p.drop_toxic(spark, docs, data).cache()
    assert {r.doc_id for r in clean.collect()} == {i for i, t in text.items() if severity(t) == 0}

    mixed = p.mix_sources(spark, clean, data).cache()
    sizes, order = Counter(), sorted({r.source for r in clean.collect()}, key=lambda s: (s is None, s or ""))
    for r in clean.collect():
        sizes[r.source] += len(words(r.text))
    weight, capped, total = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        rest, left = total - sum(capped.values()), sum(w for s, w in weight.items() if s not in capped)
        more = {s: 3 * sizes[s] for s in order if s not in capped and rest * weight[s] / left > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    taken, longest = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
        longest[r.source] = max(longest[r.source], len(words(r.text)))
        assert text[r.doc_id] == r.text
    assert all(abs(taken[s] - capped.get(s, rest * weight[s] / left)) <= max(len(words(t)) for t in text.values()) for s in order)

    whole = Tokenizer.from_file(packing.tokenizer_file())
    times, n = Counter(r.doc_id for r in mixed.collect()), Counter()
    for r in p.pack_sequences(spark, mixed, data).collect():
        n[r.doc_id] += r.length
    assert n == Counter({i: k * (len(whole.encode(text[i] or "", add_special_tokens=False).ids) + 1) for i, k in times.items()})
