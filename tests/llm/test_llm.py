"""Each operator against SQL, a brute-force version, a round trip or held-out labels, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import ann, line_dedup, media, mixing, near_dup, packing, queries, secrets, toxicity, url_filter, warc

ROWS = [(1, "a b c d e f", "s1"), (2, None, None), (3, "", "s1"), (4, "a b c d e f", "s2"), (4, "a b c d e f", "s2"), (None, "x y", "s2"), (5, "w " * 60_000, "s3"), (6, " \t\n", "s1")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def rows(spark):
    """Nulls, blanks, repeats, a long text and columns whose names clash with inner ones."""
    clash = {c: F.lit("x") for c in ("node", "label", "_keys", "_id", "row", "size", "last", "score", "place")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(name)


def test_awkward_and_empty_tables(spark, rows):
    none = rows.where("false")
    model = toxicity.Model()
    for f in (mixing.mixed_sizes, line_dedup.drop_boilerplate, media.media_digests, packing.pack, secrets.scan_digests, near_dup.near_duplicates, lambda d: toxicity.grade(d, model)):
        assert f(none).count() == 0
    for f in (mixing.mixed_sizes, line_dedup.drop_boilerplate, media.media_digests, secrets.scan_digests, near_dup.near_duplicates, lambda d: toxicity.grade(d, model)):
        assert f(rows).count() == len(ROWS)
    for f in (mixing.mix, line_dedup.drop_boilerplate, near_dup.drop_near_duplicates, lambda d: toxicity.drop_toxic(d, model)):
        assert f(rows).columns == rows.columns and f(none).count() == 0


# ------------------------------------------------------------------ mixing


def test_water_filling_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[min(i // 10, 2)]) for i in range(300)], SCHEMA)
    got = mixing.mixed_sizes(docs).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (by.taken == (by.target + 0.5).astype(int)).all() and (by.target <= 3 * by["size"] + 1e-9).all()
    assert by.target.sum() == pytest.approx(got["size"].sum()) and (got.taken <= 3 * got["size"]).all()
    assert by.target["a"] == 3 * by["size"]["a"] and by.target["b"] == 3 * by["size"]["b"]
    copies = mixing.mix(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    assert all(abs(r.n - by.target[r.source]) <= 7 for r in copies)


# ------------------------------------------------------------------ media


def test_media_round_trip():
    for text in (b"", b"x", b"y" * 192, bytes(range(256)) * 500):
        payload = media.padded(text)
        data = media.write_container(payload)
        info = media.read_container(data)
        assert media.payload_of(data, info) == payload and payload.startswith(text) and len(payload) % 192 == 0 and payload
        assert info["duration"] == info["ticks"] == len(payload) and info["samples"] == len(payload) // 192
        assert info["keyframes"][0]["first_byte"] == data.index(payload)


def test_broken_media_is_reported(spark):
    good = media.write_container(media.padded(b"abc"))
    bad = spark.createDataFrame([(1, 3, bytearray(good[:-5])), (2, 0, bytearray(b"junk")), (3, 0, None), (4, 3, bytearray(good))], "id long, n_bytes long, media binary")
    assert [r.valid for r in media.read_media(bad).orderBy("id").collect()] == [False, False, False, True]


def test_media_digests(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for d in docs.collect():
        payload = media.padded((d.text or "").encode())
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len((d.text or "").encode()), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


# ------------------------------------------------------------------ toxicity


def test_ordinal_fit_shares_weights_and_orders_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x @ [2.0, -1.0, 0.0] + rng.logistic(size=600) * 0.3, [-1, 1])
    w, cuts = toxicity.fit_ordinal(x, y)
    assert cuts[0] < cuts[1] and w[0] > 0 > w[1] and abs(w[2]) < abs(w[1])
    assert ((x @ w)[:, None] > cuts).sum(axis=1).tolist() == pytest.approx(y, abs=1) and (((x @ w)[:, None] > cuts).sum(axis=1) == y).mean() > 0.8


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    held = toxicity.grade(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").groupBy("label").agg(F.avg(F.col("toxic").cast("int")).alias("p")).collect()
    share = {r.label: r.p for r in held}
    assert share[1] > 0.85 and share[0] < 0.01


def test_scores_do_not_depend_on_how_tokens_are_cut(spark):
    model = toxicity.Model({"bad": 0, "^badl": 1, "worse": 2}, np.array([1.0, 0.5, 2.0]), np.array([1.5, 3.0]))
    texts = ["bad", "Bad-bad,BADLY worse\u00a0bad", "fine_words 9bad9", "bad." * 50, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.grade(docs, model).collect():
        counts = toxicity.counts_of(texts[r.doc_id], model.names)
        score = sum((1 + np.log(n)) * model.weights[k] for k, n in counts.items())
        want = model.chances(np.array([score]))[0].sum() if texts[r.doc_id] else 0
        assert r.expected_severity == pytest.approx(want)


# ------------------------------------------------------------------ packing


def test_packing_is_whole_and_dense(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet").union(spark.createDataFrame([(-1, None, "", "", 0), (-2, "É <|endoftext|> Ⅷ ñandú, x.", "", "", 0), (-3, "ΟΔΟΣ á  b", "", "", 0)], "a long, b string, c string, d string, e long"))
    whole = Tokenizer.from_file(packing.tokenizer_file())
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    got = packing.pack(docs, with_ids=True).toPandas()
    for doc, part in got.sort_values("start").groupby("doc_id"):
        assert [i for x in part.ids for i in x] == ids[doc] and (part.doc_tokens == len(ids[doc])).all()
        assert part.start.tolist() == [0, *part.length.cumsum()[:-1]]
        assert all(zlib.crc32(np.asarray(x, "<u4").tobytes()) == c for x, c in zip(part.ids, part.ids_crc32, strict=True))
    used = 0
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 2048
        n = int(part.length.sum())
        used += n if n & (n - 1) == 0 else 2048
    assert used - sum(map(len, ids.values())) <= 2048 * docs.rdd.getNumPartitions()


# ------------------------------------------------------------------ WARC


def test_transactions(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\n", None), (2, "http://b/", ""), (None, "u", "z"), (9, "u", "é\r\n\r\nWARC/1.1\r\n" * 50)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(warc.captures(pages), path)
    got = warc.transactions(warc.read_archives(spark, path, payload=True)).collect()
    assert len(got) == 6 and all(r.request and r.response and r.metadata for r in got)
    by = {(r.metadata.page_id, r.response.type): r for r in got}
    assert by[3, "revisit"].metadata.refers_page == 1 and by[3, "revisit"].response.refers_to == by[1, "response"].capture_id and by[3, "revisit"].response.payload_bytes == 4
    assert by[2, "revisit"].metadata.refers_page == 2 and by[9, "response"].response.payload == "é\r\n\r\nWARC/1.1\r\n" * 50
    assert by[9, "response"].response.digest == by[9, "response"].response.header_digest and by[None, "response"]


# ------------------------------------------------------------------ secrets


def test_base_spans_and_random_strings(spark):
    key = "AKIA" + "Q7" * 8
    text = f'é token: "{"x1" * 8}" secret=short {key} ' + "ab12" * 5 + " passWD = " + "k" * 12
    found = [(k, text[s:e]) for s, k, e in secrets.base_spans(text)]
    assert found == [(0, f'token: "{"x1" * 8}'), (1, key), (2, "ab12" * 5), (0, "passWD = " + "k" * 12)]
    rng = random.Random(0)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [(i, f"the station of information was interesting token={make(24)} transformationalinformation") for i in range(200)]
    texts.append((1000, f"look {make(40)} and internationalizationstation here"))
    got = {r.doc_id: r for r in secrets.scan_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1000].n_markov == 1 and got[1000].spans == "markov:5:45" and all(got[i].n_assign == 1 and got[i].n_markov == 0 for i in range(200))
    assert got[1000].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_short_random_strings_are_found_and_do_not_train_the_ordinary_model(spark):
    rng, alphabet = random.Random(3), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [(i, f"the station of information was interesting and considerable token={make(24)} administration") for i in range(200)]
    texts += [(1000 + i, f"look {make(16)} and transformation here") for i in range(100)] + [(2000, make(11)), (2001, "interestingstation")]
    got = {r.doc_id: r for r in secrets.scan_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[i].n_markov == 0 for i in (*range(200), 2000, 2001))
    found = [got[1000 + i].spans for i in range(100)]
    assert found.count("markov:5:21") >= 90 and set(found) <= {"", "markov:5:21"}


def test_hex_runs_are_the_whole_runs():
    plain = lambda t: [m.span() for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("0123456789abcdefx ") * rng.choice((1, 1, 1, 9)) for _ in range(80))
        assert [(s, e) for s, k, e in secrets.base_spans(t) if k == 2] == plain(t)


def test_clear_matches_are_those_without_overlap():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab  ") for _ in range(60))
        spans = sorted((s, rng.randrange(3), s + rng.randrange(1, 12)) for s in (rng.randrange(55) for _ in range(rng.randrange(6))))
        want = [m.span() for m in re.finditer("[ab]+", text) if not any(s < m.end() and m.start() < e for s, _, e in spans)]
        assert [m.span() for m in secrets.clear_of(spans, re.finditer("[ab]+", text))] == want


# ------------------------------------------------------------------ neighbours


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 8))
    v[50:120] = v[50]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0]), (1004, [None] * 8), (None, [1.0] * 8)]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + bad, "vec_id long, embedding array<double>")
    got = ann.search(e, every=20, k=10).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        scores = (v * v[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(400), -scores))[:10]
        hit += len(set(best) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 11)) and np.allclose(part.score, scores[part.vec_id], rtol=0, atol=1e-12)
        assert [*zip(-part.score, part.vec_id, strict=True)] == sorted(zip(-part.score, part.vec_id, strict=True))
    assert hit >= 0.9 * 200 and ann.search(e.where("vec_id >= 1000")).count() == 0 and ann.search(e.where("vec_id = 0")).count() == 0


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(1)
    a, b, q = rng.normal(size=(5, 3)), rng.normal(size=(6, 3)), rng.normal(size=6)
    order = ann.visit(q, a, b, np.ones(30, int), 30)
    near = ((a @ q[:3])[:, None] + (b @ q[3:])[None, :]).ravel()
    assert sorted(order) == list(range(30)) and np.all(np.diff(near[order]) <= 1e-12)


# ------------------------------------------------------------------ URLs


def test_rules_and_bloom(spark):
    urls = ["http://NET/x", "http://a.net", "http://m.example.net/en/1?x", "http://example.com/de/", "https://x.org/fr/a#b", "nonsense", None, "http://c.com/p.html?q", "http://www.c.com/p/", "http://notexample.com/de/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.spelled_twice(pages)).collect()}
    assert [got[i].rule for i in range(10)] == ["net/", None, "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(10)] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "block", "block", "allow"]
    assert (got[0].host, got[5].host, got[6].path) == ("net", "", "")
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom, blocks = url_filter.build_bloom(keys)
    assert url_filter.may_be_listed(keys, "key", bloom, blocks).where("not _maybe").count() == 0
    others = spark.range(3000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filter.may_be_listed(others, "key", bloom, blocks).where("_maybe").count() < 60


# ------------------------------------------------------------------ near-duplicates


def brute(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = near_dup.words_of(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    texts, word = {}, lambda: f"w{rng.randrange(5000)}"
    for base in range(6):
        words = [word() for _ in range(120)]
        for copy in range(25):
            own = list(words)
            for _ in range(copy % 7):
                own[rng.randrange(len(own))] = word()
            texts[base * 100 + copy] = " ".join(own)
    texts |= {900: "A b", 901: "a  B", 902: "a b c", 903: None, 904: " ", 905: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        want = brute(texts, size, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, size=size, percent=percent).collect()}
        assert got == want
        kept = {r.doc_id for r in near_dup.drop_near_duplicates(docs, size=size, percent=percent).collect()}
        assert kept == {i for i, (_, c) in want.items() if c == i}


def test_sketches_merge():
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 1 << 63, 500, dtype=np.uint64), rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    assert (np.maximum(near_dup.registers(a), near_dup.registers(b)) == near_dup.registers(np.concatenate([a, b]))).all()


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages_agree_with_plain_versions(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = p.drop_toxic(spark, docs, data).cache()
    assert clean.columns == docs.columns and clean.count() <= docs.count()
    cut = p.drop_site_lines(spark, clean, data).cache()
    assert cut.count() == clean.count() and cut.where("n_chars <> length(text)").count() == 0
    single = p.drop_near_duplicates(spark, cut, data).cache()
    want = brute({r.doc_id: r.text for r in cut.collect()}, 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if c == i}
    mixed = p.mix_sources(spark, single, data).cache()
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in single.collect()}
    packed = p.pack_sequences(spark, mixed, data).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id for r in packed} == set(times) and all(r.n == r.d * times[r.doc_id] for r in packed)


# ------------------------------------------------------------------ rows that were lost before, and hot keys


def test_every_gzip_member_is_read(spark, tmp_path):
    record = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {21 + 1000 * i}\r\n\r\nHTTP/1.1 200 OK\r\nA: b".encode() + b"x" * (1000 * i - 2) + b"\r\n\r\n" if i else b""
    import gzip

    records = [record(i) for i in range(1, 6)]
    folder = tmp_path / "members"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (folder / "b.warc").write_bytes(b"".join(records))
    (folder / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, records))[:-20])
    got = warc.read_archives(spark, f"file://{folder}").groupBy("record_id").count().collect()
    assert {r.record_id: r["count"] for r in got} == {"<1>": 3, "<2>": 3, "<3>": 3, "<4>": 3, "<5>": 2}


def test_equal_pages_and_least_size(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (5, "v", "other"), (6, None, ""), (6, None, ""), (None, "u", "same"), (8, "w", "long" * 100_000), (7, "w", "long" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    for least in (0, 4):
        path = f"file://{tmp_path}/least{least}"
        warc.write_archives(warc.captures(pages, min_bytes=least), path)
        got = [(r.metadata.page_id, r.response.type, r.metadata.refers_page) for r in warc.transactions(warc.read_archives(spark, path)).collect()]
        again = "response" if least else "revisit"
        want = [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (5, "response", None), (6, "response", None), (6, again, None if least else 6), (None, "revisit", 1), (7, "response", None), (8, "revisit", 7)]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.page_captures(pages.where("false")).count() == 0


def test_repeated_query_rows_have_lists_of_their_own(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 6))
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(20, v[20].tolist(), "x"), (40, (2 * v[40]).tolist(), "x")]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string"), every=20, k=10).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 10, 20: 20, 40: 20}
    assert sorted(got["rank"]) == sorted(list(range(1, 11)) * 5)
    every = np.array([x[1] for x in rows])
    for q, at in ((0, [0]), (20, [20, 60]), (40, [40, 61])):
        want = []
        for i in at:
            scores = every @ every[i]
            order = [j for j in np.lexsort(([x[0] for x in rows], -scores)) if j != i][:10]
            want += [(rows[j][0], round(float(scores[j]), 9)) for j in order]
        assert sorted(want) == sorted((a, round(b, 9)) for a, b in got[got.query_id == q][["vec_id", "score"]].itertuples(index=False))


def test_rows_of_one_id_are_judged_by_their_own_words(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (4, text), (4, "quite another text of its own with many words"), (4, "quite another text of its own with many words"), (5, text + " more"), (6, None), (6, None), (None, text)]
    got = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1))).collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text) == sorted([("1", text), ("4", rows[2][1]), ("None", text)]) and sum(r.text is None for r in got) == 2


def test_hot_keys_are_split_and_nothing_is_broadcast(spark, monkeypatch):
    """The same groups where every key of over 5 rows is a hub, and where nothing may be broadcast."""
    from shelfrank.llm import common

    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(100)]
    texts = {i: " ".join(base[:50] + [f"n{i % 40}"] + base[51:]) for i in range(120)} | {500 + i: f"alone {i} " * 9 for i in range(20)} | {700: "", 701: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts, 5, 80)
    for hub, most in ((5, common.BROADCAST_BYTES), (1000, 0)):
        monkeypatch.setattr(common, "HUB", hub)
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        monkeypatch.setattr(near_dup, "BROADCAST_BYTES", most)
        monkeypatch.setattr(near_dup, "PIVOT_GROUP", hub)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == want
        assert {r.doc_id for r in near_dup.drop_near_duplicates(docs).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_large_filter_is_joined_by_block(spark, monkeypatch):
    from shelfrank.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame([(i, f"http://{'www.' * (i % 2)}h.com/{i // 2 % 90}", "x") for i in range(400)], "page_id long, url string, _at string")
    got = url_filter.judge(pages, url_filter.spelled_twice(pages)).collect()
    assert len(got) == 400 and all(r.listed for r in got) and url_filter.judge(pages.where("false"), url_filter.spelled_twice(pages)).count() == 0


# ------------------------------------------------------------------ whole queries against plain versions


def test_toxicity_query_equals_a_plain_version(spark, data):
    """Features, grades, weights and scores of all documents, from plain counts."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic is not null").collect():
        labels.setdefault(r.doc_id, []).append(r.toxic)
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    named = lambda w: [w, *("^" + w[:n] for n in (4, 5, 6, 7) if len(w) >= n)]
    sample = [(docs[i], max(x)) for i, x in labels.items() if i in docs]
    seen = {}
    for t, y in sample:
        for f in {f for w in words(t) for f in named(w)}:
            seen.setdefault(f, [0, 0])[y] += 1
    size, n = [sum(y == k for _, y in sample) for k in (0, 1)], len(sample)

    def certainty(c):
        cells = [(c[k], sum(c) * size[k] / n) for k in (0, 1)] + [(size[k] - c[k], (n - sum(c)) * size[k] / n) for k in (0, 1)]
        return sum(2 * a * np.log(a / b) for a, b in cells if a)

    best = sorted((-round(certainty(c), 6), f) for f, c in seen.items() if sum(c) >= 5 and certainty(c) >= 15)[:600]
    names = [f for _, f in best]
    place = {f: k for k, f in enumerate(names)}

    def vector(t):
        x = np.zeros(len(names))
        for w in words(t):
            for f in named(w):
                if f in place:
                    x[place[f]] += 1
        return np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0)

    x, y = np.array([vector(t) for t, _ in sample]), np.array([v for _, v in sample])
    held = x[:, [seen[f][1] > 4 * seen[f][0] for f in names]].sum(axis=1)
    grade = np.where(y == 1, 1 + (held > np.median(held[y == 1])), 0)
    w, cuts = toxicity.fit_ordinal(x, grade)
    every = [max(v) for v in labels.values() for _ in v]
    share = np.mean([v for vs in labels.values() for v in vs])
    cuts = cuts + np.log(y.mean() / (1 - y.mean())) - np.log(share / (1 - share))
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, data).collect()}
    assert set(got) == set(docs) and every
    for i, t in docs.items():
        p = 1 / (1 + np.exp(np.clip(cuts - vector(t) @ w, -50, 50))) if t else np.zeros(2)
        assert got[i].expected_severity == pytest.approx(p.sum(), abs=2e-3)
        if np.abs(p - 0.5).min() > 1e-2:
            assert got[i].severity == (p >= 0.5).sum() and got[i].toxic == (p[0] >= 0.5)


def test_secrets_query_equals_a_plain_version(spark, data):
    """Base spans, both models and all spans of all documents, from plain loops."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def base(t):
        out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])

    letters = "A-Za-z0-9+/_-"
    clear = lambda m, spans: all(m.end() <= s or e <= m.start() for s, _, e in spans)
    def chance(c):
        to, out = {}, {}
        for (x, y), k in c.items():
            to[y], out[x] = to.get(y, 0) + k, out.get(x, 0) + k
        return lambda a, b: np.log((c.get((a, b), 0) + 5.0 * (to.get(b, 0) + 0.5) / (sum(to.values()) + 0.5 * 67)) / (out.get(a, 0) + 5.0))

    def models(judged):
        counts = ({}, {})
        for t in docs.values():
            spans = base(t)
            random_ = [m[0] for s, _, e in spans for m in re.finditer(f"[{letters}]{{6,}}", t[s:e].split("=")[-1])]
            ordinary = [m[0] for m in re.finditer(f"(?<![{letters}])[{letters}]{{6,19}}(?![{letters}])", t) if clear(m, spans)]
            for c, tokens in zip(counts, (random_, [x for x in ordinary if len(x) < 12 or not judged(x)]), strict=True):
                for token in tokens:
                    for a, b in zip("^" + token[:-1], token, strict=True):
                        c[a, b] = c.get((a, b), 0) + 1
        one, two = map(chance, counts)
        score = lambda x: sum(one(a, b) - two(a, b) for a, b in zip("^" + x[:-1], x, strict=True))
        known = {}

        def reported(x):
            if x not in known:
                known[x] = score(x) >= max(30, len(x))
            return known[x]

        return reported

    reported = models(models(lambda x: True))
    got = {r.doc_id: r for r in queries.op6_secrets(spark, data).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        spans = base(t)
        line = lambda xs: ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{s}:{e}" for s, k, e in sorted(xs))
        assert got[i].base_sha256 == hashlib.sha256(line(spans).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        more = [(m.start(), 3, m.end()) for m in re.finditer(f"(?<![{letters}])[{letters}]{{12,}}", t) if clear(m, spans) and reported(m[0])]
        assert got[i].spans == line(spans + more)


# ------------------------------------------------------------------ awkward tables


def test_training_on_awkward_labels(spark):
    """Null, empty, repeated and contradicting labels; a label without a document; one kind only."""
    docs = spark.createDataFrame([(i, f"kind words number{i} of people" if i % 2 else f"vile stupid words number{i}", 1) for i in range(60)] + [(60, None, 1), (61, "", 1), (None, "x", 1)], "doc_id long, text string, _label int")
    rows = [(i, (i + 1) % 2) for i in range(60)] + [(0, 0), (0, 1), (0, None), (None, 1), (60, 0), (61, 1), (999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = {r.doc_id: r.severity for r in toxicity.grade(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == 63 and all((got[i] > 0) == (i % 2 == 0) for i in range(60)) and got[60] == got[61] == 0
    for some in (labels.where("false"), labels.where("toxic = 1")):
        assert toxicity.train(docs, some).names == {}
    assert toxicity.train(docs.where("false"), labels).names == {}


def test_packing_awkward_rows(spark, rows):
    """Nulls, blanks, repeated ids, a very long text and clashing columns: every token lies in one piece."""
    clash = rows.withColumns({"start": F.lit(1), "length": F.lit("x"), "ids": F.lit("x")})
    got = packing.pack(clash).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    n = {r.doc_id: (r.n, r.d) for r in got}
    assert n[2] == n[3] == n[6] == (1, 1) and n[4] == (14, 7) and n[5] == (60_001, 60_001) and n[None] == (3, 3) and n[1] == (7, 7)
    assert packing.pack(clash.where("doc_id = 2")).first().length == 1


def test_awkward_pages(spark):
    """Null and very long values, repeated rows, clashing columns and an empty table, for archives and URL filters."""
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "http://a.net/" + "p" * 200_000, "h" * 2_000_000, "x"), (3, "://", "", "x"), (4, "HTTP://A.NET?x", "é" * 10, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumns({"digest": F.lit("x"), "first": F.lit("x"), "_maybe": F.lit("x"), "key": F.lit("x")})
    got = {(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.page_captures(pages).collect()}
    assert got == {(1, "response", 0, None), (1, "revisit", 0, 1), (None, "response", 2_000_000, None), (3, "revisit", 0, 1), (4, "response", 20, None)}
    said = sorted(((str(r.page_id), r.host, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.spelled_twice(pages)).collect()), key=str)
    assert said == sorted([("1", "", None, "allow"), ("1", "", None, "allow"), ("None", "a.net", "net/", "block"), ("3", "", None, "allow"), ("4", "a.net", None, "allow")], key=str)
    assert url_filter.judge(pages, spark.createDataFrame([], "key string")).count() == 5 and warc.page_captures(pages.where("false")).count() == 0


def test_pipeline_stages_on_awkward_and_empty_tables(spark, rows, data):
    import corpus_pipeline as p

    docs = rows.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "_gone": F.lit("x"), "_times": F.lit(1), "doc": F.lit("x"), "_left": F.lit("x")})
    for table in (docs, docs.where("false")):
        now = table
        for _, stage in p.STAGES[:-1]:
            after = stage(spark, now, data)
            assert after.columns == table.columns
            now = after.cache()
        ids = {r.doc_id for r in now.collect()}
        assert ids <= {r[0] for r in ROWS} and (not table.isEmpty()) == bool(ids)
        assert {r.doc_id for r in p.STAGES[-1][1](spark, now, data).collect()} == ids


def test_lines_on_a_hundredth_of_a_source_are_cut(spark):
    """Of 600 documents a line on 12 goes, one on 9 stays; in a source of 20, on 3 documents, it goes as before."""
    import corpus_pipeline as p

    rows = [(i, "big", f"own {i}\n" + ("often" if i < 12 else "seldom" if i < 21 else "none %d" % i)) for i in range(600)]
    rows += [(1000 + i, "small", f"own {i}\n" + ("thrice" if i < 3 else "none %d" % i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in p.drop_site_lines(spark, docs, "").collect()}
    assert {i for i, _, t in rows if got[i] != t} == {*range(12), 1000, 1001, 1002}
