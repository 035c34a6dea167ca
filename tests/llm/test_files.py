"""Ordinary media files and archives: several tracks, fragments, links in any direction, damaged places; graded labels and samples."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import media, secrets, toxicity, warc

box, full = media._box, media._full


def track(number, handler, codec, chunks, sizes, keys=None, wide=False):
    """A track of one sample in each chunk."""
    stbl = full(b"stsd", struct.pack(">I", 1) + struct.pack(">I4s", 8, codec)) + full(b"stts", struct.pack(">III", 1, len(sizes), 10))
    if keys is not None:
        stbl += full(b"stss", struct.pack(f">{1 + len(keys)}I", len(keys), *keys))
    stbl += full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)) + full(b"stsz", struct.pack(f">{2 + len(sizes)}I", 0, len(sizes), *sizes))
    stbl += full(b"co64", struct.pack(f">I{len(chunks)}Q", len(chunks), *chunks)) if wide else full(b"stco", struct.pack(f">{1 + len(chunks)}I", len(chunks), *chunks))
    tkhd = full(b"tkhd", struct.pack(">III", 0, 0, number) + bytes(68))
    mdhd = full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000 * number, 10 * len(sizes), 0))
    hdlr = full(b"hdlr", struct.pack(">I4s", 0, handler) + bytes(13))
    return box(b"trak", tkhd + box(b"mdia", mdhd + hdlr + box(b"minf", box(b"stbl", stbl))))


def two_tracks(first_audio):
    """Audio at bytes 0 to 9 of the data, video (keyframes 1 and 3) behind it; offsets of 64 bits in one, of 32 in the other."""
    ftyp, data = box(b"ftyp", b"isom\0\0\0\0"), bytes(range(60))

    def moov(at):
        audio = track(1, b"soun", b"mp4a", [at, at + 5], [5, 5], wide=True)
        video = track(2, b"vide", b"avc1", [at + 10, at + 20, at + 30], [10, 10, 20], keys=[1, 3])
        return box(b"moov", audio + video if first_audio else video + audio)

    at = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(at) + box(b"mdat", data), at


@pytest.mark.parametrize("first_audio", [True, False])
def test_tracks_are_read_apart(spark, first_audio):
    data, at = two_tracks(first_audio)
    info = media.read_container(data)
    assert (info["codec"], info["timescale"], info["duration"], info["samples"]) == ("avc1", 2000, 30, 3)
    assert info["keyframes"] == [{"sample": 1, "first_byte": at + 10, "end_byte": at + 20}, {"sample": 3, "first_byte": at + 30, "end_byte": at + 50}]
    assert media.payload_of(data, info) == bytes(range(10, 50))
    row = media.read_media(spark.createDataFrame([(1, 0, bytearray(data))], "id long, n_bytes long, media binary")).first()
    got = {t.handler: (t.track, t.codec, t.samples, [k.first_byte for k in t.keyframes]) for t in row.tracks}
    assert row.valid and row.codec == "avc1" and got == {"soun": (1, "mp4a", 2, [at, at + 5]), "vide": (2, "avc1", 3, [at + 10, at + 30])}


def test_fragments_are_read():
    """Two fragments of a track without samples of its own: defaults of file, fragment and sample, and a run without offset."""
    empty = track(7, b"vide", b"hvc1", [], [])
    moov = box(b"moov", empty + box(b"mvex", full(b"trex", struct.pack(">IIIII", 7, 1, 40, 6, 0x10000))))
    head = box(b"ftyp", b"iso6\0\0\0\0") + moov

    def moof(data_offset):
        first = full(b"trun", struct.pack(">IiI", 2, data_offset, 0), 0x5)  # its first sample is a keyframe
        later = full(b"trun", struct.pack(">IIII", 2, 9, 0x10000, 3) + struct.pack(">I", 0), 0x600)
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)) + box(b"traf", full(b"tfhd", struct.pack(">I", 7), 0x20000) + first + later))

    one = moof(len(moof(0)) + 8) + box(b"mdat", bytes(24))
    data = head + one + one
    info = media.read_container(data)
    begin = len(head) + len(moof(0)) + 8
    assert info["codec"] == "hvc1" and info["samples"] == 8 and info["sizes"] == [6, 6, 9, 3] * 2 and info["duration"] == 8 * 40
    assert info["starts"][:4] == [begin, begin + 6, begin + 12, begin + 21] and info["starts"][4] == begin + len(one)
    assert [k["sample"] for k in info["keyframes"]] == [1, 4, 5, 8]
    with pytest.raises((ValueError, struct.error)):
        media.read_container(data[:-5])


# ------------------------------------------------------------------ archives


def record(kind, name, to=(), block=b"", length=None):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *(f"WARC-Concurrent-To: <{x}>" for x in to)]
    lines += [f"Content-Length: {len(block)}"] if length is None else [length] if length else []
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_links_count_in_both_directions(spark, tmp_path):
    """A response that names its request; metadata that names the request; several names in one record; usual ones beside them."""
    page = b"HTTP/1.1 200 OK\r\n\r\nx"
    records = [record("request", "q1"), record("response", "r1", ["q1"], page), record("metadata", "m1", ["r1"], b"page-id: 1")]
    records += [record("response", "r2", (), page), record("request", "q2", ["r2"]), record("metadata", "m2", ["q2"], b"page-id: 2")]
    records += [record("request", "q3"), record("metadata", "m3", ["q3", "r3"], b"page-id: 3"), record("revisit", "r3", (), b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n")]
    records += [record("response", "r4", (), page), record("request", "q4", ["r4"]), record("metadata", "m4", ["r4"], b"page-id: 4"), record("request", "q5", ["gone"])]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    got = {r.capture_id: r for r in warc.transactions(warc.read_archives(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>", "<r4>", "<gone>"}
    for k in "1234":
        r = got[f"<r{k}>"]
        assert (r.request.record_id, r.response.record_id, r.metadata.record_id, r.metadata.page_id) == (f"<q{k}>", f"<r{k}>", f"<m{k}>", int(k))
    assert got["<gone>"].response is None and got["<gone>"].request.record_id == "<q5>"


def test_damaged_files_are_reported_and_others_read(spark, tmp_path):
    good = record("response", "a", (), b"HTTP/1.1 200 OK\r\n\r\nx")
    files = {"whole": good, "length": good + record("response", "b", (), b"y", ""), "letters": good + record("request", "b", (), b"", "Content-Length: many"), "foreign": b"hello\r\n\r\n" + good}
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    packed = gzip.compress(good)
    (tmp_path / "garbage.warc.gz").write_bytes(packed + b"\x1f\x8b\x08\0garbagegarbage")
    got = warc.read_archives(spark, f"file://{tmp_path}")
    assert got.where("type = 'response'").count() == 4 and sorted(r.error.split(":")[0] for r in got.where("type = 'damaged'").collect()) == ["a record does not begin with its version", "a record without a length", "a record without a length", "gzip"]
    assert {r.capture_id for r in warc.transactions(got).collect()} == {"<a>"}


# ------------------------------------------------------------------ samples and graded labels


def test_sample_does_not_vanish_on_large_tables():
    for n in (10**4, 10**10, 10**14):
        share = (secrets.sample_bar(n) + (1 << 63)) / (1 << 64)
        assert share * n == pytest.approx(secrets.SAMPLE_DOCUMENTS, rel=1e-3)
    assert secrets.sample_bar(4000) is None


def test_sample_of_rows_that_share_one_id(spark, monkeypatch):
    """Of many rows with one id some train; equal rows count once."""
    seen = []
    monkeypatch.setattr(secrets, "SAMPLE_DOCUMENTS", 50)
    monkeypatch.setattr(secrets, "_ratio", lambda sample, first: seen.append(sample.count()) or np.zeros((secrets.SIZE, secrets.SIZE)))
    rows = spark.range(2000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1000).alias("text"))
    secrets.train(rows, F.col("text"), F.col("doc_id"))
    assert 20 <= seen[0] <= 90


def test_graded_labels_and_many_documents_of_one_id(spark):
    """Labels 0 to 3: each grade has a word of its own; one labelled id has a thousand documents."""
    words = ["kind", "rude", "vile", "hateful"]
    docs = [(i, f"{words[i % 4]} words of number{i} and people") for i in range(400)] + [(5000, f"rude text {i}") for i in range(1000)]
    labels = [(i, i % 4) for i in range(400)] + [(5000, 1), (1, 0), (7, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.grade(table.where("doc_id < 400"), model).collect()}
    assert len(model.thresholds) == 3 and np.all(np.diff(model.thresholds) >= 0) and np.isfinite(model.thresholds).all()
    assert all(got[i].severity == i % 4 for i in range(400))
    assert got[3].expected_severity > got[2].expected_severity > got[1].expected_severity > got[0].expected_severity
    with pytest.raises(ValueError):
        toxicity.train(table, spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").alias("toxic")))
