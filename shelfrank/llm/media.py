"""Media columns: lossless storage in ISO media containers, and reading their structure without decoding payloads.

``store_media`` wraps each payload as one track of 8-bit audio samples. ``read_media`` walks the nested boxes, decodes
the sample tables and returns codec, duration and the byte ranges of keyframes; payload bytes are only sliced.

A null text is an empty payload (one chunk of padding). Any text length works: sizes over 32 bits take the 64-bit box
forms. Files may have several tracks, and fragments; boxes are read track by track. Broken or truncated containers give a
row with null fields and ``valid`` false. Equal texts give equal bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples (bytes) in a chunk; a payload is a positive multiple of this, and each chunk is one access unit.
CHUNK = 192
SAMPLE_RATE = 8000
#: Every so many chunks one is a sync sample.
KEYFRAME_EVERY = 16
#: Fixed values of the ISO base media format: boxes that hold boxes, and the unity matrix of headers.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of CHUNK."""
    return data + b" " * (max(1, -(-len(data) // CHUNK)) * CHUNK - len(data))


def _box(kind: bytes, body: bytes) -> bytes:
    size = len(body) + 8
    return struct.pack(">I4s", size, kind) + body if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + body


def _full(kind: bytes, body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags) + body)


def write_container(payload: bytes) -> bytes:
    """An ISO media file with ``payload`` as unsigned 8-bit mono samples, chunk by chunk."""
    n = len(payload) // CHUNK
    ftyp = _box(b"ftyp", struct.pack(">4sI", b"isom", 512) + b"isommp42")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    entry = struct.pack(">I4s6xH8xHHHHI", 36, b"raw ", 1, 1, 8, 0, 0, SAMPLE_RATE << 16)
    keys = range(1, n + 1, KEYFRAME_EVERY)

    def moov(start: int) -> bytes:
        wide = start + len(payload) >= 1 << 32
        stbl = (
            _full(b"stsd", struct.pack(">I", 1) + entry)
            + _full(b"stts", struct.pack(">III", 1, n, CHUNK))
            + _full(b"stss", struct.pack(">I", len(keys)) + struct.pack(f">{len(keys)}I", *keys))
            + _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1))
            + _full(b"stsz", struct.pack(">II", CHUNK, n))
            + (_full(b"co64", struct.pack(">IQ", 1, start)) if wide else _full(b"stco", struct.pack(">II", 1, start)))
        )
        long_ = n * CHUNK
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, SAMPLE_RATE, long_ & 0xFFFFFFFF, 0x10000, 0x100) + MATRIX + bytes(24) + struct.pack(">I", 2))
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, long_ & 0xFFFFFFFF, 0, 0, 0, 0x100, 0) + MATRIX + bytes(8), 3)
        mdhd = struct.pack(">IQQIQHH", 1 << 24, 0, 0, SAMPLE_RATE, long_, 0x55C4, 0)
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun") + b"SoundHandler\0")
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", 1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)) + dinf + _box(b"stbl", stbl))
        return _box(b"moov", mvhd + _box(b"trak", tkhd + _box(b"mdia", _box(b"mdhd", mdhd) + hdlr + minf)))

    start = len(ftyp) + len(moov(0)) + head
    if start + len(payload) >= 1 << 32:
        start = len(ftyp) + len(moov(1 << 32)) + head
    return ftyp + moov(start) + _box(b"mdat", payload)


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """``(path, body start, body end)`` of every box, parents before children."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("a box ends outside its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _numbers(data: memoryview, at: int, n: int, kind: str = "I") -> tuple[int, ...]:
    return struct.unpack_from(f">{n}{kind}", data, at)


class Track:
    """What the boxes of one track say: its samples with their places, from sample tables and then from fragments."""

    def __init__(self, data: memoryview, at: dict[bytes, tuple[int, int]]):
        box = lambda kind: at[kind][0]
        self.id = _numbers(data, box(b"tkhd") + (20 if data[box(b"tkhd")] else 12), 1)[0]
        wide = data[box(b"mdhd")]
        self.timescale, self.duration = struct.unpack_from(">IQ", data, box(b"mdhd") + 20) if wide else struct.unpack_from(">II", data, box(b"mdhd") + 12)
        self.handler = bytes(data[box(b"hdlr") + 8 : box(b"hdlr") + 12]).decode("latin-1")
        self.codec = bytes(data[box(b"stsd") + 12 : box(b"stsd") + 16]).decode("latin-1")
        same, n = _numbers(data, box(b"stsz") + 4, 2)
        self.sizes = [same] * n if same else list(_numbers(data, box(b"stsz") + 12, n))
        if b"stco" in at:
            chunks = _numbers(data, box(b"stco") + 8, _numbers(data, box(b"stco") + 4, 1)[0])
        else:
            chunks = _numbers(data, box(b"co64") + 8, _numbers(data, box(b"co64") + 4, 1)[0], "Q")
        runs = [_numbers(data, box(b"stsc") + 8 + 12 * k, 3) for k in range(_numbers(data, box(b"stsc") + 4, 1)[0])]
        self.starts: list[int] = []
        for k, (first, per, _) in enumerate(runs):
            until = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
            for chunk in range(first, until):
                pos = chunks[chunk - 1]
                for _ in range(min(per, n - len(self.starts))):
                    self.starts.append(pos)
                    pos += self.sizes[len(self.starts) - 1]
        if len(self.starts) < n:
            raise ValueError("chunks hold fewer samples than there are sizes")
        self.keys = list(_numbers(data, box(b"stss") + 8, _numbers(data, box(b"stss") + 4, 1)[0])) if b"stss" in at else list(range(1, n + 1))
        times = [_numbers(data, box(b"stts") + 8 + 8 * k, 2) for k in range(_numbers(data, box(b"stts") + 4, 1)[0])]
        self.ticks = sum(count * delta for count, delta in times)

    def fragment(self, data: memoryview, run: tuple[int, int], base: int, head: dict[str, int]) -> int:
        """Append the samples of one run of a fragment; where the next run begins. ``head`` has the defaults."""
        at = run[0]
        flags, count = _numbers(data, at, 1)[0] & 0xFFFFFF, _numbers(data, at + 4, 1)[0]
        at += 8
        pos, said_first = base, None
        if flags & 0x1:
            pos, at = head["base"] + struct.unpack_from(">i", data, at)[0], at + 4
        if flags & 0x4:
            said_first, at = _numbers(data, at, 1)[0], at + 4
        for k in range(count):
            said = {}
            for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "offset")):
                if flags & bit:
                    said[name], at = _numbers(data, at, 1)[0], at + 4
            if at > run[1]:
                raise ValueError("a run of samples ends outside its box")
            own = said.get("flags", said_first if k == 0 and said_first is not None else head["flags"])
            self.starts.append(pos)
            self.sizes.append(said.get("size", head["size"]))
            pos += self.sizes[-1]
            self.ticks += said.get("duration", head["duration"])
            if not own & 0x10000:
                self.keys.append(len(self.starts))
        return pos

    def info(self) -> dict:
        ends = [s + z for s, z in zip(self.starts, self.sizes, strict=True)]
        keys = [{"sample": k, "first_byte": self.starts[k - 1], "end_byte": ends[k - 1]} for k in self.keys]
        return {"track": self.id, "handler": self.handler, "codec": self.codec, "timescale": self.timescale, "duration": self.duration or self.ticks, "ticks": self.ticks,
                "samples": len(self.starts), "starts": self.starts, "sizes": self.sizes, "end": max(ends, default=0), "keyframes": keys}


def _defaults(data: memoryview, at: int, moof: int, after: int, first: bool, trex: dict[int, tuple[int, ...]]) -> tuple[int, dict[str, int]]:
    """Track of a fragment, and what its samples are without own words, from the fragment's and the file's defaults."""
    flags, track = _numbers(data, at, 1)[0] & 0xFFFFFF, _numbers(data, at + 4, 1)[0]
    at += 8
    head = dict(zip(("duration", "size", "flags"), trex.get(track, (0, 0, 0)), strict=True))
    head["base"] = moof if first or flags & 0x20000 else after
    if flags & 0x1:
        head["base"], at = _numbers(data, at, 1, "Q")[0], at + 8
    at += 4 if flags & 0x2 else 0
    for bit, name in ((0x8, "duration"), (0x10, "size"), (0x20, "flags")):
        if flags & bit:
            head[name], at = _numbers(data, at, 1)[0], at + 4
    return track, head


def read_tracks(data: bytes) -> list[dict]:
    """Every track of a file: codec, time scale, duration, sample places and keyframe byte ranges, also of fragments."""
    view = memoryview(data)
    parts: list[dict[bytes, tuple[int, int]]] = []
    trex: dict[int, tuple[int, ...]] = {}
    runs: list[tuple[bytes, int, int, int]] = []
    moof = 0
    for path, start, end in walk(view, 0, len(view)):
        if path == (b"moov", b"trak"):
            parts.append({})
        elif path[:2] == (b"moov", b"trak"):
            parts[-1].setdefault(path[-1], (start, end))
        elif path == (b"moov", b"mvex", b"trex"):
            track, _, *defaults = _numbers(view, start + 4, 5)
            trex[track] = tuple(defaults)
        elif path == (b"moof",):
            moof = start - (8 if view[start - 4 : start] == b"moof" else 16)  # the kind stands before the body, or the wide size
        elif path[:2] == (b"moof", b"traf") and path[-1] in (b"tfhd", b"trun"):
            runs.append((path[-1], start, end, moof))
    tracks = [Track(view, at) for at in parts]
    by_id, after, before, track, head = {t.id: t for t in tracks}, 0, None, 0, {}
    for kind, start, end, moof in runs:
        if kind == b"tfhd":
            track, head = _defaults(view, start, moof, after, moof != before, trex)
            before, after = moof, head["base"]
        elif track not in by_id:
            raise ValueError("a fragment of an unknown track")
        else:
            after = by_id[track].fragment(view, (start, end), after, head)
    found = [t.info() for t in tracks]
    if any(t["end"] > len(view) for t in found):
        raise ValueError("samples end outside the file")
    return found


def read_container(data: bytes) -> dict:
    """The track that stands for a file: its first one of video, else its first one; ``tracks`` has all."""
    tracks = read_tracks(data)
    if not tracks:
        raise ValueError("a file without tracks")
    return next((t for t in tracks if t["handler"] == "vide"), tracks[0]) | {"tracks": tracks}


def payload_of(data: bytes, info: dict) -> bytes:
    """The stored samples, joined in order; one slice where they are contiguous."""
    starts, sizes = info["starts"], info["sizes"]
    if not starts:
        return b""
    if all(a + z == b for a, z, b in zip(starts, sizes, starts[1:], strict=False)):
        return data[starts[0] : starts[-1] + sizes[-1]]
    return b"".join(data[s : s + z] for s, z in zip(starts, sizes, strict=True))


KEYFRAMES = "array<struct<sample:bigint,first_byte:bigint,end_byte:bigint>>"
_KEYS = pa.list_(pa.struct([("sample", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
TRACKS = f"array<struct<track:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:{KEYFRAMES}>>"
_TRACK = [("track", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", _KEYS)]
_TRACKS = pa.list_(pa.struct(_TRACK))


def store_media(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: every text as a container."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, batch.num_rows, 256):
                part = [x.as_py() or b"" for x in texts.slice(at, 256)]
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(part)), pa.array(map(len, part), pa.int64()), pa.array([write_container(padded(x)) for x in part], pa.binary())],
                    names=["id", "n_bytes", "media"],
                )

    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(write, f"id {kind}, n_bytes long, media binary")


def read_media(df: DataFrame, *, keep: tuple[str, ...] = ("id", "n_bytes")) -> DataFrame:
    """Structure and digests of the ``media`` column, next to the columns ``keep``; ``tracks`` has every track of a file.

    The columns of a file are those of its first video track, else of its first track.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(len(keep)):
                data = x.as_py()
                try:
                    info = read_container(data)
                    payload = payload_of(data, info)
                    rows.append((True, info["codec"], info["timescale"], info["duration"], info["samples"], info["keyframes"], len(payload),
                                 hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                                 [{c: x[c] for c, _ in _TRACK} for x in info["tracks"]]))
                except (ValueError, KeyError, IndexError, struct.error, TypeError):
                    rows.append((False, None, None, None, None, None, None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None))
            kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _KEYS, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _TRACKS]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.record_batch([*(batch.column(k) for k in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*keep, *_READ])

    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "media").mapInArrow(
        read,
        f"{kept}, valid boolean, codec string, timescale long, duration long, samples long, keyframes {KEYFRAMES}, "
        f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tracks {TRACKS}",
    )


_READ = ["valid", "codec", "timescale", "duration", "samples", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tracks"]


def media_digests(documents: DataFrame) -> DataFrame:
    """Store every text, read it back and sum its structure up in ``feature``."""
    back = read_media(store_media(documents))
    last = F.element_at("keyframes", -1)
    feature = F.concat_ws(
        ";", F.col("codec"), F.concat(F.col("duration").cast("string"), F.lit("/"), F.col("timescale").cast("string")), F.concat(F.lit("samples="), F.col("samples").cast("string")),
        F.concat(F.lit("keyframes="), F.size("keyframes").cast("string")), F.concat(F.lit("last="), last["first_byte"].cast("string"), F.lit("-"), last["end_byte"].cast("string")),
    )
    return back.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec",
        (F.col("duration") / F.col("timescale")).alias("seconds"), F.col("keyframes"),
    )
