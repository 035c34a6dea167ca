"""Hierarchical multi-length packing of tokenized documents.

A document's ids are its tokens and one end id. Full windows of the longest context are cut off; the rest goes to the
shortest tier that holds it. Every tier fills windows of its own length, the longest tier first: a window opens with
the tier's longest piece, its gap takes the longest pieces of the same or shorter tiers that fit, and the last bit of
gap is filled by cutting a piece, so windows are full. What remains of a task at its end goes to power-of-two
sequences, and less than the smallest of those to one padded sequence. Sequences of one tier are dealt to step groups
of equal size and like attention cost.

Packing runs inside the input's own partitions: nothing is shuffled, memory holds ``FLUSH_TOKENS`` tokens, and a lost
task is packed again alike. A null or empty text is just the end id. Rows of one id are packed as separate documents.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from codecs import charmap_decode
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Context sizes, longest first; each is a power of two.
TIERS = (2048, 1024, 512)
#: Shortest exact sequence that a task's last tokens are cut to.
SMALLEST = 64
#: Tokens that wait in a task before windows are filled.
FLUSH_TOKENS = 1 << 20
#: Sequences in a step group.
GROUP = 8
END_ID = 1
#: Bytes of words and ids that a task's cache holds before it starts anew, and the longest word kept.
CACHE_BYTES, LONGEST_KEPT = 40 << 20, 48
#: What a cached word takes besides its characters and ids: two bytes objects and a place in the dict.
ENTRY_BYTES = 120
#: Fixed value: how the tokenizer cuts a lower-case word before its merges, for words of Latin-1 characters only.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
#: How the tokenizer's file says that it prepares and cuts texts. Files that say else are used as they are.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Latin-1 characters that the tokenizer takes for blanks and the split into words does not, or the other way round.
BLANKS = re.compile("[\x1c-\x1f\x85\xa0]")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> str:
    """Letter of each byte in byte-level BPE: printable Latin-1 stands for itself, other bytes for 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class WordIds(dict):
    """Word (UTF-8 bytes without ASCII white space) to its ids as little-endian 32-bit bytes.

    The tokenizer splits at white space before anything else, so a text's ids are those of its words in order. Words of
    Latin-1 characters are cut into pieces here and go straight to the BPE model; all others go through the whole
    tokenizer. So does every text where the file is not ``known`` to prepare and cut texts in this way. CACHE_BYTES bound what is kept; a task makes its own cache and drops it at its end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.known = (said["normalizer"], said["pre_tokenizer"], said["model"]["type"]) == (NORMALIZER, PRE_TOKENIZER, "BPE")
        self.marks = {m: self.merged(bytes([m])) for m in b".,"} if self.known else {}

    def merged(self, piece: bytes) -> bytes:
        return array("I", [t.id for t in self.tokenize(charmap_decode(piece, "strict", self.letters)[0])]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def pieces(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not _is_latin_1(text) or BLANKS.search(text):  # may hold a special token, or other forms
            return self.whole(text)
        return b"".join([self.merged(piece.encode()) for piece in PIECES.findall(text.lower())])

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters stand for themselves
            ids = array("I", [t.id for t in self.tokenize(word.lower().decode())]).tobytes()
        elif word[-1] in b".," and word[-2:-1].isalnum():
            return self[word[:-1]] + self.marks[word[-1]]  # a mark after a letter or digit is a piece of its own
        else:
            ids = self.pieces(word)
        if len(word) <= LONGEST_KEPT:
            if self.held >= CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += ENTRY_BYTES + len(word) + len(ids)
        return ids


def _is_latin_1(text: str) -> bool:
    """Without characters that the tokenizer's normal form would join to others."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def token_bytes(text: str | None, words: WordIds) -> bytes:
    """A document's ids with the end id, as little-endian 32-bit bytes."""
    if not text:
        return END_ID.to_bytes(4, "little")
    if not words.known:
        return words.whole(text) + END_ID.to_bytes(4, "little")
    data = text.encode()
    if "<|" not in text and _is_latin_1(text):  # lower case comes to the same ids, and to fewer words
        data = data.lower()
    parts = [words[w] for w in data.split()]
    parts.append(END_ID.to_bytes(4, "little"))
    return b"".join(parts)


Piece = tuple[int, int, int]  # length, document number, start


class Packer:
    """Fills windows from pieces; ``take()`` hands out the finished ones as ``(window length, pieces)``."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, smallest: int = SMALLEST):
        self.tiers, self.smallest = tuple(sorted(tiers, reverse=True)), smallest
        self.waiting: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.tokens, self.held = 0, dict.fromkeys(self.tiers, 0)  # that wait, in all and by tier
        self.done: list[tuple[int, list[Piece]]] = []

    def add(self, doc: int, length: int, start: int = 0) -> None:
        top = self.tiers[0]
        while length >= top:
            self.done.append((top, [(top, doc, start)]))
            start, length = start + top, length - top
        if length:
            self._put((length, doc, start))

    def _put(self, piece: Piece) -> None:
        tier = next(t for t in reversed(self.tiers) if piece[0] <= t)
        insort(self.waiting[tier], piece)
        self.tokens += piece[0]
        self.held[tier] += piece[0]

    def _pop(self, tier: int, at: int) -> Piece:
        piece = self.waiting[tier].pop(at)
        self.tokens -= piece[0]
        self.held[tier] -= piece[0]
        return piece

    def _fill(self, window: int, tiers: tuple[int, ...]) -> list[Piece]:
        pieces, gap = [], window
        while gap:
            for tier in tiers:  # the longest piece that fits, from the longest tier on
                at = bisect_right(self.waiting[tier], (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    pieces.append(self._pop(tier, at))
                    break
            else:  # none fits: cut the shortest piece of the shortest tier that has one
                tier = next(t for t in reversed(tiers) if self.waiting[t])
                length, doc, start = self._pop(tier, 0)
                pieces.append((gap, doc, start))
                self._put((length - gap, doc, start + gap))
            gap -= pieces[-1][0]
        return pieces

    def flush(self, end: bool = False) -> None:
        for k, tier in enumerate(self.tiers):
            below = self.tiers[k:]
            while self.waiting[tier] and sum(self.held[t] for t in below) >= tier:
                self.done.append((tier, self._fill(tier, below)))
        if end:
            size = self.tiers[0]
            while self.tokens:
                while size > self.tokens:
                    size //= 2
                if size < self.smallest:
                    self.done.append((self.tiers[0], self._fill(self.tokens, self.tiers)))
                else:
                    self.done.append((size, self._fill(size, self.tiers)))

    def take(self) -> list[tuple[int, list[Piece]]]:
        out, self.done = self.done, []
        return out


def step_groups(windows: list[tuple[int, list[Piece]]]) -> list[int]:
    """Group number of each window: tiers apart, costs (sum of squared piece lengths) dealt out back and forth."""
    groups, first = [0] * len(windows), 0
    for tier in sorted({w for w, _ in windows}, reverse=True):
        own = sorted((i for i, (w, _) in enumerate(windows) if w == tier), key=lambda i: -sum(p[0] ** 2 for p in windows[i][1]))
        n = -(-len(own) // GROUP)
        for k, i in enumerate(own):
            turn, at = divmod(k, n)
            groups[i] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, tokenizer: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; ``with_ids`` adds the ids themselves."""
    small_batches(documents.sparkSession)
    path = tokenizer or tokenizer_file()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
              ("offset", pa.int64()), ("tier", pa.int64()), ("step_group", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        words = WordIds(path)
        packer, docs, keys, kind = Packer(tiers), {}, {}, None
        count = {"doc": 0, "sequence": 0, "group": 0}

        def finished() -> Iterator[pa.RecordBatch]:
            windows = packer.take()
            groups = step_groups(windows)
            rows: list[tuple] = []
            for (window, pieces), group in zip(windows, groups, strict=True):
                offset = 0
                for length, doc, start in pieces:
                    ids = docs[doc][4 * start : 4 * (start + length)]
                    row = (keys[doc], start, length, zlib.crc32(ids), len(docs[doc]) // 4, part + count["sequence"], offset, window, part + count["group"] + group)
                    rows.append((*row, memoryview(ids).cast("i").tolist()) if with_ids else row)
                    offset += length
                count["sequence"] += 1
            count["group"] += max(groups, default=-1) + 1
            waiting = {p[1] for t in packer.waiting.values() for p in t}
            for gone in [d for d in docs if d not in waiting]:
                del docs[gone], keys[gone]
            for at in range(0, len(rows), 5000):
                columns = zip(*rows[at : at + 5000], strict=True)
                types = [kind, *(t for _, t in fields)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", *(n for n, _ in fields)])

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = token_bytes(text.as_py(), words)
                doc = count["doc"]
                count["doc"] += 1
                docs[doc], keys[doc] = ids, key.as_py()
                packer.add(doc, len(ids) // 4)
                if packer.tokens >= FLUSH_TOKENS or len(packer.done) >= 512:
                    packer.flush()
                    yield from finished()
        packer.flush(end=True)
        if kind is not None:
            yield from finished()

    picked = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ddl = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n, _ in fields)
    return picked.mapInArrow(run, ddl)
