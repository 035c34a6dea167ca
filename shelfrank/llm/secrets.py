"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two bigram models are trained from labelled samples: strings that the patterns found (random) and other words of the
same texts (ordinary). The ordinary model is trained twice: on words too short to be judged, then also on longer ones
that the first models did not report, so that no unlabelled secret trains it. A token whose log-likelihood ratio per
character and in sum exceed thresholds is a span of kind ``markov``, unless it overlaps a span of the patterns.
Positions are code points, ends exclusive.

A null text is empty. Texts are scanned whole. Without samples both models are uniform and only patterns report. Rows
of one id are scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Fixed patterns: kind, pattern, group whose length counts, and the least length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # runs under the least length are passed over by the pattern itself: a run is maximal either way
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = ("assign", "access", "hex", "markov")
#: Least length of tokens that the models judge, and that of the patterns' strings that train them.
JUDGED, LEAST = 12, 6
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % JUDGED)
WORD = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
#: Ordinary samples; longer tokens are rather paths and lists than words.
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,19}(?![A-Za-z0-9+/_-])" % LEAST)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIZE = len(ALPHABET) + 1  # the last is the beginning of a token
#: The classifier's bound: different documents whose strings train the models, about.
SAMPLE_DOCUMENTS = 4000
SMOOTHING, BACK_OFF = 0.5, 5.0
#: Least log-likelihood ratio per character, and in sum.
PER_CHARACTER, IN_SUM = 1.0, 30.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all pattern matches, sorted."""
    found = []
    for k, (_, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def clear_of(spans: list[tuple[int, int, int]], matches: Iterator[re.Match]) -> Iterator[re.Match]:
    """The matches that overlap none of ``spans``; both in order of their starts, in one pass."""
    k = reach = 0
    for m in matches:
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= m.start():
            yield m


_PLACE = np.full(128, -1, np.int64)
_PLACE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))


def steps(token: str) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of a token as (from, to) codes."""
    codes = _PLACE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return np.concatenate([[SIZE - 1], codes[:-1]]), codes


def sample_bar(n: int) -> int | None:
    """Signed 64-bit hashes below this make SAMPLE_DOCUMENTS of ``n`` rows, about; None takes all."""
    return None if n <= SAMPLE_DOCUMENTS else -(1 << 63) + (SAMPLE_DOCUMENTS << 64) // n


def train(documents: DataFrame, text: Column, key: Column) -> np.ndarray:
    """Log-likelihood ratio of each bigram, random over ordinary: one SIZE x SIZE table whatever the input's size.

    The sample is the rows of the smallest hashes of id and text; equal rows count once.
    """
    bar = sample_bar(documents.count())
    sample = documents.select(text.cast("string").alias("text"), F.xxhash64(key, text.cast("string")).alias("hash"))
    if bar is not None:
        sample = sample.where(F.col("hash") < F.lit(bar)).dropDuplicates(["hash"])
    sample = materialize(sample.select("text"), "secrets-sample")
    ratio = _ratio(sample, _ratio(sample, None))
    discard(sample)
    return ratio


def _ratio(sample: DataFrame, first: np.ndarray | None) -> np.ndarray:
    """The table from a sample; ordinary words long enough to be judged take part if ``first`` is there to judge them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((2, SIZE, SIZE), np.int64)
        for batch in batches:
            for t in batch["text"]:
                if not t:
                    continue
                spans = base_spans(t)
                for start, _, end in spans:
                    for m in WORD.finditer(t[start:end].rpartition("=")[2]):
                        np.add.at(both[0], steps(m[0]), 1)
                for m in clear_of(spans, ORDINARY.finditer(t)):
                    if len(m[0]) < JUDGED or (first is not None and not is_random(m[0], first)):
                        np.add.at(both[1], steps(m[0]), 1)
        kind, a, b = np.nonzero(both)
        yield pd.DataFrame({"kind": kind, "a": a, "b": b, "n": both[kind, a, b]})

    rows = sample.mapInPandas(count, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((2, SIZE, SIZE))
    for r in rows:  # at most 2 SIZE^2
        table[r["kind"], r["a"], r["b"]] = r["n"]
    # what a character is seldom followed by comes from how common the next character is at all
    common = table.sum(axis=1, keepdims=True) + SMOOTHING
    common /= common.sum(axis=2, keepdims=True)
    chance = np.log((table + BACK_OFF * common) / (table.sum(axis=2, keepdims=True) + BACK_OFF))
    return chance[0] - chance[1]


def is_random(token: str, ratio: np.ndarray) -> bool:
    score = float(ratio[steps(token)].sum())
    return score >= IN_SUM and score >= PER_CHARACTER * len(token)


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return [(m.start(), len(PATTERNS), m.end()) for m in clear_of(taken, TOKEN.finditer(text)) if is_random(m[0], ratio)]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans``: all spans of every text, by start, then kind."""
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    ratio = train(documents, text, key)

    @F.pandas_udf(SPANS)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = []
            for t in part:
                base = base_spans(t) if t else []
                every = sorted(base + markov_spans(t, ratio, base)) if t else []
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            yield pd.Series(out)

    return documents.select(key.alias("id"), spans(text).alias("spans"))


def scan_digests(documents: DataFrame) -> DataFrame:
    """Counts, the digest of the pattern spans, and all spans as text."""
    found = scan(documents)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        F.col("id").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), n("markov").alias("n_markov"),
    )
