"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and their beginnings, chosen from labelled documents. One weight vector serves all thresholds:
``P(severity > k) = 1 / (1 + exp(threshold_k - w . x))``; the sum over k is the expected severity. Labels of several
values are grades: severity k is the k-th smallest value. Where labels are only 0 and 1, the grades above 0 of documents
labelled 1 come from how much of what marks these they hold (lower half: grade 1, upper half: grade 2).

The fit uses a bounded sample of labels; scoring reads every text whole. A null or empty text has no features and gets
severity 0. With labels of one value nothing is toxic. Rows of one id are scored one by one; of contradicting labels of
one id the greatest counts, and of its texts one (of the smallest hash) is in the sample. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features besides the word.
BEGINNINGS = (4, 5, 6, 7)
#: The classifier's bounds: labelled documents of each value, values, and features.
SAMPLE_PER_KIND, MOST_GRADES, FEATURES = 2500, 20, 600
#: Documents of the sample in which a feature must be.
LEAST_DOCUMENTS = 5
#: Least G-test statistic of a feature against the labels.
LEAST_CERTAINTY = 15.0
GRADES = 3
#: A task's cache holds the features of so many tokens (about 6 MB) of at most so many characters.
KEPT_TOKENS, LONGEST_KEPT = 50_000, 48
PENALTY, STEPS, RATE = 1e-5, 500, 0.1


def features(word: str) -> list[str]:
    """The word and its beginnings; ``^`` marks a beginning."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    """Weights by feature, and the thresholds between grades; all bounded by FEATURES and GRADES."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 50.0))

    def value(self, counts: np.ndarray) -> np.ndarray:
        """1 for one occurrence, growing with the logarithm of more."""
        return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(severity > k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def counts_of(text: str | None, names: dict[str, int]) -> dict[int, int]:
    """How often each known feature is in ``text``."""
    found: dict[int, int] = {}
    if text:
        for word, n in Counter(WORD.findall(text.lower())).items():
            for f in features(word):
                if (k := names.get(f)) is not None:
                    found[k] = found.get(k, 0) + n
    return found


def values_of(labels: DataFrame, label_col: str) -> list:
    """The values of labels in order; they are grades, so there are few."""
    found = labels.where(F.col(label_col).isNotNull()).groupBy(label_col).count().orderBy(label_col).limit(MOST_GRADES + 1).collect()
    if len(found) > MOST_GRADES:
        raise ValueError(f"{label_col} has more than {MOST_GRADES} values: no grades")
    return [(r[0], r[1]) for r in found]


def sample_labels(labels: DataFrame, id_col: str, label_col: str, values: list) -> DataFrame:
    """``_id, _level``: at most SAMPLE_PER_KIND ids of each of ``values``, smallest hashes first."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_value"))
    parts = [one.where(F.col("_value") == v).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_KIND).select("_id", F.lit(k).alias("_level")) for k, v in enumerate(values)]
    return reduce(DataFrame.unionByName, parts)


def choose_features(sample: DataFrame) -> list[tuple[str, int, int]]:
    """``(feature, clean documents, toxic documents)`` of the most telling features of ``sample(text, _label)``, labels 0 and 1."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = (Counter(), Counter())
            for text, label in zip(batch["text"], batch["_label"], strict=True):
                both[label].update({f for w in set(WORD.findall((text or "").lower())) for f in features(w)})
            names = list(both[0].keys() | both[1].keys())
            yield pd.DataFrame({"feature": names, "clean": [both[0][x] for x in names], "toxic": [both[1][x] for x in names]})

    sums = sample.select("text", "_label").mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = sample.groupBy("_label").count().collect()
    size = {r["_label"]: r["count"] for r in n}
    kinds, docs = ("clean", "toxic"), max(sum(size.values()), 1)
    both = F.col("clean") + F.col("toxic")
    telling = F.lit(0.0)
    for k, kind in enumerate(kinds):
        for seen, of in ((F.col(kind), both), (F.lit(size.get(k, 0)) - F.col(kind), F.lit(docs) - both)):
            expected = of * F.lit(size.get(k, 0) / docs)
            telling = telling + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    best = sums.where(both >= LEAST_DOCUMENTS).where(telling >= LEAST_CERTAINTY).orderBy(F.round(telling, 6).desc(), "feature").limit(FEATURES)
    return [(r["feature"], r["clean"], r["toxic"]) for r in best.collect()]


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and ordered thresholds, by gradient steps on the cumulative logits."""
    n, m = x.shape
    x = np.ascontiguousarray(x, np.float32)
    w, first, gaps = np.zeros(m), 0.0, np.zeros(grades - 2)
    above = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    mean, var = np.zeros(m + grades - 1), np.zeros(m + grades - 1)
    for step in range(1, STEPS + 1):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        wrong = (1 / (1 + np.exp(np.clip(cuts[None, :] - (x @ w.astype(np.float32)).astype(float)[:, None], -50, 50))) - above) / n
        by_cut = -wrong.sum(axis=0)
        later = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([x.T @ wrong.sum(axis=1).astype(np.float32) + PENALTY * w, [later[0]], later[1:] * np.exp(gaps)])
        mean, var = 0.9 * mean + 0.1 * slope, 0.999 * var + 0.001 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - move[:m], first - move[m], gaps - move[m + 1 :]
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the sample; only counts of chosen features, at most SAMPLE_PER_KIND sparse rows a value, come to the driver.

    The texts of the sample are saved once: choosing features, counting kinds and making vectors read only them.
    """
    small_batches(documents.sparkSession)
    values = values_of(labels, label_col)
    if len(values) < 2:
        return Model()
    halves = [v for v, _ in values] == [0, 1]
    picked = sample_labels(labels, id_col, label_col, [v for v, _ in values])
    texts = documents.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))  # at most SAMPLE_PER_KIND ids a value
    one = joined.groupBy("_id", "_level").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(one.select("text", "_level", (F.col("_level") > 0).cast("int").alias("_label")), "toxicity-sample")
    chosen = choose_features(sample)
    names = {f: k for k, (f, _, _) in enumerate(chosen)}
    marks = np.array([t > 4 * c for _, c, t in chosen], bool)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts_of(t, names) for t in batch["text"]]
            yield pd.DataFrame({"level": batch["_level"], "words": [len(t.split()) if t else 0 for t in batch["text"]],
                                "k": [list(c) for c in found], "n": [list(c.values()) for c in found]})

    rows = sample.mapInPandas(vectors, "level int, words long, k array<int>, n array<int>").toPandas()
    discard(sample)
    level = rows["level"].to_numpy(int) if len(rows) else np.zeros(0, int)
    if not names or len(set(level)) < len(values):
        return Model()  # a value has no document
    counts = np.zeros((len(rows), len(names)), np.float32)
    for i, (k, n) in enumerate(zip(rows["k"], rows["n"], strict=True)):
        counts[i, np.asarray(k, int)] = n
    model = Model(names)
    held = model.value(counts)[:, marks].sum(axis=1)
    toxic = level > 0
    grade = np.where(toxic, 1 + (held > np.median(held[toxic])), 0) if halves else level
    order = np.lexsort((held, rows["words"], level))  # the fit's result does not depend on the order of rows, but its last bits do
    model.weights, cuts = fit_ordinal(model.value(counts[order]), grade[order], int(grade.max()) + 1)
    # the sample holds the values in other shares than the labels do
    seen, odds = np.array([n for _, n in values], float), lambda p: np.log(p / (1 - p))
    there = odds(np.cumsum(seen[::-1])[::-1][1:] / seen.sum())
    here = odds(np.array([(level >= k).mean() for k in range(1, len(values))]))
    model.thresholds = np.maximum.accumulate(cuts + (here - there))
    return model


def severity(text: Column, model: Model) -> Column:
    """``struct(p_toxic, expected_severity, severity)`` of each text."""

    @F.pandas_udf("p_toxic double, expected_severity double, severity int")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        none: list[int] = []
        for part in texts:
            sums = np.zeros(len(part))
            for i, text in enumerate(part):
                if not text:
                    continue
                found: dict[int, int] = {}
                for token, n in Counter(text.lower().split()).items():  # words never span blanks
                    ks = known.get(token)
                    if ks is None:
                        ks = [k for word in WORD.findall(token) for f in features(word) if (k := model.names.get(f)) is not None] or none
                        if len(token) <= LONGEST_KEPT:
                            if len(known) >= KEPT_TOKENS:
                                known.clear()
                            known[token] = ks
                    for k in ks:
                        found[k] = found.get(k, 0) + n
                if found:
                    ks = sorted(found)
                    sums[i] = float(np.dot(model.value(np.array([found[k] for k in ks], float)), model.weights[ks]))
            chances = model.chances(sums)
            empty = np.array([not t for t in part], bool)
            chances[empty] = 0
            yield pd.DataFrame({"p_toxic": chances[:, 0], "expected_severity": chances.sum(axis=1), "severity": (chances >= 0.5).sum(axis=1).astype("int32")})

    return score(text)


def grade(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, p_toxic, expected_severity, severity, toxic`` of every document."""
    small_batches(documents.sparkSession)
    scored = documents.select(F.col(f"`{id_col}`").alias(id_col), severity(F.col(f"`{text_col}`").cast("string"), model).alias("_s"))
    return scored.select(id_col, "_s.*", (F.col("_s.severity") >= 1).alias("toxic"))


def drop_toxic(documents: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` of severity 0."""
    small_batches(documents.sparkSession)
    names = [F.col(f"`{c}`") for c in documents.columns]
    return documents.select(*names, severity(F.col(f"`{text_col}`").cast("string"), model).alias("__severity")).where(F.col("__severity.severity") == 0).select(*names)
