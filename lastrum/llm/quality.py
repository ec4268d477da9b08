"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w . x): one set of hashed-text weights for all grades, and ordered thresholds. It gives
the expected grade and the probability of a grade of at least some level, by which documents are selected.

A document's features are the shares of its words and of their shapes (runs of letters, digits, other characters), the share
of words that repeat the one before, and how varied the words are; none depends on doc_id, lang, source or labels.

Defined results: a null text is empty and gets the score of no evidence (the thresholds alone). Rows without a usable label
are not learnt from; without any, every document is kept; if every known grade is below the level asked for, none is. Each
row is judged by its own text.
Empty tables give empty results. Extra columns are ignored by judge() and passed on by select().
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.llm.hashed import CACHE, SAMPLE_ROWS, SPACE, Features, Rows, batches, held_out, sample, score, sigmoid
from lastrum.llm.words import slices

_RUNS = re.compile(r"([A-Z]+)|([^\W\d_]+)|(\d+)|(.)\4*", re.S)


def _shape(word: str) -> str:
    return "".join("A" if m[1] else "a" if m[2] else "0" if m[3] else m[4] for m in _RUNS.finditer(word))


def featurise() -> Features:
    cache: dict[str, tuple[int, int]] = {}

    def ids(word: str) -> tuple[int, int]:
        found = cache.get(word)
        if found is None:
            if len(cache) >= CACHE:
                cache.clear()
            found = cache[word] = zlib.crc32(b"w" + word.lower().encode("utf-8", "replace")) % SPACE, zlib.crc32(b"s" + _shape(word).encode("utf-8", "replace")) % SPACE
        return found

    def of(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        shares: dict[int, float] = {}
        counts = Counter(words)
        for word, n in counts.items():
            for i in ids(word):
                shares[i] = shares.get(i, 0) + n
        same = sum(map(eq, words, words[1:]))
        shares[zlib.crc32(b"repeats") % SPACE] = same
        shares[zlib.crc32(b"varied%d" % int(10 * len(counts) / len(words))) % SPACE] = len(words)
        return np.fromiter(shares, np.int32, len(shares)), np.sqrt(np.fromiter(shares.values(), np.float32, len(shares)) / np.float32(len(words)))

    return of


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def at_most(self, raw: float | np.ndarray) -> np.ndarray:
        """P(grade <= each grade but the last)."""
        return sigmoid(self.thresholds - np.asarray(raw)[..., None])


def fit(rows: Rows, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """By Adagrad on the likelihood of the observed grades; thresholds stay ordered, as their gaps are exponentials."""
    grades = sorted({int(g) for g in rows.grade})
    w = np.zeros(SPACE, np.float64)
    if len(grades) < 2:
        return Model(w, np.zeros(0), grades)
    rank = np.searchsorted(grades, rows.grade)
    share = np.clip([(rank <= j).mean() for j in range(len(grades) - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    seen, seen_free = np.full(SPACE, 1e-2), np.full(len(free), 1e-2)
    for chosen in batches(len(rows), 128, epochs):
        ids, values, row = rows.take(chosen)
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        s = np.bincount(row, w[ids] * values, len(chosen))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        r = rank[chosen]
        low, high = sigmoid(edges[r] - s), sigmoid(edges[r + 1] - s)
        p = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low) / p * (r > 0), high * (1 - high) / p * (r < len(theta))
        g = np.bincount(ids, ((d_high - d_low) / len(chosen))[row] * values, SPACE)
        touched = np.unique(ids)
        g = g[touched] + decay * w[touched]
        seen[touched] += g * g
        w[touched] -= rate * g / np.sqrt(seen[touched])
        d_theta = (np.bincount(r[r > 0] - 1, d_low[r > 0], len(theta)) - np.bincount(r[r < len(theta)], d_high[r < len(theta)], len(theta))) / len(chosen)
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        seen_free += g * g
        free -= rate * g / np.sqrt(seen_free)
    return Model(w.astype(np.float32), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), grades)


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fitted on at most rows labelled documents that are not held out."""
    return fit(sample(docs, labels, grade, featurise, rows))


def _raw(shared):
    return lambda ids, values: float(shared.value.weights[ids] @ values)


def tail_threshold(model: Model, at_least: int) -> float:
    """The threshold above which the raw score makes a grade of at_least or more the likelier: minus infinity where no known
    grade is below it (or none is known), infinity where all are."""
    if model.grades and model.grades[-1] < at_least:
        return float("inf")
    below = [j for j, g in enumerate(model.grades[:-1]) if g < at_least]
    return float(model.thresholds[below[-1]]) if below else float("-inf")


def judge(docs: DataFrame, model: Model, at_least: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, tail (probability of a grade of at_least or more), kept (tail >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = score(docs, featurise, _raw(shared))
    expected = F.lit(float(model.grades[-1] if model.grades else at_least))
    for j, t in enumerate(model.thresholds):
        expected = expected - float(model.grades[j + 1] - model.grades[j]) / (1 + F.exp(F.col("raw") - float(t)))
    edge = tail_threshold(model, at_least)
    tail = F.lit(float(edge < 0)) if np.isinf(edge) else 1 / (1 + F.exp(F.lit(edge) - F.col("raw")))
    return raw.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), expected.alias("expected_grade"), tail.alias("tail"), (F.col("raw") >= F.lit(edge)).alias("kept"))


def select(docs: DataFrame, model: Model, at_least: int = 1) -> DataFrame:
    """docs without the documents whose grade is more likely below at_least, as judge() has it; columns as they came, nothing is shuffled."""
    shared, edge = docs.sparkSession.sparkContext.broadcast(model), tail_threshold(model, at_least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, raw = featurise(), _raw(shared)
        for batch in slices(batches):
            yield batch.filter(pa.array([raw(*of(text or "")) >= edge for text in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
