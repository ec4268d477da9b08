"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>), over the distinct terms of a text: its words and their first letters
(inflected and compound insults share a stem). The pair term learns what additive weights miss, such as an insult beside the
mention of a group. It is computed in time linear in the terms.

Which terms carry weight is learnt from two tests on the sample. A term gets a weight and factors if its rate differs between
the classes. A pair of terms gets them too, however neutral each is by itself, if the residuals of the additive fit
show an interaction: the mean residual with both, less those with one of them, plus that with neither. The factors of such pairs
start from the leading eigenvectors of their interactions.

Defined results: null and empty texts get the score of no evidence (the bias alone). Labels are learnt only from rows that
are not held out and have one; without any, the score is 0. Each row is scored by its own text. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.llm.hashed import CACHE, SAMPLE_ROWS, SPACE, Features, Rows, batches, held_out, sample, score, sigmoid

FACTORS = 4
STEMS = (3, 4, 5)
#: Terms in fewer rows of the sample carry no weight by themselves, nor those whose rate differs between the classes by fewer
#: standard errors.
LEAST_ROWS, LEAST_ERRORS = 4, 4.0
#: Pairs are tested among the terms in so many rows of the sample or more (of those the PAIR_TERMS most frequent), and count from
#: so many standard errors: among the 8 million pairs of 4,096 terms, chance makes fewer than one of 6 errors.
PAIR_ROWS, PAIR_TERMS, PAIR_ERRORS = 20, 4096, 6.0
_WORD = re.compile(r"[^\W\d_]+")


def featurise() -> Features:
    cache: dict[str, tuple[int, ...]] = {}

    def ids(word: str) -> tuple[int, ...]:
        found = cache.get(word)
        if found is None:
            if len(cache) >= CACHE:
                cache.clear()
            terms = [b"w" + word.encode("utf-8", "replace"), *(b"s" + word[:n].encode("utf-8", "replace") for n in STEMS if len(word) >= n)]
            found = cache[word] = tuple(zlib.crc32(t) % SPACE for t in terms)
        return found

    def of(text: str) -> tuple[np.ndarray, np.ndarray]:
        found: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            found.update(ids(word))
        return np.sort(np.fromiter(found, np.int32, len(found))), np.ones(len(found), np.float32)

    return of


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray) -> float:
        v = self.factors[ids]
        return float(self.bias + self.weights[ids].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())


def apart(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Which terms have rates that differ between the classes."""
    with_it, toxic = np.zeros(SPACE), np.zeros(SPACE)
    for at in range(0, len(rows), 1024):
        ids, _, row = rows.take(np.arange(at, min(at + 1024, len(rows))))
        with_it += np.bincount(ids, minlength=SPACE)
        toxic += np.bincount(ids, y[at + row], SPACE)
    share, n = with_it / len(y), y.sum()
    difference = toxic / n - (with_it - toxic) / (len(y) - n)
    errors = np.sqrt(share * (1 - share) * (1 / n + 1 / (len(y) - n)))
    return (with_it >= LEAST_ROWS) & (np.abs(difference) >= LEAST_ERRORS * np.maximum(errors, 1e-9))


def interactions(rows: Rows, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, errors) of the pairs of term ids that the residuals show to interact, by how many standard errors."""
    n_with = np.bincount(rows.ids, minlength=SPACE)
    terms = np.flatnonzero((n_with >= PAIR_ROWS) & (n_with <= len(rows) - PAIR_ROWS))
    terms = np.sort(terms[np.argsort(-n_with[terms], kind="stable")[:PAIR_TERMS]])
    column = np.full(SPACE, -1, np.int32)
    column[terms] = np.arange(len(terms))
    n, r = n_with[terms].astype(np.float32), np.zeros(len(terms), np.float32)
    total, spread, found = float(residual.sum()), float(residual.std()) or 1.0, []

    def dense(at: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = np.arange(at, min(at + 512, len(rows)))
        ids, _, row = rows.take(chosen)
        here = column[ids] >= 0
        x = np.zeros((len(chosen), len(terms)), np.float32)
        x[row[here], column[ids[here]]] = 1
        return x, residual[chosen].astype(np.float32)

    for at in range(0, len(rows), 512):
        x, e = dense(at)
        r += e @ x
    for first in range(0, len(terms), 512):
        last = min(first + 512, len(terms))
        both, sums = np.zeros((last - first, len(terms)), np.float32), np.zeros((last - first, len(terms)), np.float32)
        for at in range(0, len(rows), 512):
            x, e = dense(at)
            both += x[:, first:last].T @ x
            sums += (x[:, first:last] * e[:, None]).T @ x
        one, other = n[first:last, None] - both, n[None] - both
        none = len(rows) - n[first:last, None] - n[None] + both
        r1, r2 = r[first:last, None], r[None]
        cells = np.minimum(np.minimum(both, one), np.minimum(other, none))
        with np.errstate(divide="ignore", invalid="ignore"):
            contrast = sums / both - (r1 - sums) / one - (r2 - sums) / other + (total - r1 - r2 + sums) / none
            errors = np.where(cells >= 3, contrast / (spread * np.sqrt(1 / both + 1 / one + 1 / other + 1 / none)), 0)
        i, j = np.nonzero(np.abs(errors) >= PAIR_ERRORS)
        up = j > i + first
        found.append((terms[i[up] + first], terms[j[up]], errors[i[up], j[up]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, int if k < 2 else float) for k in range(3))


def _start(v: np.ndarray, i: np.ndarray, j: np.ndarray, errors: np.ndarray) -> None:
    """Sets the factors of the terms of interacting pairs by the leading eigenvectors of their interactions."""
    terms, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    matrix = np.zeros((len(terms), len(terms)))
    a, b = at[: len(i)], at[len(i) :]
    matrix[a, b] = matrix[b, a] = errors
    values, vectors = np.linalg.eigh(matrix)
    for f in range(min(v.shape[1], len(terms))):
        if values[-1 - f] > 0:
            v[terms, f] += np.sqrt(values[-1 - f] / np.abs(errors).max()) * vectors[:, -1 - f]


def _descend(model: Model, rows: Rows, y: np.ndarray, epochs: int, rate: float, lasso: float, decay: float) -> None:
    """Adagrad on the log loss; factors move only where they aren't all zero."""
    w, v, bias = model.weights, model.factors, model.bias
    factors = v.shape[1] if v.any() else 0
    seen_w, seen_v, seen_b = np.full(SPACE, 1e-4), np.full((SPACE, factors), 1e-2), 1e-2
    for chosen in batches(len(rows), 128, epochs):
        ids, _, row = rows.take(chosen)
        raw = bias + np.bincount(row, w[ids], len(chosen))
        if factors:
            vi = v[ids]
            sums = np.stack([np.bincount(row, vi[:, f], len(chosen)) for f in range(factors)], axis=1)
            raw += 0.5 * ((sums * sums).sum(axis=1) - np.bincount(row, (vi * vi).sum(axis=1), len(chosen)))
        error = (sigmoid(raw) - y[chosen]) / len(chosen)
        touched, at = np.unique(ids, return_inverse=True)
        g = np.bincount(at, error[row], len(touched))
        seen_w[touched] += g * g
        step = rate / np.sqrt(seen_w[touched])
        new = w[touched] - step * g
        w[touched] = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        if factors:
            pull = error[row, None] * (sums[row] - vi)
            for f in range(factors):
                g = np.bincount(at, pull[:, f], len(touched)) + decay * v[touched, f] / len(chosen)
                seen_v[touched, f] += g * g
                v[touched, f] -= 0.5 * rate * g / np.sqrt(seen_v[touched, f])
        g = error.sum()
        seen_b += g * g
        bias -= rate * g / np.sqrt(seen_b)
    model.bias = float(bias)


def fit(rows: Rows, epochs: int = 25, rate: float = 0.1, lasso: float = 2e-3, decay: float = 2e-2, factors: int = FACTORS, seed: int = 11) -> Model:
    """An additive fit, the pairs that its residuals show, then a fit of both from the start. The lasso leaves weights without use at zero."""
    model = Model(0.0, np.zeros(SPACE), np.zeros((SPACE, factors)))
    y = (rows.grade > 0).astype(float)
    if not len(y) or y.min() == y.max():
        model.bias = -35.0 if not len(y) or y[0] == 0 else 35.0
        return model
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    alone = apart(rows, y)
    own = rows.only(alone)
    _descend(model, own, y, epochs, rate, lasso, decay)
    raw = np.concatenate([model.bias + np.bincount(own.take(c)[2], model.weights[own.take(c)[0]], len(c)) for c in np.array_split(np.arange(len(rows)), -(-len(rows) // 1024))])
    i, j, errors = interactions(rows, y - sigmoid(raw))
    new = ~(alone[i] & alone[j])  # two terms with effects of their own have factors anyway
    i, j, errors = i[new], j[new], errors[new]
    model.weights[:] = 0
    model.factors[alone] = np.random.default_rng(seed).normal(0, 0.01, (alone.sum(), factors))
    if len(i):
        _start(model.factors, i, j, errors)
        alone[i] = alone[j] = True
    _descend(model, rows.only(alone), y, epochs, rate, lasso, decay)
    return Model(model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fitted on at most rows labelled documents that are not held out."""
    return fit(sample(docs, labels, "toxic", featurise, rows, weighed=False))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = score(docs, featurise, lambda ids, values: shared.value.raw(ids))
    squashed = 1 / (1 + F.exp(-F.least(F.greatest(F.col("raw"), F.lit(-35.0)), F.lit(35.0))))
    return raw.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), squashed.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
