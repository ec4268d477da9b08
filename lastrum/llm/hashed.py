"""Rows of hashed text features for the classifiers: a bounded labelled sample for fitting, and scoring of whole tables in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastrum.llm.words import slices

#: Feature ids are below this.
SPACE = 1 << 18
#: Most labelled rows that a classifier is fitted on; the rows with the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Entries of the word caches of a task; a full cache starts anew.
CACHE = 1 << 15

Features = Callable[[str], tuple[np.ndarray, np.ndarray]]


@dataclass
class Rows:
    """Rows of features in flat arrays: row i has ids[offsets[i] : offsets[i + 1]], and values alike unless all are 1."""

    grade: np.ndarray
    ids: np.ndarray
    offsets: np.ndarray
    values: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.grade)

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Feature ids, values, and the place of each one's row among the chosen rows."""
        n = np.diff(self.offsets)[chosen]
        at = np.repeat(self.offsets[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[at], None if self.values is None else self.values[at], np.repeat(np.arange(len(chosen), dtype=np.int32), n)

    def only(self, usable: np.ndarray) -> Rows:
        """The rows with the usable features alone."""
        keep = usable[self.ids]
        offsets = np.concatenate(([0], np.cumsum(keep)))[self.offsets]
        return Rows(self.grade, self.ids[keep], offsets, None if self.values is None else self.values[keep])


def rows_of(each: list[tuple[int, np.ndarray, np.ndarray | None]]) -> Rows:
    """Rows of (grade, ids, values)."""
    joined = lambda k, kind: np.concatenate([np.empty(0, kind), *(r[k] for r in each)]).astype(kind)
    offsets = np.cumsum([0, *(len(r[1]) for r in each)])
    return Rows(np.array([r[0] for r in each], np.int64), joined(1, np.int32), offsets, joined(2, np.float32) if each and each[0][2] is not None else None)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, grade: str, featurise: Callable[[], Features], rows: int = SAMPLE_ROWS, weighed: bool = True) -> Rows:
    """Grades and features of at most rows labelled documents that are not held out, by doc_id; without their values unless
    weighed. Null labels don't count; of several labels of a document the highest does."""
    doc_id = F.col("doc_id").cast("long")
    known = labels.select(doc_id.alias("doc_id"), F.col(grade).cast("int").alias("grade")).where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    names = ["ids", "weights"][: 1 + weighed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = featurise()
        for batch in slices(batches):
            pairs = [of(text or "")[: len(names)] for text in batch.column("text").to_pylist()]
            found = [pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), *found], ["doc_id", "grade", *names])

    texts = docs.select(doc_id.alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "grade", "text").mapInArrow(run, ", ".join(["doc_id long, grade int", *(f"{n} binary" for n in names)])).toArrow()
    # by doc_id and content, whatever the order in which tasks end
    numbers = [np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in found.column(n))]) for n, kind in zip(names, (np.int32, np.float32))]
    lengths = np.array([len(x.as_buffer()) // 4 for x in found.column("ids")], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    sums = np.array([int(numbers[0][a:b].sum(dtype=np.int64)) for a, b in zip(offsets, offsets[1:])], np.int64)
    order = np.lexsort((sums, lengths, found.column("doc_id").to_numpy()))
    out = Rows(found.column("grade").to_numpy().astype(np.int64), numbers[0], offsets, numbers[1] if weighed else None)
    del found
    ids, values, _ = out.take(order)
    return Rows(out.grade[order], ids, np.concatenate(([0], np.cumsum(lengths[order]))).astype(np.int64), values)


def score(docs: DataFrame, featurise: Callable[[], Features], scores: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """(doc_id, raw): scores(ids, values) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = featurise()
        for batch in slices(batches):
            raw = [float(scores(*of(text or ""))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.float64())], ["doc_id", "raw"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, raw double")


def batches(n: int, size: int, epochs: int, seed: int = 7) -> Iterator[np.ndarray]:
    """Row numbers in shuffled minibatches."""
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        rows = order.permutation(n)
        for at in range(0, n, size):
            yield rows[at : at + size]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
