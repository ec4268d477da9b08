"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that holds an item with at most k edits shares at least m - q + 1 - k q of its q-grams, on diagonals
(position in the text less position in the item) that span at most k. So shared q-grams are counted in overlapping bands of
2 k + 1 diagonals, bands that reach the bound are kept, and a banded alignment verifies them. The lemma loses nothing: each
passage within the edit budget is found, in whole texts of any length. Shared q-grams are counted in slices of SLICE hits, so
that one that recurs in both takes time but no memory. Of the places of an item that overlap, the one with the fewest edits
counts; each other place is a hit of its own (one for each band, where an item is periodic and its places touch).

Text and items are compared with A-Z lower-cased and each run of white space as one space. The items go to the tasks in blocks
of bounded size, a pass over the documents for each block; only one block is held at a time, and what a pass gives is written.

Items shorter than MIN_CHARS characters are found where a text holds them exactly, between word boundaries: by the hashes of
the windows of their lengths, which are then compared; each of their places is a hit.

Defined results: null and empty texts hold nothing. Null items and items without a character that isn't white space are not
searched. Repeated rows and items each give their own hits. Without items or documents there are no hits.
Extra columns are ignored by find() and passed on by clean().
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.llm.shared import drop, save, small, unused
from lastrum.llm.words import _power, mixed, slices

Q = 8
#: Edits per character that a leaked passage may have.
ERROR = 0.08
MIN_CHARS = 40
#: Characters of the items that one block broadcasts (of a longer item alone, its length). The index takes 16 bytes for each, its bit
#: filter 4 to 8 and the items 4: at most 56 MB in a worker.
BLOCK_CHARS = 2_000_000
#: Shared q-grams that are counted at once: 16 bytes each, and as much again to sort them.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text as it is compared, and where each stood."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    keep = ~white
    keep[1:] |= ~white[:-1]
    if len(keep):
        keep[0] = not white[0]
    at = np.flatnonzero(keep)
    points = np.where(white, 32, np.where((points >= 65) & (points <= 90), points | 32, points))[at]
    return (points[:-1], at[:-1]) if len(points) and points[-1] == 32 else (points, at)


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(points)
    if n < q:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    return mixed((sums[q:] - sums[:-q]) * _power(_INVERSE, n)[: n - q + 1])


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits between the item and a part of the text, in the band of diagonals low to high, and the part's end."""
    width = high - low + 1
    far = len(item) + len(text) + width
    at = low + np.arange(width)
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    steps = np.arange(width)
    for r, c in enumerate(item, 1):
        j = at + r - 1
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == c)
        new = np.where(inside | (j < 0), row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        end = at + r
        new = np.where((end >= 0) & (end <= len(text)), new, far)
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where((end >= 0) & (end <= len(text)), row, far)
    best = int(row.argmin())
    return int(row[best]), int(at[best]) + len(item)


def _exactly(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """(0, end) of the first place at which the text has the item itself on the diagonals low to high, if there is one."""
    first = max(0, low)
    part, whole = text[first : max(0, high + len(item))].tobytes(), item.tobytes()
    at = part.find(whole)
    while at % item.itemsize and at >= 0:
        at = part.find(whole, at + 1)
    return (0, first + at // item.itemsize + len(item)) if at >= 0 else None


def _start(item: np.ndarray, text: np.ndarray, end: int, k: int) -> int:
    """Where a place of the item with at most k edits begins that ends there: the reversed item, from its end."""
    back = text[max(0, end - len(item) - k) : end][::-1]
    steps = np.arange(len(back) + 1)
    costs = steps
    for c in item[::-1]:
        new = np.concatenate(([costs[0] + 1], np.minimum(costs[1:] + 1, costs[:-1] + (back != c))))
        costs = np.minimum.accumulate(new - steps) + steps
    return end - int(costs.argmin())


class Short:
    """Items that are found as they are, by length: their hashes in order, and the items."""

    def __init__(self, ids: list[int], items: list[np.ndarray]) -> None:
        self.ids, self.items = ids, items
        self.tables = {}
        lengths = np.array([len(x) for x in items], np.int64)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            hashes = np.concatenate([grams(items[i], int(n)) for i in own])
            order = np.argsort(hashes, kind="stable")
            self.tables[int(n)] = hashes[order], own[order]

    def hits(self, points: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, 0) of each place of an item, from left to right without overlaps."""
        if not self.tables or not len(points):
            return []
        kinds, at = np.unique(points, return_inverse=True)
        word = np.array([chr(c).isalnum() for c in kinds])[at]
        edge = np.ones(len(points) + 1, bool)
        edge[1:-1] = ~(word[1:] & word[:-1])
        found: list[tuple[int, int, int, int]] = []
        for n, (hashes, items) in self.tables.items():
            if n > len(points):
                continue
            starts = np.flatnonzero(edge[:-n] & edge[n:])
            windows = grams(points, n)[starts]
            first, last = np.searchsorted(hashes, windows, "left"), np.searchsorted(hashes, windows, "right")
            until: dict[int, int] = {}
            for k in np.flatnonzero(last > first):
                start = int(starts[k])
                for i in items[first[k] : last[k]]:
                    if start >= until.get(i, 0) and np.array_equal(self.items[i], points[start : start + n]):
                        until[i] = start + n
                        found.append((self.ids[i], int(where[start]), int(where[start + n - 1]) + 1, 0))
        return found


@dataclass
class Index:
    """The q-grams of a block of items: hash, item and position sorted by hash, and a filter of bits that rules most hashes out."""

    ids: list[int]
    items: list[np.ndarray]
    q: int
    error: float
    min_chars: int = MIN_CHARS

    def __post_init__(self) -> None:
        few = [len(x) < max(self.min_chars, self.q) for x in self.items]
        self.short = Short([i for i, s in zip(self.ids, few, strict=True) if s], [x for x, s in zip(self.items, few, strict=True) if s])
        self.ids, self.items = [i for i, s in zip(self.ids, few, strict=True) if not s], [x for x, s in zip(self.items, few, strict=True) if not s]
        each = [grams(x, self.q) for x in self.items]
        hashes = np.concatenate(each) if each else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(each), dtype=np.int32), np.array([len(x) for x in each], np.int64))[order]
        self.pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in each])[order] if each else np.empty(0, np.int32)
        lengths = np.array([len(x) for x in self.items], np.int64)
        self.budget = np.minimum((lengths * self.error).astype(np.int64), (lengths - self.q) // self.q)
        self.needed = lengths - self.q + 1 - self.budget * self.q
        self.shift = np.uint64(64 - max(16, int(np.ceil(np.log2(max(1, len(hashes)) * 32)))))
        bits = np.zeros(1 << (64 - int(self.shift)), bool)
        bits[(hashes >> self.shift).astype(np.int64)] = True
        self.bits = np.packbits(bits)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that the filter lets through."""
        at = (hashes >> self.shift).astype(np.int64)
        return np.flatnonzero((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)

    def bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the bands with enough shared q-grams."""
        if not len(self.hashes):
            return []
        hashes = grams(points, self.q)
        at = self.maybe(hashes)
        if not len(at):
            return []
        first, last = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        n = last - first
        total = int(n.sum())
        base = len(points) + 2
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(n)
        for low in range(0, total, SLICE):  # hits low to high, wherever that cuts the hits of one place
            high = min(low + SLICE, total)
            i, j = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right") + 1
            part = n[i:j].copy()
            part[0] = min(int(ends[i]), high) - low
            skipped = low - int(ends[i] - n[i])
            if j - 1 > i:
                part[-1] = high - int(ends[j - 2])
            entry = np.arange(high - low) - np.repeat(np.cumsum(part) - part, part) + np.repeat(first[i:j], part)
            entry[: part[0]] += skipped
            item, pos = self.item[entry].astype(np.int64), self.pos[entry]
            # a hit counts in its own band and in the one before it, which reaches over it
            key = item * (4 * base) + (np.repeat(at[i:j], part) - pos) // (self.budget[item] + 1) + 2 * base
            own, often = np.unique(key, return_counts=True)
            together, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
            keys, counts = together, np.bincount(place, np.concatenate([counts, often]), len(together)).astype(np.int64)
        both, place = np.unique(np.concatenate([keys, keys - 1]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, counts]), len(both))
        item, band = both // (4 * base), both % (4 * base) - 2 * base
        full = counts >= self.needed[item]
        return [(int(i), int(b * (self.budget[i] + 1)), int((b + 2) * (self.budget[i] + 1) - 1)) for i, b in zip(item[full], band[full], strict=True)]

    def hits(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of each place of an item; code points of the text, end exclusive. If first, of one place."""
        points, where = normal(text)
        if first and (found := self.short.hits(points, where)):
            return found
        places: dict[int, list[tuple[int, int, int]]] = {}
        exact: dict[int, tuple[int, int]] = {}
        for i, low, high in self.bands(points):
            item, k = self.items[i], int(self.budget[i])
            if i in exact and low - k <= exact[i][0] <= high + k or i in exact and exact[i][0] <= low - k and high + k < exact[i][1]:
                continue  # wherever a place began here, it would overlap the exact one
            edits, end = _exactly(item, points, low - k, high + k) or aligned(item, points, low - k, high + k)
            if edits <= k:
                places.setdefault(i, []).append((edits, _start(item, points, end, k) if edits else end - len(item), end))
                if edits == 0:
                    exact[i] = places[i][-1][1:]
                if first:
                    break
        found = []
        for i, each in places.items():
            taken: list[tuple[int, int]] = []  # disjoint, in order
            for edits, start, end in sorted(set(each)):
                at = bisect_left(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end))
                    found.append((self.ids[i], int(where[start]), int(where[end - 1]) + 1, edits))
        return sorted([*found, *([] if first else self.short.hits(points, where))])


def _searched(items: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """The items that are searched, and the number of blocks that they take."""
    used = items.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return used, -(-(used.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)


def blocks(items: DataFrame, q: int = Q, error: float = ERROR, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the items(item_id, text), each of bounded size; the driver holds one at a time."""
    used, n = _searched(items, block_chars)
    for block in range(n):
        rows = [(r["item_id"], normal(r["text"])[0]) for r in used.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).sort("item_id", "text").collect()]
        rows = [r for r in rows if len(r[1])]
        if rows:
            yield Index([r[0] for r in rows], [r[1] for r in rows], q, error, min_chars)


def _passes(docs: DataFrame, items: DataFrame, step, options: tuple) -> Iterator[DataFrame]:
    """step(broadcast index) for each block; but for the last, what it gives is written and the block freed."""
    held = out = None
    for index in blocks(items, *options):
        if held:
            out = save(out, "passed")
            held.unpersist()
            yield out
        held = docs.sparkSession.sparkContext.broadcast(index)
        out = step(held)
    if held:
        yield out


def find(docs: DataFrame, items: DataFrame, q: int = Q, error: float = ERROR, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for each place of a benchmark item in a document."""
    schema = "doc_id long, item_id long, start long, end long, edits long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def step(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = [(d, *hit) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for hit in shared.value.hits(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

        return texts.mapInArrow(run, schema)

    out = None
    for found in _passes(docs, items, step, (q, error, min_chars, block_chars)):
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, q: int = Q, error: float = ERROR, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the documents that hold a benchmark item; each row is judged by its own text.

    Items of one block filter the documents where they are read, and nothing is shuffled. With more blocks, each pass writes the
    hashes of the texts that hold an item of its block, and one anti-join with all of them leaves the rest: documents are never copied."""
    options = (q, error, min_chars, block_chars)
    if _searched(items, block_chars)[1] < 2:

        def keep(shared) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches):
                    yield batch.filter(pa.array([not (text and shared.value.hits(text, first=True)) for text in batch.column("text").to_pylist()], pa.bool_()))

            return docs.mapInArrow(run, docs.schema)

        return next(_passes(docs, items, keep, options), docs)

    texts = docs.where(F.length("text") > 0).select(F.sha2("text", 256).alias("hash"), "text")

    def hit(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = pa.array([bool(shared.value.hits(text, first=True)) for text in batch.column("text").to_pylist()], pa.bool_())
                yield batch.select(["hash"]).filter(found)

        return texts.mapInArrow(run, "hash string").distinct()

    passes = list(_passes(docs, items, hit, options))
    if not passes:
        return docs
    own = unused(docs, "text_hash")
    every = save(reduce(DataFrame.unionAll, passes).distinct().withColumnRenamed("hash", own), "hits")
    drop(*passes[:-1])
    return docs.withColumn(own, F.sha2("text", 256)).join(small(every), own, "left_anti").drop(own)
