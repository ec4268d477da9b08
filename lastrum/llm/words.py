"""Vectorised hashing of the words and shingles of many texts at once, for the tasks of the operators that run numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; one longer text makes a chunk of its own.
CHUNK = 1 << 18
#: Rows of a batch that are held as Python objects at once.
ROWS = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 65536), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit changes half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lowered(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    return np.where((b >= 65) & (b <= 90), b | 32, b)


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-cased bytes: the start of each run without white space, and a hash of the run."""
    if len(b) == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(b))[starts] + (ends - starts).astype(np.uint64))


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows: Spark's batches hold 10,000 texts, too many to hold twice in each worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, each with about size bytes of text; null texts are empty."""
    for batch in slices(batches):
        texts = [x or b"" for x in batch.column(column).to_pylist()]
        at = total = 0
        for i, text in enumerate(texts):
            if i > at and total + len(text) > size:
                yield batch.slice(at, i - at), texts[at:i]
                at, total = i, 0
            total += len(text)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of width words, text after text, and the offsets of the texts (one more than texts).

    A text with fewer words is one shingle as a whole; one without words has none.
    """
    joined = b" ".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, words = word_hashes(lowered(joined))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = np.diff(bounds)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(runs) else 0):
        runs += words[k : len(words) - width + 1 + k] * np.uint64(2 * k + 0xD6E8FEB86659FD93)
    runs = mixed(runs)
    found = []
    for i in range(len(texts)):
        if n[i] >= width:
            found.append(np.unique(runs[bounds[i] : bounds[i + 1] - width + 1]))
        elif n[i]:
            few = words[bounds[i] : bounds[i + 1]] * (np.arange(n[i], dtype=np.uint64) * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
            found.append(mixed(np.array([few.sum(dtype=np.uint64) + np.uint64(n[i])])))
        else:
            found.append(np.empty(0, np.uint64))
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
