"""Substring search by an index of trigrams: a pattern is looked up by its rarest trigrams, and only the texts that have them are read.

Texts are compared in lower case. The index holds, for each segment of at most SEGMENT texts and each trigram, the keys of
the texts that have it, in files that are sorted by trigram, so that a search reads the parts that hold its trigrams. Two signs
past the end of each text let patterns of one or two characters be found as beginnings of trigrams.

Keys are unique whole numbers; rows without a key or a text are not found. An empty pattern is in every text that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.operators.tables import save, small, spread

#: Texts of a segment.
SEGMENT = 4096
#: Trigrams by which a pattern is looked up.
RAREST = 3
#: Bits of a character in the number of a trigram.
_BITS = 21
_LISTS = "gram long, keys array<long>"


@dataclass
class Index:
    """lists(gram, keys) and texts(key, text), both saved."""

    lists: DataFrame
    texts: DataFrame


def trigrams(text: str, padding: str = "\0\0") -> np.ndarray:
    """The distinct trigrams of a text, as ascending numbers."""
    c = np.frombuffer((text + padding).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:]) if len(c) > 2 else np.empty(0, np.int64)


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: list[np.ndarray] = []
    keys: list[int] = []

    def ended() -> pa.RecordBatch:
        flat, of = np.concatenate(grams), np.repeat(np.array(keys, np.int64), [len(g) for g in grams])
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        first = np.flatnonzero(np.diff(flat, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(of))
        return pa.RecordBatch.from_arrays([pa.array(flat[first]), lists], ["gram", "keys"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few texts as Python objects at once
            few = batch.slice(at, 256)
            grams += map(trigrams, few.column(1).to_pylist())
            keys += few.column(0).to_pylist()
            if len(keys) >= SEGMENT:
                yield ended()
                grams, keys = [], []
    if keys:
        yield ended()


def build(docs: DataFrame, key: str, text: str) -> Index:
    rows = docs.select(F.col(key).cast("long").alias("key"), F.lower(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    lists = spread(rows).mapInArrow(_segments, _LISTS)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = lambda df, c: df.repartitionByRange(parts, c).sortWithinPartitions(c)
    return Index(save(by(lists, "gram"), "grams"), save(by(rows, "key"), "texts"))


def _pattern_grams(patterns: DataFrame) -> DataFrame:
    """(pattern, gram, begins): the trigrams of patterns(pattern, ..., wanted); for a shorter one its number and length."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) > 2:
                    rows += [(number, int(g), 3) for g in trigrams(text, "")]
                elif text:
                    rows.append((number, sum(ord(c) << _BITS * (len(text) - 1 - k) for k, c in enumerate(text)), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["pattern", "gram", "begins"])

    return patterns.select("pattern", "wanted").mapInArrow(each, "pattern long, gram long, begins int")


def candidates(index: Index, patterns: DataFrame) -> DataFrame:
    """(pattern, key) of the texts that have the rarest trigrams of patterns(pattern, wanted), which is in lower case and not empty.

    Shorter patterns are exact here; for others the text is still to be looked at."""
    asked = save(_pattern_grams(patterns), "pattern_grams")
    long_ = asked.where("begins = 3").select("pattern", "gram")
    read = index.lists.join(small(long_.select("gram").distinct()), "gram", "left_semi")
    counts = read.groupBy("gram").agg(F.sum(F.size("keys")).alias("n"))
    place = Window.partitionBy("pattern").orderBy("n", "gram")  # the trigrams of one pattern
    rare = long_.join(counts, "gram", "left").na.fill(0, ["n"]).withColumn("place", F.row_number().over(place)).where(F.col("place") <= RAREST)
    rare = save(rare.withColumn("m", F.count("*").over(Window.partitionBy("pattern"))), "rarest")
    met = read.join(small(rare.select("gram", "pattern", "m")), "gram").select("pattern", "m", F.explode("keys").alias("key"))
    found = met.groupBy("pattern", "key", "m").agg(F.count("*").alias("hits")).where("hits = m").select("pattern", "key")
    for n in (1, 2):
        short = asked.where(F.col("begins") == n).select("pattern", F.col("gram").alias("begin"))
        begun = index.lists.withColumn("begin", F.shiftright("gram", _BITS * (3 - n))).join(small(short), "begin")
        found = found.unionByName(begun.select("pattern", F.explode("keys").alias("key")).distinct())
    return found


def search(index: Index, patterns: DataFrame, pattern: Column | str, wanted: Column | str) -> DataFrame:
    """(pattern, key) of all texts that contain wanted, whatever the case. pattern numbers the rows of patterns; null wants nothing."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    asked = save(patterns.select(col(pattern).cast("long").alias("pattern"), F.lower(col(wanted)).alias("wanted")).where("wanted IS NOT NULL"), "patterns")
    some = save(candidates(index, asked.where("wanted <> ''")), "candidates")
    texts = index.texts.join(small(some.select("key").distinct()), "key", "left_semi")  # reads the pages of candidates only, where Spark can tell
    found = some.join(asked, "pattern").join(texts, "key").where(F.col("text").contains(F.col("wanted"))).select("pattern", "key")
    return found.unionByName(asked.where("wanted = ''").select("pattern").crossJoin(index.texts.select("key"))) if asked.where("wanted = ''").limit(1).count() else found
