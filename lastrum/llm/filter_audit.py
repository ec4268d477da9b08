"""Interaction audit of five filters: what each removes, alone and after the others, in every order of application.

A document's failures are five bits: A too few words, B too few distinct words, C too many capitals, D a forbidden sign, E a copy
of a text with a smaller doc_id. The first four come from the text. For the fifth, rows whose fingerprint (xxhash64) occurs more
than once are routed by it to owner tasks. A task first chains its own rows: of equal texts only the smallest id travels with the
text, larger ids are known to be copies at once. Owners keep chains of full texts under each fingerprint, with the smallest id,
and emit the others. Counts by the 32 masks are one vector for each part, merged by combineByKey; all orders and steps follow
from the vector.

A text moves at most once for each task that holds it, and only if its fingerprint may repeat: repeated fingerprints set bits
in a filter of bounded size that is broadcast; where it errs, a text travels in vain and stays unmarked.

Defined results: a null text counts as empty, a null lang as the empty string. A null doc_id is neither smaller nor larger than
another: such rows are never copies and make none. Rows that repeat both doc_id and text don't make each other copies. A document
has a label if any row of labels says so. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastrum.llm.shared import save
from lastrum.llm.words import slices

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
#: A piece of a text that ends with a word: words are counted piece by piece.
_PIECE = re.compile(rb"(?s).{1,1048576}[^\x20\x09-\x0D]*")
#: Most words of 64 bits in the filter of repeated fingerprints, as a power of two; beyond, it lets more texts pass in vain.
FILTER_POWER = 20
#: Bytes of text that a task chains before it sends them on, and that an owner task is meant to hold.
HELD = 1 << 25
#: Bytes of a link of a chain besides its text.
LINK = 400
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes) -> int:
    """The bits of A to D."""
    n, distinct = 0, set()
    for piece in _PIECE.finditer(text):
        words = piece[0].split()  # of bytes: at 20 and 09 to 0D only
        n += len(words)
        distinct.update(words)
    chars = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    signs = len(text) - len(text.translate(None, SIGNS))
    return (n < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * chars) << 2 | (signs > 0) << 3


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.cast("binary").alias("text"))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, fp, size) of each document: the bits of A to D, the fingerprint and the length in bytes."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            masks, sizes = pa.array([failures(x) for x in texts], pa.int32()), pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, batch.column("fp"), sizes], ["doc_id", "part", "mask", "fp", "size"])

    return _rows(docs).mapInArrow(each, "doc_id long, part string, mask int, fp long, size long")


def _bit(shift: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(63)).cast("int"))


def _candidates(docs: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """Rows whose fingerprint is among the n of repeated, and few others."""
    power = min(FILTER_POWER, max(6, (n // 4).bit_length()))
    cell, bits = F.shiftrightunsigned("fp", 64 - power), _bit(0).bitwiseOR(_bit(6)).bitwiseOR(_bit(12))
    cells = repeated.groupBy(cell.alias("cell")).agg(F.bit_or(bits).alias("bits"))  # at most 2 ** FILTER_POWER rows of two numbers
    return _rows(docs).where("doc_id IS NOT NULL").withColumn("cell", cell).join(F.broadcast(cells), "cell").where(F.col("bits").bitwiseAND(bits) == bits).select("doc_id", "part", "fp", "text")


class Chains:
    """Of each fingerprint, the texts that have it, each with its smallest doc_id and the rows of that by part."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.held = 0

    def meet(self, fp: int, text: bytes, doc_id: int, parts: dict[str, int]) -> tuple[int, int, dict[str, int]] | None:
        """Takes rows of a text up; returns (mask, doc_id, parts) of those that prove to be copies, theirs or the earlier ones'."""
        chain = self.of.setdefault(fp, [])
        for link in chain:
            if link[0] == text:
                if doc_id == link[1]:
                    for part, n in parts.items():
                        link[2][part] = link[2].get(part, 0) + n
                    return None
                if doc_id > link[1]:
                    return link[3], doc_id, parts
                gone = link[3], link[1], link[2]
                link[1:3] = doc_id, parts
                return gone
        chain.append([text, doc_id, parts, failures(text)])
        self.held += len(text) + LINK
        return None


def _local(rows: Iterable) -> Iterator[tuple]:
    """Of the rows of a task: (fingerprint, text, smallest id and its rows), and copies under a key that spreads them."""
    chains = Chains()

    def sent() -> Iterator[tuple]:
        for fp, chain in chains.of.items():
            for text, doc_id, parts, _ in chain:
                yield fp, (text, doc_id, parts)

    for doc_id, part, fp, text in rows:
        if gone := chains.meet(fp, bytes(text), doc_id, {part: 1}):
            yield gone[1], (None, *gone)
        if chains.held > HELD:
            yield from sent()
            chains = Chains()
    yield from sent()


def _owner(records: Iterable[tuple]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of the copies."""
    chains = Chains()
    for fp, (text, *rest) in records:
        if gone := rest if text is None else chains.meet(fp, text, *rest):
            mask, doc_id, parts = gone
            for part, n in parts.items():
                yield doc_id, part, mask, n


def _place(key: int) -> int:
    return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 24


def copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the n rows of a doc_id in a part whose text a smaller doc_id has. rows: features(docs), saved."""
    spark = docs.sparkSession
    repeated = save(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n"), (F.max("size") + LINK).alias("size")).where("n > 1").select("fp", "size"), "repeated")
    total = repeated.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["bytes"] // HELD + 1)
    routed = _candidates(docs, repeated, total["n"]).rdd.mapPartitions(_local).partitionBy(owners, _place).mapPartitions(_owner)
    return save(spark.createDataFrame(routed, "doc_id long, part string, mask int, n long"), "copies")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(doc_id, part, mask, n) with good and toxic, 0 or 1."""
    said = [F.coalesce(F.max((labels[c] == 1).cast("long")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))]
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(*said).where("good + toxic > 0")
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    none = F.lit(None).cast("long")
    return known.unionByName(rows.where("doc_id IS NULL").withColumns({"good": none, "toxic": none})).na.fill(0, ["good", "toxic"])


def _vector(row: tuple) -> list[int]:
    return _add([0] * (3 << len(FILTERS)), row)


def _add(counts: list[int], row: tuple) -> list[int]:
    mask, n, good, toxic = row
    for k, some in enumerate((n, n * good, n * toxic)):
        counts[(k << len(FILTERS)) + mask] += some
    return counts


def _merge(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """The rows of a part, from its counts of all, of good and of toxic documents by mask."""
    n = len(FILTERS)
    counts, masks = np.array(vector, np.int64).reshape(3, 1 << n), np.arange(1 << n)
    fails = [(masks >> f) & 1 == 1 for f in range(n)]
    passes = [masks & before == 0 for before in range(1 << n)]
    removed = [[counts[:, fails[f] & passes[before]].sum(axis=1) for f in range(n)] for before in range(1 << n)]
    kept = [int(counts[0, p].sum()) for p in passes]
    failed, alone = [int(counts[0, x].sum()) for x in fails], [int(counts[0, 1 << f]) for f in range(n)]
    every = [[(f, sum(1 << x for x in order[:k])) for k, f in enumerate(order)] for order in permutations(range(n))]
    shapley = [0] * n
    for order in every:
        for f, before in order:
            shapley[f] += int(removed[before][f][0])
    for order in every:
        name = "".join(FILTERS[f] for f, _ in order)
        for step, (f, before) in enumerate(order, 1):
            here, good, toxic = map(int, removed[before][f])
            yield part, name, step, kept[before | 1 << f], here, failed[f] - here, alone[f], good, toxic, shapley[f]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    spark = docs.sparkSession
    rows = save(features(docs), "features")
    found = copies(docs, rows)
    # a copy moves from the mask without the bit to the one with it
    moved = found.select("doc_id", "part", "mask", (-F.col("n")).alias("n")).unionByName(found.select("doc_id", "part", F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), "n"))
    counted = _labelled(rows.select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n")).unionByName(moved), labels).select("part", "mask", "n", "good", "toxic")
    vectors = counted.rdd.map(lambda row: (row[0], row[1:])).combineByKey(_vector, _add, _merge, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.createDataFrame(vectors.flatMap(lambda x: orders(*x)), AUDIT)
