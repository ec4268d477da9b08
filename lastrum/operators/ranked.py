"""The best documents of many queries by cosine, from an index of inverted lists in blocks.

Documents lie in segments of bounded size. In a segment they are numbered by their highest weight, so that a list's blocks of
BLOCK neighbouring numbers hold weights of like size, and each block keeps its highest one. A query's bound for a block is the
sum of its weights times those highest ones; no document of the block scores more. Two rounds search all segments:
the first scores the few blocks with the highest bounds, and the k-th best score over all segments is what a document must reach;
the second scores the blocks whose bound reaches it and leaves all others closed. Results are those of scoring every pair.

A segment is one group of a shuffle and holds SEGMENT documents at most, whatever the corpus holds. Queries are sent to all tasks in
batches of bounded size. Lists of terms that no query has are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lastrum.functions.text import tokens
from lastrum.operators.tables import save, small, spread

#: Documents of a segment and of a block.
SEGMENT, BLOCK = 4096, 4
#: Blocks of each segment that the first round scores for each query and wanted document.
FIRST = 2
#: Weights of queries that are sent to the tasks at once.
BATCH = 500_000
#: Most parts that segments are dealt to; beyond, a part has several.
MOST_PARTS = 20_000
#: Scores are rounded to so many decimals; bounds may be short by less than SLACK.
DIGITS, SLACK = 6, 2e-6
_LISTS = "segment long, term string, slots array<int>, tfs array<int>, keys array<long>"
_INDEX = "segment long, term string, slots array<int>, weights array<double>, blocks array<int>, tops array<double>, keys array<long>"


def _grouped(which: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.ListArray]:
    """Each column as n lists: the values whose which is 0, 1 and so on, in the order given."""
    order = np.argsort(which, kind="stable")
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(which, minlength=n)))), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]


def _rows(segment: int, terms: pa.Array, lists: list[pa.ListArray], keys: list[int], schema: str) -> pa.RecordBatch:
    """The lists of a segment, and a row without a term that holds its keys."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [pa.array([segment] * (len(terms) + 1), pa.int64()), terms, *lists]
    columns[1:] = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns[1:]]
    columns.append(pa.concat_arrays([pa.nulls(len(terms), pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64()))]))
    return pa.RecordBatch.from_arrays(columns, names)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of the documents of a task, segment by segment."""
    part, number = TaskContext.get().partitionId(), 0
    terms: dict[str, int] = {}
    which, slots, tfs, keys = array("i"), array("i"), array("i"), []

    def ended() -> pa.RecordBatch:
        flat = [np.frombuffer(x, np.int32) for x in (slots, tfs)]
        return _rows(part << 32 | number, pa.array(terms, pa.string()), _grouped(np.frombuffer(which, np.int32), len(terms), *flat), keys, _LISTS)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            few = batch.slice(at, 256)
            for key, words in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                counts = Counter(words)
                which.extend(terms.setdefault(t, len(terms)) for t in counts)
                tfs.extend(counts.values())
                slots.extend([len(keys)] * len(counts))
                keys.append(key)
                if len(keys) == SEGMENT:
                    yield ended()
                    terms, which, slots, tfs, keys, number = {}, array("i"), array("i"), array("i"), [], number + 1
    if keys:
        yield ended()


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and how many each has."""
    whole = lists.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _finished(rows: pa.Table) -> pa.Table:
    """The index rows of a segment from its lists with idf: weights of unit vectors, documents numbered anew by their highest weight."""
    keys = np.array(rows.filter(rows["term"].is_null())["keys"][0].as_py(), np.int64)
    lists = rows.filter(rows["term"].is_valid())
    (slots, n), (tfs, _) = _flat(lists["slots"]), _flat(lists["tfs"])
    w = tfs * np.repeat(lists["idf"].to_numpy(), n)
    w = w / np.sqrt(np.bincount(slots, w * w, len(keys)))[slots]
    highest = np.zeros(len(keys))
    np.maximum.at(highest, slots, w)
    order = np.argsort(-highest, kind="stable")
    number = np.empty(len(keys), np.int32)
    number[order] = np.arange(len(keys), dtype=np.int32)
    wanted = np.repeat(lists["wanted"].to_numpy(zero_copy_only=False), n)
    which = np.repeat(np.cumsum(lists["wanted"].to_numpy(zero_copy_only=False)) - 1, n)[wanted]
    slots, w = number[slots][wanted], w[wanted]
    by = np.lexsort((slots, which))
    slots, w, which = slots[by], w[by], which[by]
    blocks = slots // BLOCK
    first = np.flatnonzero(np.diff(blocks, prepend=-1) | np.diff(which, prepend=-1))
    tops = np.maximum.reduceat(w, first) if len(first) else w
    terms = lists.filter(lists["wanted"])["term"].combine_chunks()
    found = [*_grouped(which, len(terms), slots, w), *_grouped(which[first], len(terms), blocks[first], tops)]
    return pa.Table.from_batches([_rows(rows["segment"][0].as_py(), terms, found, keys[order].tolist(), _INDEX)])


def term_lists(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(segment, term, slots, tfs, keys): how often the documents of each segment hold a term. key: a unique whole number; rows without
    one are left out."""
    found = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), tokens(text).alias("words"))
    return save(spread(found).mapInArrow(_counted, _LISTS), "term_lists")


def idf(lists: DataFrame) -> DataFrame:
    """(term, idf), saved: ln(N / (1 + df)) + 1."""
    n = lists.agg(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    df = lists.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("slots")).alias("df"))
    return save(df.select("term", (F.log(F.lit(float(n)) / (1 + F.col("df"))) + 1).alias("idf")), "idf")


def weighted(lists: DataFrame, idfs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(segment, term, slots, tfs, keys, idf, wanted): whether a term is in only(term), or each is."""
    marked = idfs.withColumn("wanted", F.lit(True))
    if only is not None:
        marked = idfs.join(only.select("term", F.lit(True).alias("wanted")), "term", "left").na.fill(False, ["wanted"])
    return lists.where("term IS NOT NULL").join(small(marked), "term").unionByName(lists.where("term IS NULL").withColumns({"idf": F.lit(None).cast("double"), "wanted": F.lit(False)}))


def each_segment(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work() on the rows of each segment. Spark must not merge parts that are small in bytes: a segment is work for a task."""
    n = rows.where("term IS NULL").count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(8 * n, MOST_PARTS))  # so many that few segments share one
    names = ["segment", *(c for c in rows.columns if c != "segment")]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column(0).to_numpy()
            for begin, end in pairwise([0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]):
                if held and held[0].column(0)[0].as_py() != own[begin]:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.select(names).repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(each, schema)


def index_of(lists: DataFrame, idfs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The index, saved, so that many searches can read it; with the lists of the terms in only(term), if given."""
    return save(each_segment(weighted(lists, idfs, only), _finished, _INDEX), "index")


def query_weights(queries: DataFrame, query_key: str, text: str, idfs: DataFrame) -> DataFrame:
    """(query, term, weight) of unit vectors over the terms that the corpus has."""
    counts = queries.select(F.col(query_key).cast("long").alias("query"), F.explode(tokens(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf"))
    raw = counts.join(idfs, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query")))  # the terms of one query
    return raw.select("query", "term", (F.col("w") / norm).alias("weight"))


def _fixed(x: float) -> Decimal:
    """As functions.numbers.fixed()."""
    nine = Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
    return min(nine.quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP), Decimal(1))


class Segment:
    """The lists of a segment for the terms of some queries."""

    def __init__(self, rows: pa.Table) -> None:
        named = rows.filter(rows["term"].is_null())
        self.keys = np.array(named["keys"][0].as_py() if named.num_rows else [], np.int64)
        lists = rows.filter(rows["term"].is_valid())
        columns = []
        for values, n in (_flat(lists[c]) for c in ("slots", "weights", "blocks", "tops")):
            columns.append(np.split(values, np.cumsum(n)[:-1]) if len(n) else [])
        self.of = dict(zip(lists["term"].to_pylist(), zip(*columns, strict=True), strict=True))
        self.n_blocks = -(-len(self.keys) // BLOCK)
        self.touched = self.all = 0

    def bounds(self, query: list[tuple[str, float]]) -> np.ndarray:
        """The highest score that a document of each block can have."""
        found = np.zeros(self.n_blocks)
        for term, weight in query:
            if own := self.of.get(term):
                found[own[2]] += weight * own[3]
        return found

    def scores(self, query: list[tuple[str, float]], blocks: np.ndarray) -> np.ndarray:
        """Of every document in the blocks, which ascend; those of others stay 0. Only postings in the blocks are read."""
        found = np.zeros(self.n_blocks * BLOCK)
        for term, weight in query:
            if own := self.of.get(term):
                slots, weights = own[0], own[1]
                begin, end = np.searchsorted(slots, blocks * BLOCK), np.searchsorted(slots, blocks * BLOCK + BLOCK)
                n = end - begin
                at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                found[slots[at]] += weight * weights[at]
                self.touched += len(at)
                self.all += len(slots)
        return found

    def best(self, query: list[tuple[str, float]], k: int, least: float, first: bool) -> list[tuple[int, Decimal]]:
        """The k best (key, score) that reach least, ties by key; in the first round of the blocks with the highest bounds only."""
        bounds = self.bounds(query)
        blocks = np.flatnonzero((bounds > 0) & (bounds >= least - SLACK))
        if first and len(blocks) > FIRST * k:
            blocks = np.sort(blocks[np.argpartition(-bounds[blocks], FIRST * k)[: FIRST * k]])
        scores = self.scores(query, blocks)
        some = np.flatnonzero(scores > 0)
        if len(some) > k:
            least = max(least, np.partition(scores[some], -k)[-k])
        kept = [(int(self.keys[i]), _fixed(float(scores[i]))) for i in some[scores[some] >= least - SLACK]]
        return sorted((x for x in kept if x[1] > 0), key=lambda x: (-x[1], x[0]))[:k]


def _round(index: DataFrame, wanted: dict[int, list[tuple[str, float]]], k: int, least: dict[int, float], first: bool) -> DataFrame:
    """(query, key, score) of each segment; in a row without a query, the postings touched and those of all lists of the queries."""
    terms = index.sparkSession.createDataFrame([(t,) for t in {t for q in wanted.values() for t, _ in q}], "term string")
    read = index.join(F.broadcast(terms), "term", "left_semi").unionByName(index.where("term IS NULL"))  # BATCH rows at most
    sent = index.sparkSession.sparkContext.broadcast((wanted, least))

    def each(rows: pa.Table) -> pa.Table:
        segment, (queries, floors) = Segment(rows), sent.value
        found = [(q, key, float(score), None, None) for q, own in queries.items() for key, score in segment.best(own, k, floors.get(q, 0.0), first)]
        found.append((None, None, None, segment.touched, segment.all))
        kinds = {"query": pa.int64(), "key": pa.int64(), "score": pa.float64(), "touched": pa.int64(), "of": pa.int64()}
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), zip(*found, strict=True), strict=True)})

    return save(each_segment(read, each, "query long, key long, score double, touched long, of long"), "round")


def _batches(weights: DataFrame) -> list[dict[int, list[tuple[str, float]]]]:
    """The queries, in parts of BATCH weights or, where one query has more, somewhat above."""
    n = max(1, -(-weights.count() // BATCH))
    found = []
    for b in range(n):
        wanted: dict[int, list[tuple[str, float]]] = {}
        for r in weights.where(F.pmod(F.xxhash64("query"), F.lit(n)) == b).orderBy("query", "term").toLocalIterator():
            wanted.setdefault(r["query"], []).append((r["term"], r["weight"]))
        found.append(wanted)
    return found


def search(index: DataFrame, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """weights: query_weights(), saved. Gives (query, key, score, posicao) of the k best documents of each query, ties by key; and
    (touched, of), the postings that both rounds scored and all postings of the terms of the queries."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))
    ranked = lambda df: df.where("query IS NOT NULL").withColumn("posicao", place).where(F.col("posicao") <= k)
    found, counts = [], []
    for wanted in _batches(weights):
        tried = _round(index, wanted, k, {}, True)
        # the k-th best score found so far, for queries that have k documents
        least = {r["query"]: r["score"] for r in ranked(tried).where(F.col("posicao") == k).collect()}  # a row of each query of the batch
        done = _round(index, wanted, k, least, False)
        found.append(ranked(done))
        first, second = (df.where("query IS NULL").agg(F.coalesce(F.sum("touched"), F.lit(0)).alias("touched"), F.coalesce(F.sum("of"), F.lit(0)).alias("of")) for df in (tried, done))
        counts += [first.select("touched", F.lit(0).cast("long").alias("of")), second]
    both = reduce(DataFrame.unionByName, counts).agg(F.sum("touched").alias("touched"), F.sum("of").alias("of"))
    return reduce(DataFrame.unionByName, found).select("query", "key", "score", "posicao"), both


def top(queries: DataFrame, docs: DataFrame, query_key: str, key: str, k: int, text: str = "text", query_text: str = "text") -> DataFrame:
    """(query_key, key, score, posicao) of the k best documents of each query, with an index built for this search."""
    if not all(isinstance(df.schema[c].dataType, LongType) for df, c in ((queries, query_key), (docs, key))):
        raise TypeError("keys must be whole numbers")
    lists = term_lists(docs, key, text)
    idfs = idf(lists)
    weights = save(query_weights(queries, query_key, query_text, idfs), "query_weights")
    found, _ = search(index_of(lists, idfs, weights.select("term").distinct()), weights, k)
    return found.withColumnsRenamed({"query": query_key, "key": key})
