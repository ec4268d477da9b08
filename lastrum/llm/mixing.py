"""Mixing sources to target weights by hash-threshold histograms.

Each document hashes to 62 bits. Words are summed by source and top hash bits; in each source the bucket in which the running
sum passes the budget is the boundary bucket, and only that bucket is split by further bits. After a few levels the
boundary is a hash threshold, and the mix is a filter: no sort, and reruns agree. Budgets nest: the second pass over a source
takes the documents below a second, lower threshold again.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents hash by doc_id and text,
so only rows that repeat both move together (a source that is one such row many times over is taken as a whole or not). Of an empty table the mix is empty. Sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.llm.shared import BROADCAST_ROWS, save

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BITS, LEVELS, HASH_BITS = 10, 3, 62
#: Salts per source where the table of sources is too large to broadcast.
SALTS = 64
#: Ranges in which sources are ranked.
RANGES = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0 in order of the source by code point, null last: ranges of sources are ranked each in a task of its own."""
    order = F.col("source").asc_nulls_last()
    parts = save(sources.repartitionByRange(RANGES, order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # one row for each range
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("own", own).join(F.broadcast(offsets), "part").withColumn("rank", F.col("own") + F.col("offset")).drop("part", "own", "offset")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to sources(key, source, source_size): share of all sizes by weight, none above most times its size.

    The level of words per weight rises as the excess of capped sources is reshared, until it caps no further source; each
    round is one aggregate over the sources.
    """
    cycle = F.array(*map(F.lit, weights))
    ranked = _ranked(sources).withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")))
    ranked = save(ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size")), "ranked")
    budget = float(share) * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:
        capped = F.col("limit") < F.lit(level) * F.col("weight")
        row = ranked.agg(F.count_if(capped).alias("n"), F.coalesce(F.sum(F.when(capped, F.col("limit"))), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if row["n"] == before or not row["free"]:
            break
        before, level = row["n"], (budget - row["used"]) / row["free"]
    return ranked.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).select("key", "source", "source_size", "target")


def _by_source(big: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """big joined to the few rows that small has per source: by broadcast if small has at most BROADCAST_ROWS, else salted."""
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), "key")
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt", F.pmod("u", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, size, u) of each document: what the mix needs of it, without its text."""
    doc_id = F.col("doc_id").cast("long")
    source = F.col("source").cast("string")
    return docs.select(
        doc_id.alias("doc_id"),
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("key"),
        source.alias("source"),
        n_words(F.col("text")).alias("size"),
        F.shiftrightunsigned(F.xxhash64(doc_id, F.col("text").cast("string")), 2).alias("u"),
    )


def thresholds(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, bits: int = BITS, levels: int = LEVELS) -> tuple[DataFrame, int]:
    """(key, source_size, target, cuts) per source, and the number of sources: a document is taken once for each cut above its hash."""
    at = lambda level: F.shiftright("u", HASH_BITS - bits * level)
    first = save(rows.groupBy("key", "source", at(1).alias("cell")).agg(F.sum("size").alias("words")), "histogram")
    sources = save(targets(first.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    n = sources.count()
    passes = sources.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.least(F.greatest(F.col("target") - k * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double")))).alias("k", "budget"))
    cells = first.select("key", "cell", "words").join(passes, "key")
    running = Window.partitionBy("key", "k").orderBy("cell")
    boundary = None
    for level in range(1, levels + 1):
        cells = cells.withColumn("upto", F.sum("words").over(running))
        # the first cell in which the running sum reaches the budget; a rounding error at the top end leaves the last cell
        passed = cells.where(F.col("upto") >= F.col("budget") - 0.5).groupBy("key", "k").agg(F.min("cell").alias("cell"))
        boundary = save(cells.join(passed, ["key", "k", "cell"]).select("key", "k", "cell", "words", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("budget")), f"boundary{level}")
        if level < levels:
            inside = _by_source(rows.withColumn("above", at(level)), boundary.select("key", "k", F.col("cell").alias("of"), "budget"), 2 * n).where(F.col("above") == F.col("of"))
            cells = inside.groupBy("key", "k", "budget", at(level + 1).alias("cell")).agg(F.sum("size").alias("words"))
    shift = HASH_BITS - bits * levels
    cut = F.shiftleft(F.col("cell") + F.when(F.col("budget") > F.col("words") / 2, F.lit(1)).otherwise(F.lit(0)), shift)
    cuts = boundary.groupBy("key").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    return save(sources.join(cuts, "key").select("key", "source_size", "target", "cuts"), "cuts"), n


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0 to most), taken."""
    rows = save(sized(docs), "sizes")
    cuts, n = thresholds(rows, weights, share, most)
    copies = F.size(F.filter("cuts", lambda c: F.col("u") < c)).cast("long")
    return _by_source(rows, cuts, n).withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
