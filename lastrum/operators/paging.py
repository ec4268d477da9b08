"""Pages far down a sorted table: histograms of the sort key find the range that holds the page, and only that range is sorted.

A level of the histograms counts the rows of the range that is left in CELLS cells of equal width and goes on in the cell that holds
the place looked for. Where a single value is left, it goes on by the leading characters of the key. So no task holds
more than about MOST rows, however many rows come before the page or share a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from lastrum.operators.tables import save

#: Cells of a level.
CELLS = 1024
#: Most rows of a range that is sorted, besides those of the page.
MOST = 100_000


@dataclass
class Place:
    """A range of the order: rows without a value or with one from low to high, and whose key begins with prefix; before: the rows before it."""

    null: bool
    low: float
    high: float
    prefix: str
    before: int


def _number(df: DataFrame, by: str, descending: bool) -> Column:
    """The value as a number that ascends in the order wanted."""
    kind = df.schema[by].dataType
    if isinstance(kind, DateType):
        value = F.unix_date(by).cast("double")
    elif isinstance(kind, TimestampType | TimestampNTZType):
        value = F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    else:
        value = F.col(by).cast("double")
    return -value if descending else value


def _held(counts: list[tuple], rank: int) -> tuple[tuple, int]:
    """Of (cell, n, ...) in order, the one that holds the row of a rank, and the rows before it."""
    before = 0
    for cell in counts:
        if rank < before + cell[1]:
            return cell, before
        before += cell[1]
    raise ValueError("no such row")


def find(rows: DataFrame, rank: int, most: int = MOST) -> Place:
    """Where the row of a rank, from 0, lies in the order of rows(x, key), with null x last."""
    stated = rows.agg(F.count("x").alias("n"), F.count("*").alias("all"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    null = rank >= stated["n"]
    before, n = (stated["n"], stated["all"] - stated["n"]) if null else (0, stated["n"])
    low, high = (0.0, 0.0) if null else (stated["low"], stated["high"])
    inside = rows.where("x IS NULL" if null else "x IS NOT NULL")
    while n > most and low < high:
        part = inside.where(F.col("x").between(low, high))
        width = high / CELLS - low / CELLS
        cell = F.least(F.floor((F.col("x") - low) / width), F.lit(CELLS - 1)) if width > 0 else F.when(F.col("x") > low, 1).otherwise(0)
        counts = [tuple(r) for r in part.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x"), F.max("x")).orderBy("cell").collect()]  # CELLS rows at most
        (_, n, low, high), passed = _held(counts, rank - before)
        before += passed
    prefix = ""
    while n > most:
        part = inside.where(F.col("key").startswith(prefix)) if null else inside.where((F.col("x") == low) & F.col("key").startswith(prefix))
        begin = F.substring("key", 1, len(prefix) + 1)
        counts = [tuple(r) for r in part.groupBy(begin.alias("begin")).agg(F.count("*").alias("n")).orderBy("begin").collect()]  # a row for each character
        (longer, n), passed = _held(counts, rank - before)
        before += passed
        if longer == prefix:  # rows that share the whole key are in any order
            break
        prefix = longer
    return Place(null, low, high, prefix, before)


def _after(x: Column, key: Column, p: Place) -> Column:
    """Rows in the range or after it."""
    if p.null:
        return x.isNull() & (key >= p.prefix)
    return x.isNull() | (x > p.low) | ((x == p.low) & (key >= p.prefix))


def _upto(x: Column, key: Column, p: Place) -> Column:
    """Rows in the range or before it."""
    begun = (key < p.prefix) | key.startswith(p.prefix)
    if p.null:
        return x.isNotNull() | begun
    return (x < p.high) | ((x == p.high) & begun)


def page(df: DataFrame, number: int, size: int, by: str, descending: bool = True, key: str = "item_id", most: int = MOST) -> DataFrame:
    """Page number, from 1, of df sorted by a number, date or time with nulls last, then by key, a string that isn't null."""
    first = (number - 1) * size
    x, k = _number(df, by, descending), F.col(key)
    order = [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), k]
    if first + size <= most:
        return df.orderBy(*order).offset(first).limit(size)
    rows = save(df.select(x.alias("x"), k.alias("key")), "sort_keys")
    total = rows.count()
    if first >= total:
        return df.limit(0)
    start, end = find(rows, first, most), find(rows, min(first + size, total) - 1, most)
    return df.where(_after(x, k, start) & _upto(x, k, end)).orderBy(*order).offset(first - start.before).limit(size)
