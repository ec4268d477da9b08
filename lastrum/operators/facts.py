"""The price fact: processed sources and items without one, as one table; filters, listing and paging over it.

A price has the columns item_id, order_id, numero_controle, uf, municipio, data, categoria, descricao, preco, tipo_objeto and
score (0 to 1). Filters are columns over the union; Catalyst pushes them into both branches and down to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastrum.functions.pricing import confidence, listing_link
from lastrum.operators import paging

SORT_KEYS = ("data", "preco")
KINDS = ("material", "servico", "obra")
UNPROCESSED_SCORE = 0.75


def unified(processed: DataFrame, items: DataFrame, key: str = "order_id") -> DataFrame:
    """processed, and the items whose key no processed row has; the latter have no category and a fixed score. Duplicates stay."""
    rest = items.join(processed.select(key), key, "left_anti")
    rest = rest.withColumns({"categoria": F.lit(None).cast("string"), "score": F.lit(UNPROCESSED_SCORE)})
    return processed.withColumn("fonte", F.lit("A")).unionByName(rest.withColumn("fonte", F.lit("B")))


def unified_by(df: DataFrame, source: Column, sources: DataFrame, key: str = "order_id") -> DataFrame:
    """unified() of one frame whose rows are processed sources where a column holds. sources has the keys of the processed ones; it
    may be a narrow scan, so that the rows themselves are read once and filters of the listing reach them before this join."""
    keys = sources.select(key).distinct().withColumn("_taken", F.lit(True))
    kept = df.withColumn("fonte", F.when(source, "A").otherwise("B")).join(keys, key, "left").where("fonte = 'A' OR _taken IS NULL").drop("_taken")
    return kept.withColumns({"categoria": F.when(F.col("fonte") == "A", F.col("categoria")), "score": F.when(F.col("fonte") == "A", F.col("score")).otherwise(UNPROCESSED_SCORE)})


def contains(column: Column | str, text: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).ilike(f"%{text}%")


def object_kind_filter(kind: str | None, column: str = "tipo_objeto") -> list[Column]:
    """Rows of a kind, material where none is stated; an unknown kind filters nothing."""
    wanted = (kind or "").strip().lower()
    return [F.coalesce(F.col(column), F.lit("material")) == wanted] if wanted in KINDS else []


def predicates(
    states: Sequence[str] = (),
    category: str | None = None,
    since: date | None = None,
    until: date | None = None,
    lowest: float | None = None,
    highest: float | None = None,
    place: str | None = None,
    kind: str | None = None,
) -> list[Column]:
    """The optional filters of a listing. A category is looked for in the description where a row has none."""
    found = object_kind_filter(kind)
    if states:
        found.append(F.col("uf").isin([s.upper() for s in states]))
    if category:
        found.append(contains(F.coalesce("categoria", "descricao"), category))
    if since is not None:
        found.append(F.col("data") >= F.lit(since))
    if until is not None:
        found.append(F.col("data") <= F.lit(until))
    if lowest is not None:
        found.append(F.col("preco") >= lowest)
    if highest is not None:
        found.append(F.col("preco") <= highest)
    if place:
        found.append(contains("municipio", place))
    return found


def valid(outlier: str | None = None, active: str | None = None, priced: bool = True) -> list[Column]:
    """Active, no outlier, and with a positive price; operators that leave a test out say so by their arguments."""
    found = [F.col(active)] if active else []
    found += [~F.col(outlier)] if outlier else []
    return found + ([F.col("preco").isNotNull() & (F.col("preco") > 0)] if priced else [])


def where(df: DataFrame, tests: Sequence[Column]) -> DataFrame:
    return df.where(reduce(and_, tests)) if tests else df


def real_numbers() -> Column:
    """Control numbers of the official form, which seed rows don't have."""
    return F.col("numero_controle").rlike("^[0-9]{14}-")


def since_months(column: str, as_of: date, months: int) -> Column:
    return F.col(column) >= F.add_months(F.lit(as_of), -months)


def page(df: DataFrame, number: int, size: int, by: str = "data", descending: bool = True, key: str = "item_id") -> DataFrame:
    """One page, sorted by date or price with nulls last, then by key. An unknown sort key means the date."""
    return paging.page(df, number, size, by if by in SORT_KEYS else "data", descending, key, paging.MOST)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def presented(df: DataFrame, base: str = "https://portal.example/app/editais") -> DataFrame:
    """Listed rows with confidence, link and short description."""
    return df.withColumns({"confianca": confidence("score"), "link": listing_link("numero_controle", base), "descricao": F.trim(F.substring("descricao", 1, 300))})


def without(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of df that have no partner in other."""
    return df.join(other.select(on).distinct() if isinstance(on, list) else other.select(on), on, "left_anti")


def having(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on), on, "left_semi")


def latest(df: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The newest n rows by key."""
    return df.orderBy(F.col(key).desc()).limit(n)


def history(df: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """The newest prices whose description contains a text."""
    return where(df, [contains("descricao", text)]).orderBy(F.col("data").desc_nulls_last(), "item_id").limit(limit)
