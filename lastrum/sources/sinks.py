"""Sinks: semicolon CSV of listed prices, report samples, audit CSV, JSON export, and the aggregate in place of a materialised view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.operators.analytics import municipal_cube

#: Rows of a CSV export of prices; the limit is part of the feature.
EXPORT_ROWS = 10_000
PRICE_COLUMNS = ("item_id", "uf", "municipio", "descricao", "categoria", "preco", "data", "numero_controle")
BOM = "﻿"


def price_rows(prices: DataFrame, rows: int = EXPORT_ROWS) -> DataFrame:
    """The rows of an export, prices with two decimals; the newest first."""
    newest = prices.orderBy(F.col("data").desc_nulls_last(), "item_id").limit(rows)
    return newest.select(*[F.format_string("%.2f", "preco").alias("preco") if c == "preco" else c for c in PRICE_COLUMNS])


def write_prices_csv(prices: DataFrame, path: str, rows: int = EXPORT_ROWS) -> None:
    """One file with a byte-order mark and semicolons. The mark belongs to the name of the first column, so no other step adds it."""
    out = price_rows(prices, rows)
    out.withColumnRenamed(out.columns[0], BOM + out.columns[0]).coalesce(1).write.mode("overwrite").csv(path, header=True, sep=";")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Report samples (sep=';') and audit events."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def export_rows(prices: DataFrame, n: int = 100) -> DataFrame:
    """One JSON document: the newest prices, the categories, the states and counts."""
    newest = prices.orderBy(F.col("data").desc_nulls_last(), "item_id").limit(n)
    sample = newest.agg(F.collect_list(F.struct("item_id", "uf", "descricao", "preco", "data")).alias("precos"))
    facts = prices.agg(F.sort_array(F.collect_set("categoria")).alias("categorias"), F.sort_array(F.collect_set("uf")).alias("ufs"), F.count("*").alias("total"))
    return sample.crossJoin(facts).select(F.to_json(F.struct("precos", "categorias", "ufs", "total")).alias("value"))  # one row each


def write_json(prices: DataFrame, path: str, n: int = 100) -> None:
    export_rows(prices, n).write.mode("overwrite").text(path)


def write_cube(prices: DataFrame, path: str) -> None:
    """Refreshes the municipal aggregate, a folder per state."""
    municipal_cube(prices).write.mode("overwrite").partitionBy("uf").parquet(path)


def append_log(events: DataFrame, path: str) -> None:
    """Audit and alert logs only grow."""
    events.write.mode("append").parquet(path)
