"""Ingestion runs by state with their lag, categories of items through a bridge, seed rows, and batch classification of new items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "[SEED]"
#: Most hours between the newest contract and the end of a run.
SLA_HOURS = 6.0


def lag_hours(newest: Column, end: Column) -> Column:
    """Hours from the newest contract to the end of a run; null where there is none."""
    return (end.cast("timestamp_ntz").cast("timestamp").cast("double") - newest.cast("timestamp_ntz").cast("timestamp").cast("double")) / 3600


def runs(contracts: DataFrame, items: DataFrame, states: DataFrame, end: Column, key: str = "contrato", state: str = "uf", published: str = "data", sla: float = SLA_HOURS) -> DataFrame:
    """A row per state of states(uf): contratos, itens, data_fim, atraso_horas, dentro_sla, sucesso. A state without contracts has
    failed; its lag is null. Items are counted by contract before they meet the contracts."""
    per = items.groupBy(key).agg(F.count("*").alias("_items"))
    found = contracts.join(per, key, "left").groupBy(state).agg(F.count("*").alias("contratos"), F.coalesce(F.sum("_items"), F.lit(0)).alias("itens"), F.max(published).alias("data_fim"))
    out = states.join(found, state, "left").fillna(0, ["contratos", "itens"]).withColumn("atraso_horas", lag_hours(F.col("data_fim"), end))
    return out.withColumns({"dentro_sla": F.coalesce(F.col("atraso_horas") <= sla, F.lit(False)), "sucesso": F.col("contratos") > 0})


def roll_up(by_state: DataFrame, state: str = "uf") -> DataFrame:
    """One row over the states of a run: ufs, sucessos, falhas (their names in order, comma-joined), contratos, itens, fora_sla."""
    names = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col(state)))), ",")
    return by_state.agg(
        F.count("*").alias("ufs"),
        F.count_if("sucesso").alias("sucessos"),
        names(~F.col("sucesso")).alias("falhas"),
        F.coalesce(F.sum("contratos"), F.lit(0)).alias("contratos"),
        F.coalesce(F.sum("itens"), F.lit(0)).alias("itens"),
        names(F.col("sucesso") & ~F.col("dentro_sla")).alias("fora_sla"),
    )


def with_categories(items: DataFrame, bridge: DataFrame, categories: DataFrame, key: str, category: str = "categoria_id") -> DataFrame:
    """items with a row for each of their categories in bridge(key, categoria_id, ...); an item without any has one row with nulls."""
    return items.join(bridge, key, "left").join(categories, category, "left")


def state_of(own: Column | str, buyer: Column | str) -> Column:
    """The state of a price source, else that of its buyer."""
    return F.coalesce(own, buyer)


def without_seeds(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text doesn't begin with the seed mark; a null text drops out."""
    return df.where(~F.col(text).startswith(SEED))


def deleted(df: DataFrame, doomed: DataFrame, on: str) -> DataFrame:
    """df without the rows whose key is among those of doomed. A null key is never among them."""
    return df.join(doomed.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def newly_classified(items: DataFrame, known: DataFrame, key: str, classify: Callable[[], Column]) -> DataFrame:
    """(key, categoria, score) to append for the items that have no category in known: those that a rule fits."""
    fresh = deleted(items, known, key)
    return fresh.select(key, classify().alias("_c")).where(F.col("_c.categoria").isNotNull()).select(key, F.col("_c.categoria").alias("categoria"), F.col("_c.score").alias("score"))


def limited(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows; all of them where n isn't above 0."""
    return df.limit(n) if n and n > 0 else df


def dated(df: DataFrame, date: str = "data") -> DataFrame:
    """Rows with a date, oldest first."""
    return df.where(F.col(date).isNotNull()).orderBy(date)
