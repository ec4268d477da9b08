"""Correction of prices by a monthly index.

The cumulative index is built once over the months of the series (a small dimension); the factor between two months is the
ratio of their cumulative values, so correcting a price is two equi joins with that dimension and never a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastrum.functions import rules
from lastrum.functions.numbers import fixed


def ipca(spark: SparkSession, first: tuple[int, int] = rules.IPCA_START) -> DataFrame:
    """(ano, mes, variacao_mensal), beginning at another month if one is given."""
    start = first[0] * 12 + first[1] - 1
    rows = [((start + i) // 12, (start + i) % 12 + 1, v) for i, v in enumerate(rules.IPCA)]
    return spark.createDataFrame(rows, "ano int, mes int, variacao_mensal double")


def month_number(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def accumulated(index: DataFrame) -> DataFrame:
    """Adds m (running month number), indice (base 100), acumulado_ano and acumulado_12m in per cent."""
    growth = 1 + F.col("variacao_mensal") / 100
    order = Window.orderBy("ano", "mes")
    year = Window.partitionBy("ano").orderBy("mes").rowsBetween(Window.unboundedPreceding, 0)
    return index.select(
        "*",
        month_number(F.col("ano"), F.col("mes")).alias("m"),
        (F.product(growth).over(order.rowsBetween(Window.unboundedPreceding, 0)) * 100).alias("indice"),
        ((F.product(growth).over(year) - 1) * 100).alias("acumulado_ano"),
        ((F.product(growth).over(order.rowsBetween(-11, 0)) - 1) * 100).alias("acumulado_12m"),
    )


def factors(df: DataFrame, index: DataFrame, origin: str, target: str) -> DataFrame:
    """df with fator from month number origin to target, rounded to 6; null if the origin is later. Months outside the series
    leave prices as they are: before it the index is 100, after it the last value."""
    series = accumulated(index).select("m", "indice")
    ends = series.agg(F.min("m").alias("_first"), F.max("m").alias("_last"))
    base = ends.select((F.col("_first") - 1).alias("m"), F.lit(100.0).alias("indice"))
    series = series.unionByName(base)
    keyed = df.crossJoin(F.broadcast(ends))  # one row
    clamp = lambda c: F.greatest(F.least(F.col(c), F.col("_last")), F.col("_first") - 1)
    keyed = keyed.withColumns({"_o": clamp(origin), "_t": clamp(target)})
    side = lambda name: series.select(F.col("m").alias(f"_{name}"), F.col("indice").alias(f"_i{name}"))
    both = keyed.join(F.broadcast(side("o")), "_o", "left").join(F.broadcast(side("t")), "_t", "left")  # a row per month
    factor = F.when(F.col(origin) == F.col(target), 1.0).when(F.col(origin) < F.col(target), fixed(F.col("_it") / F.col("_io"), 6))
    return both.withColumn("fator", factor).drop("_o", "_t", "_io", "_it", "_first", "_last")


def corrected(df: DataFrame, index: DataFrame, price: str, origin: str, target: str) -> DataFrame:
    """df with fator (1 where there is none), preco_corrigido and variacao_pct. The factor is rounded before it is applied."""
    out = factors(df, index, origin, target).withColumn("fator", F.coalesce("fator", F.lit(1.0)))
    return out.withColumns({"preco_corrigido": fixed(F.col(price) * F.col("fator"), 2), "variacao_pct": fixed((F.col("fator") - 1) * 100, 2)})


def coverage(index: DataFrame) -> DataFrame:
    """One row: first and last month (year * 100 + month), and the number of months."""
    month = F.col("ano") * 100 + F.col("mes")
    return index.agg(F.min(month).alias("inicio"), F.max(month).alias("fim"), F.count("*").alias("n_meses"))
