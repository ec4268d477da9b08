"""The municipal cube as a state that deltas are merged into, so that a refresh reads the new prices and not all of them again.

The state counts each price of a cell (state, place and description). Counts add up, and from them come the mean, the deviation
and the exact median. With a stored table, readers keep the version that they opened while the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.functions.numbers import fixed
from lastrum.operators.stats import medians_of

CELL = ("uf", "municipio", "descricao")
STATE = "uf string, municipio string, descricao string, preco double, n long, data date"


def state(prices: DataFrame) -> DataFrame:
    """STATE of prices: the count and newest date of each price of each cell; null prices are counted too."""
    return prices.groupBy(*CELL, F.col("preco").cast("double").alias("preco")).agg(F.count("*").alias("n"), F.max("data").alias("data"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """STATE of the prices of both."""
    return old.unionByName(new).groupBy(*CELL, "preco").agg(F.sum("n").alias("n"), F.max("data").alias("data"))


def presented(counts: DataFrame) -> DataFrame:
    """The cube as analytics.municipal_cube() has it."""
    keyed = counts.withColumn("cell_key", F.to_json(F.struct(*CELL), {"ignoreNullFields": "false"}))  # null is a value of a cell's key
    cells = keyed.groupBy(*CELL, "cell_key").agg(F.sum("n").alias("qtd_referencias"), F.min("preco").alias("preco_min"), F.max("preco").alias("preco_max"), F.max("data").alias("data_ultima_ref"), (F.sum(F.col("preco") * F.col("n")) / F.sum(F.when(F.col("preco").isNotNull(), F.col("n")))).alias("_mean"))
    middle = medians_of(keyed.where("preco IS NOT NULL").select("cell_key", F.col("preco").alias("_v"), F.col("n").alias("_c")), ["cell_key"])
    out = cells.join(middle.select("cell_key", "mediana", "dp"), "cell_key", "left")
    return out.select(*CELL, "qtd_referencias", fixed("_mean", 4).alias("preco_medio"), fixed("mediana", 4).alias("preco_mediano"), "preco_min", "preco_max", fixed("dp", 4).alias("desvio"), "data_ultima_ref")
