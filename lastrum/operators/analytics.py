"""Dashboards over the price fact: indicators, trends, comparisons and rankings of states, catalogues, benchmarks.

Windows without a partition run over rows that a grouping has already reduced to one per state or month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.functions.numbers import fixed
from lastrum.operators import grams
from lastrum.operators.stats import medians
from lastrum.operators.tables import save

STATES = 27


def kpis(prices: DataFrame, categorised: DataFrame) -> DataFrame:
    """One row: n_precos, n_ufs, ultima_data, cobertura (per cent of the states), n_categorias (of categorised)."""
    main = prices.agg(F.count("*").alias("n_precos"), F.countDistinct("uf").alias("n_ufs"), F.max("data").alias("ultima_data"))
    main = main.withColumn("cobertura", fixed(F.col("n_ufs") / STATES * 100, 1))
    return main.crossJoin(categorised.agg(F.countDistinct("categoria").alias("n_categorias")))  # one row each


def kpis_by_state(prices: DataFrame) -> DataFrame:
    return prices.groupBy("uf").agg(F.count("*").alias("n"), fixed(F.avg("preco"), 2).alias("preco_medio"), F.max("data").alias("ultima_data"))


def top_categories(prices: DataFrame, n: int = 5) -> DataFrame:
    return prices.groupBy("categoria").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "categoria").limit(n)


def monthly_trend(prices: DataFrame) -> DataFrame:
    return prices.groupBy("uf", F.date_format("data", "yyyy-MM").alias("periodo")).agg(F.avg("preco").alias("preco"))


def trend_variation(trend: DataFrame) -> DataFrame:
    """Each month against the first month of its state, in per cent."""
    first = F.first("preco").over(Window.partitionBy("uf").orderBy("periodo"))
    return trend.withColumn("variacao_pct", fixed(F.coalesce(F.try_divide(F.col("preco") - first, first), F.lit(0.0)) * 100, 2))


def trend_summary(trend: DataFrame) -> DataFrame:
    """Per state: first and last price, lowest, highest, variation, and ALTA above 2 per cent, QUEDA below -2, else ESTAVEL."""
    ends = trend.groupBy("uf").agg(F.min_by("preco", "periodo").alias("inicial"), F.max_by("preco", "periodo").alias("final"), F.min("preco").alias("minimo"), F.max("preco").alias("maximo"))
    ends = ends.withColumn("variacao_pct", fixed(F.coalesce(F.try_divide(F.col("final") - F.col("inicial"), F.col("inicial")), F.lit(0.0)) * 100, 2))
    return ends.withColumn("tendencia", F.when(F.col("variacao_pct") > 2, "ALTA").when(F.col("variacao_pct") < -2, "QUEDA").otherwise("ESTAVEL"))


def period_variation(trend: DataFrame) -> DataFrame:
    """Each month against the one before, in per cent; the first has 0."""
    before = F.lag("preco").over(Window.partitionBy("uf").orderBy("periodo"))
    return trend.withColumn("variacao_pct", fixed(F.coalesce(F.try_divide(F.col("preco") - before, before), F.lit(0.0)) * 100, 2))


def pivoted(trend: DataFrame, states: Sequence[str]) -> DataFrame:
    """Month by state; months without a price of a state have 0. The states are given, so that no pass over the data finds them."""
    return trend.groupBy("periodo").pivot("uf", list(states)).agg(F.first("preco")).fillna(0.0)


def compare_states(prices: DataFrame) -> DataFrame:
    return prices.groupBy("uf").agg(F.avg("preco").alias("media"), F.min("preco").alias("minimo"), F.max("preco").alias("maximo"), F.count("*").alias("n"))


def ranked(compared: DataFrame) -> DataFrame:
    """Adds posicao (cheapest first) and diff_media_pct against the mean of the means."""
    mean = F.avg("media").over(Window.partitionBy())
    out = compared.withColumn("posicao", F.row_number().over(Window.orderBy("media", "uf")))
    return out.withColumn("diff_media_pct", fixed((F.col("media") - mean) / mean * 100, 2))


def percentile_position(rank: DataFrame) -> DataFrame:
    """Adds percentil (position in per cent of all) and faixa: BARATO up to 33, MEDIO up to 66, else CARO."""
    share = fixed(F.col("posicao") / F.count("*").over(Window.partitionBy()) * 100, 1)
    return rank.withColumn("percentil", share).withColumn("faixa", F.when(F.col("percentil") <= 33, "BARATO").when(F.col("percentil") <= 66, "MEDIO").otherwise("CARO"))


def state_statistics(compared: DataFrame) -> DataFrame:
    """One row over the means of the states, each with the same weight; the deviation of fewer than two is 0."""
    return compared.agg(
        fixed(F.avg("media"), 4).alias("media"),
        fixed(F.median("media"), 4).alias("mediana"),
        fixed(F.coalesce(F.stddev_samp("media"), F.lit(0.0)), 4).alias("desvio"),
        F.min_by("uf", F.struct("media", "uf")).alias("mais_barata"),
        F.max_by("uf", F.struct("media", "uf")).alias("mais_cara"),
    )


def map_prices(rank: DataFrame) -> DataFrame:
    """One row: a map from state to (preco, posicao, diff), and the ends of the scale."""
    entry = F.struct("uf", F.struct(F.col("media").alias("preco"), "posicao", F.col("diff_media_pct").alias("diff")))
    return rank.agg(F.map_from_entries(F.collect_list(entry)).alias("ufs"), F.min("media").alias("escala_min"), F.max("media").alias("escala_max"))


def weighted_statistics(prices: DataFrame) -> DataFrame:
    """One row over the means of the states, each as often as it has prices: media, mediana, desvio."""
    means = prices.groupBy("uf").agg(F.avg("preco").alias("m"), F.count("*").alias("c"))
    rows = means.agg(F.sum("c").alias("n"), (F.sum(F.col("m") * F.col("c")) / F.sum("c")).alias("media")).withColumn("_one", F.lit(1))
    order = Window.orderBy("m", "uf")
    upto = means.withColumns({"upto": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_one": F.lit(1)})
    all_ = upto.join(rows, "_one")
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("m")))
    return all_.groupBy("n", "media").agg(
        ((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("mediana"),
        F.coalesce(F.sqrt(F.try_divide(F.sum(F.col("c") * F.pow(F.col("m") - F.col("media"), 2)), F.first("n") - 1)), F.lit(0.0)).alias("desvio"),
    ).select("n", fixed("media", 4).alias("media"), fixed("mediana", 4).alias("mediana"), fixed("desvio", 4).alias("desvio"))


def municipal_cube(prices: DataFrame) -> DataFrame:
    """The aggregate that stands for the materialised view: one row per state, place and description."""
    r4 = lambda c, name: fixed(c, 4).alias(name)
    return prices.groupBy("uf", "municipio", "descricao").agg(
        F.count("*").alias("qtd_referencias"),
        r4(F.avg("preco"), "preco_medio"),
        r4(F.median("preco"), "preco_mediano"),
        F.min("preco").alias("preco_min"),
        F.max("preco").alias("preco_max"),
        r4(F.stddev_samp("preco"), "desvio"),
        F.max("data").alias("data_ultima_ref"),
    )


def category_catalogue(categories: DataFrame, prices: DataFrame, active: Column, today) -> DataFrame:
    """Every category with its counts, also those without prices; the test is part of the join. No date means today."""
    some = prices.where(active).groupBy("categoria").agg(F.countDistinct("uf").alias("u"), F.count("item_id").alias("c"), F.max("data").alias("d"))
    return categories.join(some, "categoria", "left").select("categoria", F.coalesce("u", F.lit(0)).alias("n_ufs"), F.coalesce("c", F.lit(0)).alias("n_amostras"), F.coalesce("d", F.lit(today)).alias("ultima_data"))


def state_catalogue(branches: Sequence[DataFrame]) -> DataFrame:
    """Counts per state over all branches; each is grouped first, so the union holds a row per state and branch."""
    counted = [b.groupBy("uf").agg(F.count("*").alias("n"), F.max("data").alias("ultima_data")) for b in branches]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.groupBy("uf").agg(F.sum("n").alias("n"), F.max("ultima_data").alias("ultima_data"))


def benchmark_summary(prices: DataFrame) -> DataFrame:
    """Per category over the means of its states: media, mediana, cheapest and dearest state with their prices, n_ufs."""
    means = prices.groupBy("categoria", "uf").agg(F.avg("preco").alias("m"))
    key = F.struct("m", "uf")
    return means.groupBy("categoria").agg(
        fixed(F.avg("m"), 4).alias("media"),
        fixed(F.median("m"), 4).alias("mediana"),
        F.min_by("uf", key).alias("uf_mais_barata"),
        fixed(F.min("m"), 4).alias("menor_preco"),
        F.max_by("uf", key).alias("uf_mais_cara"),
        fixed(F.max("m"), 4).alias("maior_preco"),
        F.count("*").alias("n_ufs"),
    )


def lookup_category(names: DataFrame, table: DataFrame) -> DataFrame:
    """For each nome the first categoria of table(ordem, categoria) that is equal to it, contains it or is contained in it, whatever the
    case; null where none is. Both sides may be large: each is searched for the other's texts by an index of trigrams."""
    numbered = lambda df, c: save(df.select(c, *(x for x in df.columns if x != c)).withColumn("_n", F.monotonically_increasing_id()), c)
    known = numbered(names.select("nome").distinct(), "nome")
    categories = numbered(table.select("categoria", "ordem").where("categoria IS NOT NULL"), "categoria")
    inside = grams.search(grams.build(known, "_n", "nome"), categories, "_n", "categoria").select(F.col("key").alias("_name"), F.col("pattern").alias("_category"))
    around = grams.search(grams.build(categories, "_n", "categoria"), known, "_n", "nome").select(F.col("pattern").alias("_name"), F.col("key").alias("_category"))
    found = inside.unionByName(around).join(categories.withColumnRenamed("_n", "_category"), "_category")
    best = found.groupBy("_name").agg(F.min_by("categoria", "ordem").alias("categoria")).withColumnRenamed("_name", "_n")
    return known.join(best, "_n", "left").select("nome", "categoria")


def top_items(items: DataFrame, n: int = 20, order: str = "seq") -> DataFrame:
    """The most frequent (categoria, descricao), with the median of the positive prices; ties by first occurrence. Medians are taken
    of the rows of the n most frequent only, which no task gathers."""
    named = items.select(F.coalesce("categoria", F.lit("Sem Categoria")).alias("categoria"), "descricao", "preco", F.col(order).alias("_order"))
    found = named.groupBy("categoria", "descricao").agg(F.count("*").alias("n"), F.min("_order").alias("_first"))
    top = found.orderBy(F.col("n").desc(), "_first").limit(n).withColumn("_item", F.monotonically_increasing_id())
    top = save(top, "top_items")
    same = named["categoria"].eqNullSafe(top["categoria"]) & named["descricao"].eqNullSafe(top["descricao"])
    priced = named.where("preco > 0").join(F.broadcast(top), same).select("_item", "preco")  # n rows
    middle = medians(priced, ["_item"], "preco").select("_item", F.col("mediana").alias("preco_mediano"))
    return top.join(F.broadcast(middle), "_item", "left").orderBy(F.col("n").desc(), "_first").select("categoria", "descricao", "n", "preco_mediano")


def coverage_of_samples(items: DataFrame, sample: Column) -> DataFrame:
    return items.groupBy("uf").agg(F.count_if(sample).alias("com_amostras"), F.count_if(~F.coalesce(sample, F.lit(False))).alias("sem_amostras"))
