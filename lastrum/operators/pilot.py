"""The pilot over municipalities: items of contracts processed in one lazy chain, the most frequent ones, and the figures of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.functions import pricing, text
from lastrum.operators import stats

PLACE = ("uf", "municipio")
ITEM = (*PLACE, "categoria", "descricao")
#: Days of contracts, items of a municipality, and prices listed in its report.
DAYS, TOP, SAMPLES = 90, 20, 50


def recent(contracts: DataFrame, until: Column, days: int = DAYS, date: str = "data") -> DataFrame:
    """Contracts of the days up to a date, both ends included."""
    return contracts.where(F.col(date).between(F.date_sub(until, days), until))


def processed(contracts: DataFrame, items: DataFrame, classify=text.classify) -> DataFrame:
    """A row per item: numero_controle, numero_item, uf, municipio, data, original, descricao (clean), unidade (canonical, or null),
    categoria and score_classificacao (null without a rule that fits), preco (the estimate, else the total; 0 is no estimate), pontos.

    contracts has numero_controle, cnpj, ano, sequencial, data, situacao (1: awarded), uf, municipio; items has numero_controle,
    numero_item, descricao, unidade, quantidade, valor_estimado, valor_total. Contracts without register, year, sequence or place,
    items without a description, and items of no contract give no row; a contract that is landed twice gives its items twice."""
    kind = F.when(F.col("situacao") == 1, "HOMOLOGADO").otherwise("ESTIMADO")
    known = contracts.where("cnpj <> '' AND ano <> 0 AND sequencial <> 0 AND uf IS NOT NULL AND municipio IS NOT NULL")
    known = known.select("numero_controle", *PLACE, "data", kind.alias("qualidade"))
    rows = items.where("descricao <> ''").join(known, "numero_controle").select(
        "numero_controle",
        "numero_item",
        *PLACE,
        "data",
        F.col("descricao").alias("original"),
        text.clean_description("descricao").alias("descricao"),
        text.normalise_unit("unidade").alias("unidade"),
        F.coalesce(F.nullif(F.col("valor_estimado"), F.lit(0.0)), "valor_total").alias("preco"),
        "quantidade",
        "qualidade",
    )
    none = F.lit(None).cast("string")
    rows = rows.withColumn("_class", classify("descricao")).withColumns({"categoria": F.col("_class.categoria"), "score_classificacao": F.col("_class.score")})
    points = pricing.quality_score(F.lit("portal"), "data", "quantidade", "qualidade", none, none, "unidade", "categoria", "score_classificacao")
    return rows.withColumn("pontos", points).drop("_class", "quantidade", "qualidade")


def totals(contracts: DataFrame, rows: DataFrame) -> DataFrame:
    """Per municipality: contratacoes and itens, counted in one grouping of both."""
    one, none = F.lit(1), F.lit(0)
    both = contracts.select(*PLACE, one.alias("_c"), none.alias("_i")).unionAll(rows.select(*PLACE, none, one))
    return both.groupBy(*PLACE).agg(F.sum("_c").alias("contratacoes"), F.sum("_i").alias("itens"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("categoria", F.coalesce("categoria", F.lit("Sem Categoria")))


def most_frequent(rows: DataFrame, n: int = TOP) -> DataFrame:
    """(uf, municipio, categoria, descricao, ocorrencias, posicao): the n most frequent items of each municipality, ties by the first
    item. Spark keeps n rows of a municipality in each partition before the shuffle, so a large one isn't sorted in one task."""
    counted = _named(rows).groupBy(*ITEM).agg(F.count("*").alias("ocorrencias"), F.min(F.struct("numero_controle", "numero_item")).alias("_first"))
    order = Window.partitionBy(*PLACE).orderBy(F.col("ocorrencias").desc(), "_first", "categoria", "descricao")
    return counted.withColumn("posicao", F.row_number().over(order)).where(F.col("posicao") <= n).drop("_first")


def prices_of(rows: DataFrame, top: DataFrame) -> DataFrame:
    """The rows of the items in most_frequent() that have a positive price, with their posicao."""
    return _named(rows).where(F.col("preco") > 0).join(top.select(*ITEM, "posicao"), list(ITEM))


def top_items(rows: DataFrame, n: int = TOP) -> DataFrame:
    """most_frequent() with preco_mediano, the exact median of the positive prices; null without any."""
    top = most_frequent(rows, n)
    middle = stats.medians(prices_of(rows, top), ITEM, "preco").select(*ITEM, F.col("mediana").alias("preco_mediano"))
    return top.join(middle, list(ITEM), "left")


def report(prices: DataFrame) -> DataFrame:
    """Statistics and reference price of each municipality over prices_of(). One without prices has no row."""
    return stats.summary(prices, PLACE, "preco")


def samples(prices: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first n prices that a report lists for each municipality, by the position of their item: uf, municipio, amostra (from 1),
    orgao, preco, qualidade."""
    order = Window.partitionBy(*PLACE).orderBy("posicao", "numero_controle", "numero_item", "preco")
    listed = prices.withColumn("amostra", F.row_number().over(order)).where(F.col("amostra") <= n)
    return listed.select(*PLACE, "amostra", F.concat(F.lit("Prefeitura de "), "municipio").alias("orgao"), "preco", F.lit("HOMOLOGADO").alias("qualidade"))


def compliance(listed: DataFrame, keys: tuple[str, ...] = PLACE, kind: str = "qualidade") -> DataFrame:
    """Per report: parametro_i (prices of former contracts), parametro_ii (published research, always), parametro_iii (official
    tables), by what the kinds of its samples contain in either case. Null kinds count as neither."""
    any_of = lambda word: F.coalesce(F.bool_or(F.upper(kind).contains(word)), F.lit(False))
    return listed.groupBy(*keys).agg(any_of("HOMOLOGADO").alias("parametro_i"), F.lit(True).alias("parametro_ii"), any_of("TABELA").alias("parametro_iii"))
