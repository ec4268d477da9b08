"""Duplicates, consolidation of sources, normalisation quality, and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.functions.numbers import fixed
from lastrum.functions.text import apply_synonyms, clean_description, normalise_unit

SLA_DUPLICATES, SLA_CLASSIFIED = 5.0, 85.0


def duplicate_rate(df: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: total, distintos, duplicados, taxa in per cent, dentro_sla. Keys are counted before they are counted as
    distinct, so a key that many rows share is one row in the shuffle."""
    counted = df.groupBy(group, key).agg(F.count("*").alias("_n"))
    out = counted.groupBy(group).agg(F.sum("_n").alias("total"), F.count("*").alias("distintos"))
    out = out.withColumn("duplicados", F.col("total") - F.col("distintos")).withColumn("taxa", fixed(F.col("duplicados") / F.col("total") * 100, 2))
    return out.withColumn("dentro_sla", F.col("taxa") <= SLA_DUPLICATES)


def repeated(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows that repeat an earlier one, with ocorrencia (2 for the first repeat)."""
    return df.withColumn("ocorrencia", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("ocorrencia > 1")


def suspects(df: DataFrame, key: str, order: str, limit: int = 100) -> DataFrame:
    return repeated(df, key, F.col(order)).orderBy(order).limit(limit)


def shared_content(df: DataFrame, key: str, group: str, order: str, example: str) -> DataFrame:
    """Keys that occur in more than one group: the sorted groups, the number of rows and the first example."""
    found = df.groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("grupos"), F.count("*").alias("n"), F.min_by(example, order).alias("exemplo"))
    return found.where(F.size("grupos") > 1)


def consolidated(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all sources, the first one of each key: an earlier source wins, then a smaller order. A key's row is found by
    min_by, which Spark combines before the shuffle, so a hot key needs no window over all its rows."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_src", F.lit(i))
        out = s if out is None else out.unionByName(s)
    rest = [c for c in out.columns if c not in (key, "_src")]
    best = out.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_src", order)).alias("_row"))
    return best.select(key, "_row.*")


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """old with the rows of new put in or over them: of each key the row with the highest version."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_row")).select(key, "_row.*")


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys it doesn't have; of new rows with equal keys one is taken."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def filled(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """old with its null values of a column filled from new; values that are there stay, and keys that old doesn't have are ignored.
    Of several values for a key the smallest counts, so a rerun gives the same."""
    some = new.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_filled"))
    return old.join(some, key, "left").withColumn(column, F.coalesce(column, "_filled")).select(*old.columns)


def refilled(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """items after an update of awarded prices: an estimate is only filled where it is null, an award replaces the price."""
    new = results.select(key, F.col("valor_estimado").alias("_e"), F.col("valor_homologado").alias("_h"))
    out = items.join(new, key, "left")
    return out.withColumns(
        {
            "valor_estimado": F.coalesce("valor_estimado", "_e"),
            "valor_homologado": F.coalesce("_h", "valor_homologado"),
            "valor_unitario": F.coalesce("_h", "valor_unitario"),
            "tipo_preco": F.when(F.col("_h").isNotNull(), "homologado").otherwise(F.col("tipo_preco")),
        }
    ).drop("_e", "_h")


def validated(items: DataFrame, description: str, state: str, unit: str) -> DataFrame:
    """items with pontos (0 to 10) and classificado (6 or more): 4 for a description, 2 for an applied synonym, 2 for a known unit or
    1 without a unit, 2 for more than five characters. Points are whole numbers, so that no sum falls short of the limit."""
    clean = clean_description(description)
    standard = apply_synonyms(clean, state)
    given = F.coalesce(F.nullif(F.col(unit), F.lit("")), F.lit(None).cast("string"))
    out = items.withColumns({"descricao_limpa": clean, "descricao_padrao": standard, "unidade_normalizada": normalise_unit(unit)})
    points = (
        F.when(F.col("descricao_limpa") != "", 4).otherwise(0)
        + F.when(F.col("descricao_padrao") != F.col("descricao_limpa"), 2).otherwise(0)
        + F.when(given.isNull(), 1).when(F.col("unidade_normalizada").isNotNull(), 2).otherwise(0)
        + F.when(F.length("descricao_limpa") > 5, 2).otherwise(0)
    )
    return out.withColumn("pontos", points).withColumn("classificado", F.col("pontos") >= 6)


def normalisation_quality(checked: DataFrame, *groups: str) -> DataFrame:
    out = checked.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if("classificado").alias("classificados"), fixed(F.avg(F.col("pontos") / 10), 4).alias("score_medio"))
    return out.withColumn("taxa", fixed(F.col("classificados") / F.col("n") * 100, 2)).withColumn("dentro_sla", F.col("taxa") >= SLA_CLASSIFIED)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, in proportion to the strata, at least one of each; chosen by a hash of key and seed, so reruns agree.

    The limit is the feature. A stratum's rows are cut by hash before they are ranked: only about twice its quota is sorted."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    quota = sizes.crossJoin(total).withColumn("_q", F.greatest(F.lit(1), fixed(F.lit(n) * F.col("_c") / F.col("_t"))).cast("int"))  # a row per stratum
    hashed = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = df.withColumn("_h", hashed).join(quota, stratum).where(F.col("_h") <= (2 * F.col("_q") + 20) / F.col("_c"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    return rows.withColumn("_k", place).where("_k <= _q").orderBy("_k", "_h", key).limit(n).drop("_h", "_c", "_t", "_q", "_k")


def rest_of_sample(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    return df.join(sample.select(key), key, "left_anti")


def integrity(prices: DataFrame) -> DataFrame:
    """One row: problemas, an array of what is missing."""
    counts = prices.agg(F.count("preco").alias("p"), F.countDistinct("categoria").alias("c"), F.countDistinct("uf").alias("u"))
    tests = F.array(F.when(F.col("p") == 0, "sem preços"), F.when(F.col("c") == 0, "sem categorias"), F.when(F.col("u") == 0, "sem estados"))
    return counts.select(F.filter(tests, lambda x: x.isNotNull()).alias("problemas"))
