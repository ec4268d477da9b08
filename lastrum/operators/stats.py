"""Descriptive statistics, outliers and reference prices of many groups at once.

Order statistics are exact and never gather a group in one task: values are counted by (group, value), a running sum over a
bounded number of cells of close values finds the cell that holds each rank, and only the values of those cells are summed up
in order. A group with a third of all rows is spread over its cells. Moments come from the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.functions.numbers import fixed

#: Cells per factor e of the value.
CELLS = 512
LIMITS = {"iqr": 1.5, "percentil": (5, 95), "desvio": 2.0}


def _cell(value: str) -> Column:
    """Values in order fall into cells in order."""
    return F.floor(F.signum(value) * F.log1p(F.abs(F.col(value))) * CELLS)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _c): how often each value occurs in its group. All statistics below come from these counts. A plan that reads them in
    several branches computes them in each; a caller with many repeated values per group may save them first."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))


def _ranked(counts: DataFrame, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """One row per group: keys, n, _avg, _squares (about it), _min, _max, and the value at each rank.

    Moments are summed about the edge of each cell and then combined, so that close values of any size lose no digits."""
    counts = counts.withColumn("_cell", _cell("_v"))
    edge = F.signum("_cell") * F.expm1(F.abs("_cell") / CELLS)
    off = F.col("_v") - edge
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * off).alias("_d"), F.sum(F.col("_c") * off * off).alias("_e"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({"_upto": F.sum("_s").over(running), "n": F.sum("_s").over(group), "_mean": edge + F.col("_d") / F.col("_s"), "_min": F.min("_lo").over(group), "_max": F.max("_hi").over(group)})
    cells = cells.withColumn("_avg", F.sum(F.col("_s") * F.col("_mean")).over(group) / F.col("n"))
    about = F.col("_e") - F.col("_d") * F.col("_d") / F.col("_s") + F.col("_s") * (F.col("_mean") - F.col("_avg")) * (F.col("_mean") - F.col("_avg"))
    cells = cells.withColumn("_squares", F.greatest(F.sum(about).over(group), F.lit(0.0)))
    own = ["n", "_avg", "_squares", "_min", "_max"]
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    here = F.filter(wanted, lambda r: (r["rank"] <= F.col("_upto")) & (r["rank"] > F.col("_upto") - F.col("_s")))
    cells = cells.withColumn("_r", here).where(F.size("_r") > 0).select(*keys, "_cell", *own, "_r", (F.col("_upto") - F.col("_s")).alias("_before"))
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = counts.join(cells, [*keys, "_cell"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(in_cell))
    at = near.select(*keys, *own, "_v", "_upto", "_c", F.explode("_r").alias("_r")).where((F.col("_r.rank") <= F.col("_upto")) & (F.col("_r.rank") > F.col("_upto") - F.col("_c")))
    return at.groupBy(*keys, *own).agg(*[F.max(F.when(F.col("_r.name") == name, F.col("_v"))).alias(name) for name in ranks])


def values_at(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row per group: keys, n and, for each name of ranks, the value at that rank (from 1, a column over n); null at rank null.

    Null values don't count; groups without any have no row."""
    return values_of(value_counts(df, keys, value), keys, ranks)


def values_of(counts: DataFrame, keys: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """values_at() from value_counts()."""
    return _ranked(counts, list(keys), ranks).drop("_avg", "_squares", "_min", "_max")


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: n, mediana and dp (of a sample), unrounded."""
    return medians_of(value_counts(df, keys, value), keys)


def medians_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """medians() from value_counts()."""
    low, high = _middle(F.lit(1), F.col("n"))
    found = _ranked(counts, list(keys), {"_a": low, "_b": high})
    return found.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("mediana"), F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1))).alias("dp"))


def _middle(first: Column, length: Column) -> tuple[Column, Column]:
    """Ranks of the one or two middle values of length values that begin at rank first."""
    return first + F.floor((length - 1) / 2), first + F.floor(length / 2)


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: n, media, mediana, desvio and variancia (of a sample), q1 and q3 (medians of the halves, without the middle value
    of an odd number), iqr, minimo, maximo, cv. A single value has only media, mediana, minimo, maximo, unrounded; else 4 decimals."""
    return _described(value_counts(df, keys, value), keys)


def _described(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    ranks = {}
    for name, (low, high) in {"_m": _middle(F.lit(1), n), "_q": _middle(F.lit(1), half), "_t": _middle(n - half + 1, half)}.items():
        ranks |= {f"{name}1": F.when(n > 1, low).otherwise(1) if name == "_m" else F.when(n > 1, low), f"{name}2": F.when(n > 1, high).otherwise(1) if name == "_m" else F.when(n > 1, high)}
    variance = F.when(n > 1, F.col("_squares") / (n - 1))
    both = _ranked(counts, list(keys), ranks).withColumns({"_var": variance, "_sd": F.sqrt(variance)})
    r4 = lambda c: F.when(F.col("n") > 1, fixed(c, 4)).otherwise(c)
    q1, q3 = (F.col("_q1") + F.col("_q2")) / 2, (F.col("_t1") + F.col("_t2")) / 2
    cv = F.when((F.col("n") > 1) & (F.col("_avg") != 0), fixed(F.col("_sd") / F.col("_avg"), 4))
    return both.select(
        *keys,
        "n",
        r4(F.col("_avg")).alias("media"),
        r4((F.col("_m1") + F.col("_m2")) / 2).alias("mediana"),
        fixed("_sd", 4).alias("desvio"),
        fixed("_var", 4).alias("variancia"),
        fixed(q1, 4).alias("q1"),
        fixed(q3, 4).alias("q3"),
        fixed(q3 - q1, 4).alias("iqr"),
        F.col("_min").alias("minimo"),
        F.col("_max").alias("maximo"),
        cv.alias("cv"),
        q1.alias("_q1_exact"),
        q3.alias("_q3_exact"),
    )


def described(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return describe(df, keys, value).drop("_q1_exact", "_q3_exact")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """Per group: n, and p<percent> by linear interpolation at (n - 1) p / 100."""
    k = {p: (F.col("n") - 1) * p / F.lit(100.0) for p in percents}
    ranks = {f"_{p}{side}": (F.floor(k[p]) if side == "a" else F.ceil(k[p])) + 1 for p in percents for side in "ab"}
    placed = values_at(df, keys, value, ranks)
    return placed.select(*keys, "n", *[(F.col(f"_{p}a") + (F.col(f"_{p}b") - F.col(f"_{p}a")) * (k[p] - F.floor(k[p]))).alias(f"p{p}") for p in percents])


def _fences(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """_described() with baixo and alto of the quartile rule."""
    spread = LIMITS["iqr"] * (F.col("_q3_exact") - F.col("_q1_exact"))
    return _described(counts, keys).withColumns({"baixo": F.col("_q1_exact") - spread, "alto": F.col("_q3_exact") + spread})


def _fenced(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """counts with _all (values of the group), _cv and _out; whether a value is an outlier depends on the value alone."""
    limits = _fences(counts, keys).select(*keys, F.col("n").alias("_all"), F.col("cv").alias("_cv"), "baixo", "alto")
    out = F.coalesce((F.col("_v") < F.col("baixo")) | (F.col("_v") > F.col("alto")), F.lit(False))
    return counts.join(limits, list(keys)).withColumn("_out", out).drop("baixo", "alto")


def bounds(df: DataFrame, keys: Sequence[str], value: str, method: str = "iqr") -> DataFrame:
    """Per group: n, baixo and alto, beyond which a value is an outlier; null where a group has too few values."""
    if method == "iqr":
        return _fences(value_counts(df, keys, value), keys).select(*keys, "n", "baixo", "alto")
    if method == "percentil":
        low, high = LIMITS["percentil"]
        found = percentiles(df, keys, value, (low, high))
        enough = F.col("n") > 1
        return found.select(*keys, "n", F.when(enough, F.col(f"p{low}")).alias("baixo"), F.when(enough, F.col(f"p{high}")).alias("alto"))
    if method == "desvio":
        wide = LIMITS["desvio"] * F.stddev_samp(value)
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), (F.avg(value) - wide).alias("baixo"), (F.avg(value) + wide).alias("alto"))
    raise ValueError(f"unknown method: {method}")


def outliers(df: DataFrame, keys: Sequence[str], value: str, method: str = "iqr") -> DataFrame:
    """df with outlier and motivo (null for the others). Limits are strict."""
    limits = bounds(df, keys, value, method).drop("n")
    out = df.join(limits, list(keys), "left")
    side = F.when(F.col(value) < F.col("baixo"), F.lit(f"abaixo do limite ({method})")).when(F.col(value) > F.col("alto"), F.lit(f"acima do limite ({method})"))
    return out.withColumns({"motivo": side, "outlier": side.isNotNull()}).drop("baixo", "alto")


def reference_price(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: preco_referencia (median without outliers), confianca, n_amostras, n_excluidos, cv. The quartiles lie between the
    limits, so no group loses all of its values."""
    return _reference(value_counts(df, keys, value), keys)


def _reference(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    kept = _fenced(counts, keys).where(~F.col("_out")).select(*keys, "_all", "_v", "_c")
    found = _described(kept, [*keys, "_all"])
    n, cv = F.col("n"), F.col("cv")
    sure = F.when((n >= 10) & (cv < 0.3), "ALTA").when(n >= 5, "MEDIA").when(n >= 2, "BAIXA").otherwise("INSUFICIENTE")
    return found.select(*keys, F.col("mediana").alias("preco_referencia"), sure.alias("confianca"), n.alias("n_amostras"), (F.col("_all") - n).alias("n_excluidos"), "cv")


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """described() and, from the same table of counts, reference_price() of each group; cv is that of all its values."""
    counts = value_counts(df, keys, value)
    return _described(counts, keys).drop("_q1_exact", "_q3_exact").join(_reference(counts, keys).drop("cv"), list(keys))


def gated(df: DataFrame, value: str = "preco", score: str = "score", least: float = 30) -> DataFrame:
    """Rows with a sufficient score and a positive price; missing ones count as 0."""
    return df.where((F.coalesce(F.col(score), F.lit(0)) >= least) & (F.coalesce(F.col(value), F.lit(0.0)) > 0))


def unit_summary(df: DataFrame, value: str = "preco", unit: str = "unidade", score: str = "score") -> DataFrame:
    """Statistics and reference price per unit, over rows that pass the gate; no unit is SEM_UNIDADE."""
    rows = gated(df, value, score).withColumn(unit, F.coalesce(F.nullif(F.col(unit), F.lit("")), F.lit("SEM_UNIDADE")))
    return summary(rows, [unit], value)


def state_counts(df: DataFrame, state: str = "uf", value: str = "preco", score: str = "score") -> DataFrame:
    return gated(df, value, score).groupBy(F.coalesce(F.col(state), F.lit("DESCONHECIDA")).alias(state)).agg(F.count("*").alias("n"))


def calibration(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: the outlier method that suits it, and its limit."""
    found = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), fixed(F.try_divide(F.stddev_samp(value), F.avg(value)), 4).alias("cv"))
    method = F.when(F.col("n") < 5, "desvio").when(F.col("cv") > 0.5, "iqr").when(F.col("cv") <= 0.3, "percentil").otherwise("iqr")
    limits = F.when(F.col("metodo") == "desvio", "2.0").when(F.col("metodo") == "percentil", "5-95").otherwise("1.5")
    return found.withColumn("metodo", method).withColumn("limite", limits)


def sample_quality(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: n, n_outliers, pct_outliers, cv, nivel and recomendacoes (array)."""
    marked = _fenced(value_counts(df, keys, value), keys)
    found = marked.groupBy(*keys, F.col("_all").alias("n"), F.col("_cv").alias("cv")).agg(F.coalesce(F.sum(F.when(F.col("_out"), F.col("_c"))), F.lit(0).cast("long")).alias("n_outliers"))
    n, cv = F.col("n"), F.col("cv")
    found = found.withColumn("pct_outliers", fixed(F.col("n_outliers") / n * 100, 2))
    level = F.when((cv < 0.15) & (n >= 10), "EXCELENTE").when((cv < 0.3) & (n >= 5), "BOM").when(n >= 3, "REGULAR").otherwise("INSUFICIENTE")
    advice = F.array(
        F.when(n < 3, "Fonte insuficiente para relatório"),
        F.when(n < 10, "Ampliar período de pesquisa"),
        F.when(F.col("pct_outliers") > 20, "Verificar outliers manualmente"),
        F.when(cv > 0.5, "Alta dispersão — verificar compatibilidade das amostras"),
    )
    return found.withColumns({"nivel": level, "recomendacoes": F.filter(advice, lambda x: x.isNotNull())})
