"""Queries over the price fact, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastrum.functions import pricing
from lastrum.functions.numbers import fixed
from lastrum.operators import analytics, cube, facts, inflation, paging, stats, usage
from lastrum.operators.tables import new_path
from lastrum.plans.domain import PRICES, UNIFIED, branches, prices, read, unified
from lastrum.plans.registry import Registry
from lastrum.sources.stored import StoredTable

registry = Registry()
query = registry.query

CATEGORY, PORTAL = "ECONOMY", "https://portal.example/app/editais"
_LISTED = """uf IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') AND data >= DATE '1996-01-01' AND data <= DATE '1999-12-31'
    AND preco >= 500 AND preco <= 5000 AND coalesce(categoria, descricao) ILIKE '%a%' AND coalesce(tipo_objeto, 'material') = 'material'
    AND preco > 0 AND regexp_matches(numero_controle, '^[0-9]{14}-')"""
_LINK = """concat('https://portal.example/app/editais/', split_part(numero_controle, '-', 1), '/', CAST(CAST(split_part(split_part(numero_controle, '-', 3), '/', 2) AS INT) AS VARCHAR), '/',
    CAST(CAST(split_part(split_part(numero_controle, '-', 3), '/', 1) AS INT) AS VARCHAR))"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = facts.predicates([f"nation_{i}" for i in (1, 2, 3, 4)], "a", date(1996, 1, 1), date(1999, 12, 31), 500.0, 5000.0, kind=" Material ")
    return facts.where(unified(spark, sf_dir), [*tests, *facts.valid(), facts.real_numbers()])


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: fixed(n, digits) for n in names})


@query(f"WITH {UNIFIED} SELECT * FROM unified")
def q_unified_prices(spark, sf_dir):
    return unified(spark, sf_dir).select("item_id", "order_id", "numero_controle", "uf", "municipio", "data", "categoria", "descricao", "preco", "tipo_objeto", "score", "fonte")


@query(f"""WITH {UNIFIED} SELECT item_id, uf, data, categoria, trim(substr(descricao, 1, 300)) AS descricao, preco,
    CASE WHEN coalesce(nullif(score, 0), 0.75) >= CAST(0.8 AS DOUBLE) THEN 'ALTA' WHEN coalesce(nullif(score, 0), 0.75) >= 0.5 THEN 'MEDIA' ELSE 'BAIXA' END AS confianca,
    {_LINK} AS link FROM unified WHERE {_LISTED} ORDER BY preco DESC NULLS LAST, item_id LIMIT 20 OFFSET 20""")
def q_price_listing_page(spark, sf_dir):
    page = facts.presented(facts.page(listed(spark, sf_dir), 2, 20, by="preco"), PORTAL)
    return page.select("item_id", "uf", "data", "categoria", "descricao", "preco", "confianca", "link")


@query(f"WITH {UNIFIED} SELECT item_id, uf, data, preco FROM unified ORDER BY data DESC NULLS LAST, item_id LIMIT 50 OFFSET 9950")
def q_price_deep_page(spark, sf_dir):
    """Page 200 of all prices by date: the range that holds it is found by histograms, and only that is sorted."""
    return paging.page(unified(spark, sf_dir).select("item_id", "uf", "data", "preco"), 200, 50, "data", most=2000)


@query(f"WITH {UNIFIED} SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS total_pages FROM unified WHERE {_LISTED}")
def q_price_count(spark, sf_dir):
    return facts.page_count(listed(spark, sf_dir), 20)


@query(f"WITH {UNIFIED} SELECT item_id, order_id FROM b")
def q_items_without_source(spark, sf_dir):
    processed, items = branches(spark, sf_dir)
    return facts.without(items, processed, "order_id").select("item_id", "order_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_contracts_without_items(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return facts.without(read(spark, sf_dir, "orders"), lines, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_contracts_to_refresh(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return facts.having(read(spark, sf_dir, "orders"), lines, "o_orderkey").select("o_orderkey", "o_orderstatus")


def category_prices(spark, sf_dir):
    return prices(spark, sf_dir).where((F.col("categoria") == CATEGORY) & ~F.col("atipico"))


_CAT = f"{PRICES}, chosen AS (SELECT * FROM prices WHERE categoria = '{CATEGORY}' AND NOT atipico)"
_TREND = f"{_CAT}, trend AS (SELECT uf, strftime(data, '%Y-%m') AS periodo, avg(preco) AS preco FROM chosen GROUP BY 1, 2)"
_COMPARED = f"{_CAT}, compared AS (SELECT uf, avg(preco) AS media, min(preco) AS minimo, max(preco) AS maximo, count(*) AS n FROM chosen GROUP BY uf)"
_RANKED = f"""{_COMPARED}, ranked AS (SELECT *, row_number() OVER (ORDER BY media, uf) AS posicao,
    round((media - avg(media) OVER ()) / avg(media) OVER () * 100, 2) AS diff_media_pct FROM compared)"""


@query(f"WITH {_TREND} SELECT uf, periodo, round(preco, 4) AS preco FROM trend")
def q_trend_monthly(spark, sf_dir):
    return rounded(analytics.monthly_trend(category_prices(spark, sf_dir)), 4, "preco")


@query(f"""WITH {_CAT} SELECT uf, strftime(data, '%Y-%m') AS periodo, round(avg(preco), 4) AS preco FROM chosen
    WHERE data >= DATE '2001-06-30' - INTERVAL 12 MONTH GROUP BY 1, 2""")
def q_trend_last_months(spark, sf_dir):
    recent = facts.where(category_prices(spark, sf_dir), [facts.since_months("data", date(2001, 6, 30), 12)])
    return rounded(analytics.monthly_trend(recent), 4, "preco")


@query(f"""WITH {_TREND}, v AS (SELECT uf, arg_min(preco, periodo) AS i, arg_max(preco, periodo) AS f, min(preco) AS lo, max(preco) AS hi FROM trend GROUP BY uf),
    w AS (SELECT *, round((f - i) / i * 100, 2) AS p FROM v)
    SELECT uf, round(i, 4) AS inicial, round(f, 4) AS final, round(lo, 4) AS minimo, round(hi, 4) AS maximo, p AS variacao_pct,
           CASE WHEN p > 2 THEN 'ALTA' WHEN p < -2 THEN 'QUEDA' ELSE 'ESTAVEL' END AS tendencia FROM w""")
def q_trend_summary(spark, sf_dir):
    return rounded(analytics.trend_summary(analytics.monthly_trend(category_prices(spark, sf_dir))), 4, "inicial", "final", "minimo", "maximo")


@query(f"""WITH {_TREND}, v AS (SELECT *, first_value(preco) OVER (PARTITION BY uf ORDER BY periodo) AS f FROM trend)
    SELECT uf, periodo, round(preco, 4) AS preco, round((preco - f) / f * 100, 2) AS variacao_pct FROM v""")
def q_trend_variation(spark, sf_dir):
    return rounded(analytics.trend_variation(analytics.monthly_trend(category_prices(spark, sf_dir))), 4, "preco")


@query(f"""WITH {_TREND}, v AS (SELECT *, lag(preco) OVER (PARTITION BY uf ORDER BY periodo) AS f FROM trend)
    SELECT uf, periodo, round(preco, 4) AS preco, coalesce(round((preco - f) / f * 100, 2), 0.0) AS variacao_pct FROM v""")
def q_period_variation(spark, sf_dir):
    return rounded(analytics.period_variation(analytics.monthly_trend(category_prices(spark, sf_dir))), 4, "preco")


_PIVOTED = ("NATION_1", "NATION_2", "NATION_3")


@query(f"""WITH {_TREND} SELECT periodo, {", ".join(f"round(coalesce(max(preco) FILTER (uf = '{u}'), 0), 4) AS {u}" for u in _PIVOTED)} FROM trend GROUP BY periodo""")
def q_pivot_trend(spark, sf_dir):
    return rounded(analytics.pivoted(analytics.monthly_trend(category_prices(spark, sf_dir)), _PIVOTED), 4, *_PIVOTED)


@query(f"WITH {_COMPARED} SELECT uf, round(media, 4) AS media, minimo, maximo, n FROM compared")
def q_state_comparison(spark, sf_dir):
    return rounded(analytics.compare_states(category_prices(spark, sf_dir)), 4, "media")


def state_rank(spark, sf_dir):
    return analytics.ranked(analytics.compare_states(category_prices(spark, sf_dir)))


@query(f"WITH {_RANKED} SELECT uf, round(media, 4) AS media, minimo, maximo, n, CAST(posicao AS INT) AS posicao, diff_media_pct FROM ranked")
def q_state_rank(spark, sf_dir):
    return rounded(state_rank(spark, sf_dir), 4, "media")


@query(f"""WITH {_RANKED}, p AS (SELECT *, round(posicao / count(*) OVER () * 100, 1) AS percentil FROM ranked)
    SELECT uf, CAST(posicao AS INT) AS posicao, percentil, CASE WHEN percentil <= 33 THEN 'BARATO' WHEN percentil <= 66 THEN 'MEDIO' ELSE 'CARO' END AS faixa FROM p""")
def q_benchmark_percentile(spark, sf_dir):
    return analytics.percentile_position(state_rank(spark, sf_dir)).select("uf", "posicao", "percentil", "faixa")


@query(f"""WITH {_COMPARED} SELECT round(avg(media), 4) AS media, round(median(media), 4) AS mediana, round(coalesce(stddev_samp(media), 0), 4) AS desvio,
    arg_min(uf, media) AS mais_barata, arg_max(uf, media) AS mais_cara FROM compared""")
def q_state_stats(spark, sf_dir):
    return analytics.state_statistics(analytics.compare_states(category_prices(spark, sf_dir)))


@query(f"WITH {_RANKED} SELECT uf, round(media, 4) AS preco, CAST(posicao AS INT) AS posicao, diff_media_pct AS diff, round(min(media) OVER (), 4) AS escala_min, round(max(media) OVER (), 4) AS escala_max FROM ranked")
def q_map_prices(spark, sf_dir):
    flat = analytics.map_prices(state_rank(spark, sf_dir)).select(F.explode("ufs").alias("uf", "v"), "escala_min", "escala_max")
    return flat.select("uf", fixed("v.preco", 4).alias("preco"), "v.posicao", "v.diff", fixed("escala_min", 4).alias("escala_min"), fixed("escala_max", 4).alias("escala_max"))


@query(f"""WITH {UNIFIED} SELECT count(*) AS n_precos, count(DISTINCT uf) AS n_ufs, max(data) AS ultima_data, round(count(DISTINCT uf) / 27 * 100, 1) AS cobertura,
    (SELECT count(DISTINCT categoria) FROM a) AS n_categorias FROM unified""")
def q_dashboard_kpis(spark, sf_dir):
    return analytics.kpis(unified(spark, sf_dir), branches(spark, sf_dir)[0])


@query(f"WITH {UNIFIED} SELECT uf, count(*) AS n, round(avg(preco), 2) AS preco_medio, max(data) AS ultima_data FROM unified GROUP BY uf")
def q_kpis_by_state(spark, sf_dir):
    return analytics.kpis_by_state(unified(spark, sf_dir))


@query(f"WITH {PRICES} SELECT categoria, count(*) AS n FROM prices WHERE processado GROUP BY 1 ORDER BY n DESC, categoria LIMIT 5")
def q_top5_categories(spark, sf_dir):
    return analytics.top_categories(prices(spark, sf_dir).where("processado"))


@query(f"""WITH {PRICES}, cats AS (SELECT DISTINCT p_type AS categoria FROM part UNION ALL SELECT 'SEM PRECOS')
    SELECT c.categoria, count(DISTINCT uf) AS n_ufs, count(item_id) AS n_amostras, coalesce(max(data), DATE '2002-01-01') AS ultima_data
    FROM cats c LEFT JOIN prices p ON p.categoria = c.categoria AND NOT p.atipico GROUP BY 1""")
def q_category_catalogue(spark, sf_dir):
    cats = read(spark, sf_dir, "part").select(F.col("p_type").alias("categoria")).distinct().unionAll(spark.sql("SELECT 'SEM PRECOS' AS categoria"))
    return analytics.category_catalogue(cats, prices(spark, sf_dir), ~F.col("atipico"), date(2002, 1, 1))


@query(f"WITH {UNIFIED} SELECT uf, count(*) AS n, max(data) AS ultima_data FROM unified GROUP BY uf")
def q_state_catalogue(spark, sf_dir):
    processed, items = branches(spark, sf_dir)
    return analytics.state_catalogue([processed, facts.without(items, processed, "order_id")]).withColumn("n", F.col("n").cast("long"))


_CUBE = """count(*) AS qtd_referencias, round(avg(preco), 4) AS preco_medio, round(median(preco), 4) AS preco_mediano,
    min(preco) AS preco_min, max(preco) AS preco_max, round(stddev_samp(preco), 4) AS desvio, max(data) AS data_ultima_ref"""


@query(f"WITH {PRICES} SELECT uf, municipio, descricao, {_CUBE} FROM prices WHERE processado GROUP BY 1, 2, 3")
def q_municipal_cube(spark, sf_dir):
    return analytics.municipal_cube(prices(spark, sf_dir).where("processado"))


@query(f"WITH {PRICES} SELECT uf, municipio, descricao, {_CUBE} FROM prices GROUP BY 1, 2, 3")
def q_cube_refresh(spark, sf_dir):
    """The cube over all prices, kept as mergeable counts: the processed ones first, then a delta with the others."""
    every = prices(spark, sf_dir)
    table = StoredTable(spark, new_path(spark, "cube"), cube.STATE, list(cube.CELL))
    for batch, delta in enumerate((every.where("processado"), every.where("NOT processado"))):
        table.merge(batch, cube.state(delta), cube.merged)
    return cube.presented(table.read())


@query(f"WITH {UNIFIED} SELECT item_id, uf, data, descricao, preco FROM unified WHERE descricao ILIKE '%ring%' ORDER BY data DESC NULLS LAST, item_id LIMIT 500")
def q_item_history(spark, sf_dir):
    return facts.history(unified(spark, sf_dir), "RING").select("item_id", "uf", "data", "descricao", "preco")


@query(f"WITH {UNIFIED} SELECT uf, round(avg(preco), 4) AS media, min(preco) AS minimo, max(preco) AS maximo, count(*) AS n FROM unified WHERE descricao ILIKE '%ring%' GROUP BY uf")
def q_item_benchmark(spark, sf_dir):
    return rounded(analytics.compare_states(facts.where(unified(spark, sf_dir), [facts.contains("descricao", "ring")])), 4, "media")


@query(f"""WITH {UNIFIED}, r AS (SELECT avg(preco) OVER (PARTITION BY uf) AS m FROM unified WHERE descricao ILIKE '%ring%')
    SELECT count(*) AS n, round(avg(m), 4) AS media, round(median(m), 4) AS mediana, round(stddev_samp(m), 4) AS desvio FROM r""")
def q_item_benchmark_weighted(spark, sf_dir):
    return analytics.weighted_statistics(facts.where(unified(spark, sf_dir), [facts.contains("descricao", "ring")]))


@query(f"WITH {PRICES} SELECT DISTINCT uf, municipio FROM prices")
def q_distinct_places(spark, sf_dir):
    return prices(spark, sf_dir).select("uf", "municipio").distinct()


@query(f"""WITH {PRICES}, m AS (SELECT categoria, uf, avg(preco) AS m FROM prices WHERE NOT atipico GROUP BY 1, 2)
    SELECT categoria, round(avg(m), 4) AS media, round(median(m), 4) AS mediana, arg_min(uf, m) AS uf_mais_barata, round(min(m), 4) AS menor_preco,
           arg_max(uf, m) AS uf_mais_cara, round(max(m), 4) AS maior_preco, count(*) AS n_ufs FROM m GROUP BY categoria""")
def q_benchmark_summary(spark, sf_dir):
    return analytics.benchmark_summary(prices(spark, sf_dir).where("NOT atipico"))


@query("""WITH t AS (SELECT * FROM (VALUES (1, 'Ring'), (2, 'small ring'), (3, 'WIDGET'), (4, 'ed')) v(ordem, categoria)), n AS (SELECT DISTINCT p_name AS nome FROM part)
    SELECT nome, arg_min(categoria, ordem) AS categoria FROM n LEFT JOIN t ON contains(lower(nome), lower(categoria)) OR contains(lower(categoria), lower(nome)) GROUP BY nome""")
def q_benchmark_lookup(spark, sf_dir):
    table = spark.createDataFrame([(1, "Ring"), (2, "small ring"), (3, "WIDGET"), (4, "ed")], "ordem int, categoria string")
    return analytics.lookup_category(read(spark, sf_dir, "part").select(F.col("p_name").alias("nome")).distinct(), table)


@query(f"""WITH {PRICES}, s AS (SELECT categoria, descricao, count(*) AS n, median(preco) AS preco_mediano, min(item_id) AS f FROM prices WHERE processado GROUP BY 1, 2)
    SELECT categoria, descricao, n, round(preco_mediano, 4) AS preco_mediano FROM s ORDER BY n DESC, f LIMIT 20""")
def q_top_items(spark, sf_dir):
    return rounded(analytics.top_items(prices(spark, sf_dir).where("processado"), 20, "item_id"), 4, "preco_mediano")


@query(f"WITH {PRICES} SELECT uf, count(*) FILTER (NOT atipico) AS com_amostras, count(*) FILTER (atipico) AS sem_amostras FROM prices GROUP BY uf")
def q_coverage_samples(spark, sf_dir):
    return analytics.coverage_of_samples(prices(spark, sf_dir), ~F.col("atipico"))


# --- statistics of groups

_SORTED = f"""{PRICES}, g AS (SELECT categoria, list_sort(list(preco)) AS v, count(*) AS n, avg(preco) AS m, stddev_samp(preco) AS s, var_samp(preco) AS q FROM prices WHERE processado GROUP BY 1),
    h AS (SELECT *, list_aggregate(v[:n // 2], 'median') AS q1, list_aggregate(v[n - n // 2 + 1:], 'median') AS q3 FROM g)"""


def sources(spark, sf_dir):
    return prices(spark, sf_dir).where("processado")


@query(f"""WITH {_SORTED} SELECT categoria, n, round(m, 4) AS media, round(list_aggregate(v, 'median'), 4) AS mediana, round(s, 4) AS desvio, round(q, 4) AS variancia, round(q1, 4) AS q1, round(q3, 4) AS q3,
    round(q3 - q1, 4) AS iqr, v[1] AS minimo, v[n] AS maximo, round(s / m, 4) AS cv FROM h""")
def q_stats_by_category(spark, sf_dir):
    return stats.described(sources(spark, sf_dir), ["categoria"], "preco")


@query(f"WITH {PRICES} SELECT uf, count(*) AS n, {', '.join(f'round(quantile_cont(preco, {p / 100}), 4) AS p{p}' for p in (5, 50, 95))} FROM prices WHERE processado GROUP BY uf")
def q_percentiles(spark, sf_dir):
    return rounded(stats.percentiles(sources(spark, sf_dir), ["uf"], "preco", (5, 50, 95)), 4, "p5", "p50", "p95")


def _flags(low: str, high: str) -> str:
    return f"p.item_id, p.categoria, preco, coalesce(preco < {low} OR preco > {high}, false) AS outlier"


@query(f"WITH {_SORTED} SELECT {_flags('q1 - 1.5 * (q3 - q1)', 'q3 + 1.5 * (q3 - q1)')} FROM prices p JOIN h USING (categoria) WHERE processado")
def q_outliers_iqr(spark, sf_dir):
    return stats.outliers(sources(spark, sf_dir), ["categoria"], "preco", "iqr").select("item_id", "categoria", "preco", "outlier")


@query(f"WITH {PRICES}, g AS (SELECT categoria, quantile_cont(preco, 0.05) AS lo, quantile_cont(preco, 0.95) AS hi FROM prices WHERE processado GROUP BY 1) SELECT {_flags('lo', 'hi')} FROM prices p JOIN g USING (categoria) WHERE processado")
def q_outliers_percentile(spark, sf_dir):
    return stats.outliers(sources(spark, sf_dir), ["categoria"], "preco", "percentil").select("item_id", "categoria", "preco", "outlier")


@query(f"WITH {PRICES}, g AS (SELECT categoria, avg(preco) AS m, stddev_samp(preco) AS s FROM prices WHERE processado GROUP BY 1) SELECT {_flags('m - 2 * s', 'm + 2 * s')} FROM prices p JOIN g USING (categoria) WHERE processado")
def q_outliers_stddev(spark, sf_dir):
    return stats.outliers(sources(spark, sf_dir), ["categoria"], "preco", "desvio").select("item_id", "categoria", "preco", "outlier")


def _reference(group: str, where: str) -> str:
    return f"""r0 AS (SELECT {group} AS k, list_sort(list(preco)) AS v, count(*) AS n FROM prices WHERE {where} GROUP BY 1),
    r1 AS (SELECT k, v, n, list_aggregate(v[:n // 2], 'median') AS q1, list_aggregate(v[n - n // 2 + 1:], 'median') AS q3 FROM r0),
    r2 AS (SELECT k, n AS total, list_filter(v, lambda x: n < 2 OR (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS w, v FROM r1),
    r3 AS (SELECT k, total, CASE WHEN len(w) = 0 THEN v ELSE w END AS w FROM r2),
    r4 AS (SELECT k, total, len(w) AS n, list_aggregate(w, 'median') AS med, list_aggregate(w, 'stddev_samp') / list_aggregate(w, 'avg') AS cv FROM r3),
    ref AS (SELECT k, CASE WHEN n > 1 THEN round(med, 4) ELSE med END AS preco_referencia, CASE WHEN n >= 10 AND round(cv, 4) < CAST(0.3 AS DOUBLE) THEN 'ALTA' WHEN n >= 5 THEN 'MEDIA' WHEN n >= 2 THEN 'BAIXA' ELSE 'INSUFICIENTE' END AS confianca,
            n AS n_amostras, total - n AS n_excluidos, CASE WHEN n > 1 THEN round(cv, 4) END AS cv FROM r4)"""


@query(f"WITH {PRICES}, {_reference('descricao', 'processado')} SELECT k AS descricao, preco_referencia, confianca, n_amostras, n_excluidos, cv FROM ref")
def q_reference_price(spark, sf_dir):
    return stats.reference_price(sources(spark, sf_dir), ["descricao"], "preco")


_ITEM = "concat(uf, '/', descricao, '/', municipio)"


@query(f"WITH {PRICES}, {_reference(_ITEM, 'processado')} SELECT k AS item, preco_referencia, confianca, n_amostras, n_excluidos, cv FROM ref")
def q_reference_confidence(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("item", F.concat_ws("/", "uf", "descricao", "municipio"))
    return stats.reference_price(rows, ["item"], "preco")


@query(f"""WITH {PRICES}, {_reference('unidade', 'processado AND score * 100 >= 30 AND preco > 0')} SELECT k AS unidade, preco_referencia, confianca, n_amostras, n_excluidos,
    (SELECT count(*) FROM prices WHERE processado AND score * 100 >= 30 AND preco > 0 AND unidade = k) AS n FROM ref""")
def q_unit_summary(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("score", F.col("score") * 100)
    return stats.unit_summary(rows).select("unidade", "preco_referencia", "confianca", "n_amostras", "n_excluidos", "n")


@query(f"""WITH {PRICES}, g AS (SELECT uf, descricao, count(*) AS n, round(stddev_samp(preco) / avg(preco), 4) AS cv FROM prices WHERE processado GROUP BY 1, 2)
    SELECT uf, descricao, n, cv, CASE WHEN n < 5 THEN 'desvio' WHEN cv > 0.5 THEN 'iqr' WHEN cv <= CAST(0.3 AS DOUBLE) THEN 'percentil' ELSE 'iqr' END AS metodo,
           CASE WHEN n < 5 THEN '2.0' WHEN cv <= CAST(0.3 AS DOUBLE) THEN '5-95' ELSE '1.5' END AS limite FROM g""")
def q_outlier_calibration(spark, sf_dir):
    return stats.calibration(sources(spark, sf_dir), ["uf", "descricao"], "preco")


@query(f"""WITH {PRICES}, g AS (SELECT uf, descricao, list_sort(list(preco)) AS v, count(*) AS n, round(stddev_samp(preco) / avg(preco), 4) AS cv FROM prices WHERE processado GROUP BY 1, 2),
    h AS (SELECT *, list_aggregate(v[:n // 2], 'median') AS q1, list_aggregate(v[n - n // 2 + 1:], 'median') AS q3 FROM g),
    o AS (SELECT *, len(list_filter(v, lambda x: x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS n_outliers FROM h), p AS (SELECT *, round(n_outliers / n * 100, 2) AS pct_outliers FROM o)
    SELECT uf, descricao, n, n_outliers, pct_outliers, cv,
           CASE WHEN cv < CAST(0.15 AS DOUBLE) AND n >= 10 THEN 'EXCELENTE' WHEN cv < CAST(0.3 AS DOUBLE) AND n >= 5 THEN 'BOM' WHEN n >= 3 THEN 'REGULAR' ELSE 'INSUFICIENTE' END AS nivel,
           CAST((n < 3)::INT + (n < 10)::INT + (pct_outliers > 20)::INT + coalesce((cv > 0.5)::INT, 0) AS INT) AS n_recomendacoes,
           concat_ws('; ', CASE WHEN n < 3 THEN 'Fonte insuficiente para relatório' END, CASE WHEN n < 10 THEN 'Ampliar período de pesquisa' END,
               CASE WHEN pct_outliers > 20 THEN 'Verificar outliers manualmente' END, CASE WHEN cv > 0.5 THEN 'Alta dispersão — verificar compatibilidade das amostras' END) AS recomendacoes FROM p""")
def q_sample_quality(spark, sf_dir):
    out = stats.sample_quality(sources(spark, sf_dir), ["uf", "descricao"], "preco")
    return out.select("uf", "descricao", "n", "n_outliers", "pct_outliers", "cv", "nivel", F.size("recomendacoes").alias("n_recomendacoes"), F.array_join("recomendacoes", "; ").alias("recomendacoes"))


# --- inflation; the series is moved back 300 months, to the years of the orders

_FIRST = (1995, 1)
_IPCA = f"""ipca AS (SELECT 1995 + (i - 1) // 12 AS ano, (i - 1) % 12 + 1 AS mes, v FROM (SELECT unnest({list(inflation.rules.IPCA)}::DOUBLE[]) AS v, generate_subscripts({list(inflation.rules.IPCA)}, 1) AS i)),
    serie AS (SELECT CAST(ano AS INT) AS ano, CAST(mes AS INT) AS mes, CAST(ano * 12 + mes - 1 AS INT) AS m, product(1 + v / 100) OVER (ORDER BY ano, mes ROWS UNBOUNDED PRECEDING) * 100 AS indice,
              (product(1 + v / 100) OVER (PARTITION BY ano ORDER BY mes ROWS UNBOUNDED PRECEDING) - 1) * 100 AS ytd, (product(1 + v / 100) OVER (ORDER BY ano, mes ROWS 11 PRECEDING) - 1) * 100 AS y12 FROM ipca)"""


@query(f"WITH {_IPCA} SELECT ano, mes, round(indice, 6) AS indice, round(ytd, 4) AS acumulado_ano, round(y12, 4) AS acumulado_12m FROM serie")
def q_ipca_series(spark, sf_dir):
    return rounded(rounded(inflation.accumulated(inflation.ipca(spark, _FIRST)), 6, "indice"), 4, "acumulado_ano", "acumulado_12m").select("ano", "mes", "indice", "acumulado_ano", "acumulado_12m")


@query(f"WITH {_IPCA} SELECT CAST(min(ano * 100 + mes) AS INT) AS inicio, CAST(max(ano * 100 + mes) AS INT) AS fim, count(*) AS n_meses FROM serie")
def q_ipca_coverage(spark, sf_dir):
    return inflation.coverage(inflation.ipca(spark, _FIRST))


_TARGET = 2000 * 12 + 11
_FACTOR = f"""{_IPCA}, o AS (SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS m FROM orders),
    s AS (SELECT m, indice FROM serie UNION ALL SELECT min(m) - 1, 100.0 FROM serie),
    f AS (SELECT o_orderkey, o_totalprice, o.m, CASE WHEN o.m = {_TARGET} THEN 1.0 WHEN o.m < {_TARGET} THEN round(t.indice / s.indice, 6) END AS fator
          FROM o JOIN s ON s.m = least(o.m, (SELECT max(m) FROM serie)) CROSS JOIN (SELECT indice FROM s WHERE m = {_TARGET}) t)"""


def _order_months(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_totalprice", inflation.month_number(F.year("o_orderdate"), F.month("o_orderdate")).alias("m"), F.lit(_TARGET).alias("alvo"))


@query(f"WITH {_FACTOR} SELECT DISTINCT m, fator FROM f")
def q_ipca_factor(spark, sf_dir):
    return inflation.factors(_order_months(spark, sf_dir), inflation.ipca(spark, _FIRST), "m", "alvo").select("m", "fator").distinct()


@query(f"WITH {_FACTOR} SELECT o_orderkey, coalesce(fator, 1.0) AS fator, round(o_totalprice * coalesce(fator, 1.0), 2) AS preco_corrigido, round((coalesce(fator, 1.0) - 1) * 100, 2) AS variacao_pct FROM f")
def q_corrected_prices(spark, sf_dir):
    out = inflation.corrected(_order_months(spark, sf_dir), inflation.ipca(spark, _FIRST), "o_totalprice", "m", "alvo")
    return out.select("o_orderkey", "fator", "preco_corrigido", "variacao_pct")


# --- alerts

_MEDIANS = f"{PRICES}, med AS (SELECT descricao, median(preco) AS mediana FROM prices WHERE processado GROUP BY 1), j AS (SELECT p.*, mediana FROM prices p JOIN med USING (descricao) WHERE NOT processado)"


def _against_median(spark, sf_dir):
    every = prices(spark, sf_dir)
    medians = stats.medians(every.where("processado"), ["descricao"], "preco").select("descricao", "mediana")
    return every.where("NOT processado").join(medians, "descricao")


@query(f"WITH {_MEDIANS} SELECT item_id, CASE WHEN preco / mediana > 1.5 THEN 'CRITICO' WHEN preco / mediana > CAST(1.2 AS DOUBLE) THEN 'ATENCAO' ELSE 'OK' END AS status FROM j")
def q_price_alerts_a(spark, sf_dir):
    return _against_median(spark, sf_dir).select("item_id", pricing.ratio_alert("preco", "mediana").alias("status"))


@query(f"""WITH {_MEDIANS} SELECT item_id, round(greatest(preco - mediana, 0), 4) AS unitaria, round(greatest(preco - mediana, 0) * quantidade, 4) AS total, round(greatest(preco - mediana, 0) / preco * 100, 4) AS percentual, preco > mediana AS viavel FROM j""")
def q_saving(spark, sf_dir):
    s = _against_median(spark, sf_dir).select("item_id", pricing.saving("preco", "mediana", "quantidade").alias("s"))
    return rounded(s.select("item_id", "s.unitaria", "s.total", "s.percentual", "s.viavel"), 4, "unitaria", "total", "percentual")


# Every processed price is in the reference. A state with prices has its own median and spread; without spread the percentile goes by the side.
_ALERTS = f"""{PRICES}, refs AS (SELECT categoria, uf, median(preco) AS mediana, stddev_samp(preco) AS dp, count(*) AS n FROM prices WHERE processado GROUP BY 1, 2),
    means AS (SELECT categoria, avg(mediana) AS mediana, avg(dp) AS dp, CAST(sum(n) AS BIGINT) AS n FROM refs GROUP BY 1),
    al AS (SELECT p.item_id, p.categoria, p.uf, preco, coalesce(r.mediana, m.mediana) AS med, CASE WHEN r.n IS NULL THEN m.dp ELSE r.dp END AS dp, coalesce(r.n, m.n) AS n FROM prices p
      LEFT JOIN refs r ON r.categoria = p.categoria AND r.uf = p.uf LEFT JOIN means m ON m.categoria = p.categoria WHERE NOT processado),
    av AS (SELECT *, CASE WHEN med IS NOT NULL THEN round((preco - med) / med * 100, 2) END AS desvio_pct, CASE WHEN dp > 0 THEN (preco - med) / dp END AS z FROM al),
    ap AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM av),
    aq AS (SELECT *, t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) * 0.3989422804014327::DOUBLE * exp(-z * z / 2) AS tail FROM ap),
    alerts AS (SELECT *, CASE WHEN z IS NULL THEN CASE WHEN preco = med THEN 50 WHEN preco > med THEN 99 ELSE 1 END WHEN z < -3 THEN 1 WHEN z > 3 THEN 99 ELSE CAST(greatest(1, least(99, floor(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END * 100))) AS INT) END AS percentil,
      CASE WHEN med IS NULL THEN 'SEM_REFERENCIA' WHEN desvio_pct > 50 THEN 'CRITICO' WHEN desvio_pct > 25 THEN 'ATENCAO' ELSE 'NORMAL' END AS status FROM aq)"""


def _alerted(spark, sf_dir):
    every = prices(spark, sf_dir)
    reference = stats.medians(every.where("processado"), ["categoria", "uf"], "preco")
    return usage.alerts(every.where("NOT processado"), reference)


@query(f"WITH {_ALERTS} SELECT item_id, round(med, 4) AS mediana, n, desvio_pct, CASE WHEN med IS NOT NULL THEN percentil END AS percentil, status FROM alerts")
def q_price_alerts_b(spark, sf_dir):
    return rounded(_alerted(spark, sf_dir).select("item_id", "mediana", "n", "desvio_pct", "percentil", "status"), 4, "mediana")


@query(f"""WITH {_ALERTS} SELECT categoria, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in usage.STATUSES)} FROM alerts WHERE status <> 'SEM_REFERENCIA' GROUP BY 1""")
def q_alert_stats_pivot(spark, sf_dir):
    return usage.alert_statistics(_alerted(spark, sf_dir), "categoria")


@query(f"WITH {_ALERTS} SELECT status, count(*) AS n FROM alerts GROUP BY 1")
def q_alert_report(spark, sf_dir):
    return _alerted(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_ALERTS} SELECT item_id, round(med, 4) AS mediana, n, desvio_pct, CASE WHEN med IS NOT NULL THEN percentil END AS percentil, status FROM alerts")
def q_price_alerts_b_all(spark, sf_dir):
    return rounded(_alerted(spark, sf_dir).select("item_id", "mediana", "n", "desvio_pct", "percentil", "status"), 4, "mediana")


@query(f"""WITH {_ALERTS} SELECT categoria, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in usage.STATUSES)} FROM alerts WHERE status <> 'SEM_REFERENCIA' GROUP BY 1""")
def q_alert_stats_pivot_all(spark, sf_dir):
    return usage.alert_statistics(_alerted(spark, sf_dir), "categoria")


@query(f"WITH {_ALERTS} SELECT status, count(*) AS n FROM alerts GROUP BY 1")
def q_alert_report_all(spark, sf_dir):
    return _alerted(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {PRICES} SELECT item_id, CAST(least(10 + 5 + 5 + CASE tipo_objeto WHEN 'material' THEN 30 WHEN 'servico' THEN 15 ELSE 0 END + CASE WHEN atipico THEN 0 ELSE 20 END + 15 + 10 + CASE WHEN score > CAST(0.8 AS DOUBLE) THEN 5 ELSE 0 END, 100) AS INT) AS pontos FROM prices""")
def q_quality_score(spark, sf_dir):
    kind = F.when(F.col("tipo_objeto") == "material", "homologado").when(F.col("tipo_objeto") == "servico", "ESTIMADO")
    stored = F.when(F.col("atipico"), F.lit("")).otherwise(F.col("item_id"))
    return prices(spark, sf_dir).select("item_id", pricing.quality_score("item_id", "data", "quantidade", kind, stored, stored, "unidade", "categoria", "score").alias("pontos"))


@query(f"""WITH {PRICES}, c AS (SELECT uf, count(*) AS n, count(DISTINCT descricao) AS k FROM prices GROUP BY uf),
    d AS (SELECT *, round(least(n / 1000, 1) * 0.6::DOUBLE + least(k / 50, 1) * 0.4::DOUBLE, 4) AS indice FROM c)
    SELECT uf, n, k, indice, CASE WHEN indice > CAST(0.7 AS DOUBLE) THEN 'ALTO' WHEN indice > CAST(0.4 AS DOUBLE) THEN 'MEDIO' ELSE 'BAIXO' END AS nivel FROM d""")
def q_coverage_index(spark, sf_dir):
    out = prices(spark, sf_dir).groupBy("uf").agg(F.count("*").alias("n"), F.countDistinct("descricao").alias("k"))
    return out.withColumn("indice", pricing.coverage_index("n", "k")).withColumn("nivel", pricing.coverage_level("indice"))
