"""Queries over ingestion runs, categories by a bridge, seeds, and completions of the price analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastrum.functions import pricing, rules, text
from lastrum.operators import ingestion, quality, stats, usage
from lastrum.plans.domain import PRICES, described_parts, prices, read
from lastrum.plans.price_queries import _ALERTS, _alerted, sources
from lastrum.plans.registry import Registry
from lastrum.plans.text_queries import _CHECKED, _KNOWN, _UP, _classified

registry = Registry()
query = registry.query

#: End of the run whose lag is asked for.
END = "2001-08-01 05:00:00"
_RUNS = f"""c AS (SELECT o_orderkey, n_name AS uf, o_orderdate AS data FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '2001-07-30'),
    i AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT uf, count(*) AS contratos, CAST(coalesce(sum(n), 0) AS BIGINT) AS itens, max(data) AS data_fim FROM c LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY uf),
    runs AS (SELECT n_name AS uf, coalesce(contratos, 0) AS contratos, coalesce(itens, 0) AS itens, date_diff('second', data_fim, TIMESTAMP '{END}') / 3600 AS atraso_horas FROM nation LEFT JOIN f ON f.uf = n_name)"""


def _runs(spark, sf_dir):
    """The contracts published since 30 July, as a run would have fetched them."""
    of = lambda name: read(spark, sf_dir, name)
    orders = of("orders").where(F.col("o_orderdate") >= F.lit("2001-07-30").cast("timestamp_ntz"))
    contracts = orders.join(of("customer"), F.col("o_custkey") == F.col("c_custkey")).join(of("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    contracts = contracts.select(F.col("o_orderkey").alias("contrato"), F.col("n_name").alias("uf"), F.col("o_orderdate").alias("data"))
    items = of("lineitem").select(F.col("l_orderkey").alias("contrato"))
    return ingestion.runs(contracts, items, of("nation").select(F.col("n_name").alias("uf")), F.lit(END).cast("timestamp_ntz"))


@query(f"WITH {_RUNS} SELECT uf, contratos, itens, round(atraso_horas, 4) AS atraso_horas, coalesce(atraso_horas <= 6, false) AS dentro_sla, contratos > 0 AS sucesso FROM runs")
def q_ingestion_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("uf", "contratos", "itens", pricing.fixed("atraso_horas", 4).alias("atraso_horas"), "dentro_sla", "sucesso")


@query(f"""WITH {_RUNS} SELECT count(*) AS ufs, count(*) FILTER (contratos > 0) AS sucessos, coalesce(string_agg(uf, ',' ORDER BY uf) FILTER (contratos = 0), '') AS falhas,
    CAST(sum(contratos) AS BIGINT) AS contratos, CAST(sum(itens) AS BIGINT) AS itens, coalesce(string_agg(uf, ',' ORDER BY uf) FILTER (contratos > 0 AND atraso_horas > 6), '') AS fora_sla FROM runs""")
def q_ingestion_roll_up(spark, sf_dir):
    return ingestion.roll_up(_runs(spark, sf_dir))


_BRIDGE = """bridge AS (SELECT p_partkey, p_type AS categoria_id, CAST(0.9 AS DOUBLE) AS grau FROM part WHERE p_size % 10 <> 0 UNION ALL SELECT p_partkey, p_brand, CAST(0.6 AS DOUBLE) FROM part WHERE p_size > 25 AND p_size % 10 <> 0),
    categories AS (SELECT DISTINCT p_type AS categoria_id, lower(p_type) AS nome FROM part UNION SELECT DISTINCT p_brand, lower(p_brand) FROM part)"""


def _bridge(spark, sf_dir):
    """Parts have their type as a category and large ones their brand, too; every tenth size has none."""
    part = read(spark, sf_dir, "part").where("p_size % 10 <> 0")
    one = part.select("p_partkey", F.col("p_type").alias("categoria_id"), F.lit(0.9).alias("grau"))
    return one.unionAll(part.where("p_size > 25").select("p_partkey", "p_brand", F.lit(0.6)))


@query(f"WITH {_BRIDGE} SELECT l_orderkey, l_linenumber, b.categoria_id, nome, grau FROM lineitem LEFT JOIN bridge b ON b.p_partkey = l_partkey LEFT JOIN categories c ON c.categoria_id = b.categoria_id")
def q_items_by_category(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("categoria_id")).unionAll(part.select("p_brand")).distinct().withColumn("nome", F.lower("categoria_id"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return ingestion.with_categories(items, _bridge(spark, sf_dir), names, "p_partkey").select("l_orderkey", "l_linenumber", "categoria_id", "nome", "grau")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN s.n_name END, b.n_name) AS uf FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey""")
def q_state_fallback(spark, sf_dir):
    of = lambda name: read(spark, sf_dir, name)
    nation = of("nation")
    own = of("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("da_fonte"))
    buyer = of("orders").join(of("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_name").alias("do_orgao"))
    rows = of("lineitem").join(own, F.col("l_suppkey") == F.col("s_suppkey")).join(buyer, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", ingestion.state_of(F.when(F.col("l_linenumber") % 2 == 0, F.col("da_fonte")), "do_orgao").alias("uf"))


_SEEDED = "seeded AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '[SEED] ' || o_orderpriority WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS objeto FROM orders)"


def _seeded(spark, sf_dir):
    """Contracts of which every seventh is a seed and every eleventh of the others has no text."""
    text_of = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("[SEED] "), "o_orderpriority")).when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text_of.alias("objeto"))


@query(f"WITH {_SEEDED} SELECT o_orderkey, objeto FROM seeded WHERE objeto NOT LIKE '[SEED]%'")
def q_without_seeds(spark, sf_dir):
    return ingestion.without_seeds(_seeded(spark, sf_dir), "objeto")


@query(f"WITH {_SEEDED} SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM seeded WHERE objeto LIKE '[SEED]%')")
def q_seed_deletion(spark, sf_dir):
    doomed = _seeded(spark, sf_dir).where(F.col("objeto").startswith(ingestion.SEED)).select(F.col("o_orderkey").alias("l_orderkey"))
    return ingestion.deleted(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), doomed, "l_orderkey")


@query(f"WITH {_UP}, {_BRIDGE}, c AS (SELECT p_partkey, {_classified(rules.BATCH_RULES, _KNOWN)} FROM up WHERE p_partkey NOT IN (SELECT p_partkey FROM bridge)) SELECT * FROM c WHERE categoria IS NOT NULL")
def q_classify_new_items(spark, sf_dir):
    return ingestion.newly_classified(described_parts(spark, sf_dir), _bridge(spark, sf_dir), "p_partkey", lambda: text.classify("texto", rules.BATCH_RULES, _KNOWN))


@query(f"""WITH {_CHECKED}, q AS (SELECT uf, p_type AS categoria, count(*) AS n, count(*) FILTER (pontos >= 6) AS classificados, round(avg(pontos / 10), 4) AS score_medio FROM v JOIN part USING (p_partkey) GROUP BY 1, 2)
    SELECT *, round(classificados / n * 100, 2) AS taxa, classificados / n * 100 >= 85 AS dentro_sla FROM q""")
def q_norm_quality_by_category(spark, sf_dir):
    rows = described_parts(spark, sf_dir).join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("categoria")), "p_partkey")
    return quality.normalisation_quality(quality.validated(rows, "texto", "uf", "unidade"), "uf", "categoria")


@query(f"WITH {_CHECKED} SELECT p_partkey, uf, pontos FROM v WHERE pontos < 6")
def q_norm_problems(spark, sf_dir):
    return quality.validated(described_parts(spark, sf_dir), "texto", "uf", "unidade").where("NOT classificado").select("p_partkey", "uf", "pontos")


@query(f"""WITH {_ALERTS} SELECT uf, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in usage.STATUSES)} FROM alerts WHERE status <> 'SEM_REFERENCIA' GROUP BY 1""")
def q_alert_stats_by_state(spark, sf_dir):
    return usage.alert_statistics(_alerted(spark, sf_dir), "uf")


@query(f"WITH {PRICES} SELECT coalesce(uf, 'DESCONHECIDA') AS uf, count(*) AS n FROM prices WHERE processado AND score * 100 >= 30 AND preco > 0 GROUP BY 1")
def q_state_counts(spark, sf_dir):
    return stats.state_counts(sources(spark, sf_dir).withColumn("score", F.col("score") * 100))


@query("SELECT o_orderkey, o_totalprice * 10 AS anual, 1 + ((o_custkey * month(o_orderdate) + year(o_orderdate)) % 11 - 5) / 100 AS fator FROM orders")
def q_plan_cost(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", pricing.annual_price("o_totalprice").alias("anual"), pricing.small_variation("o_custkey", F.year("o_orderdate"), F.month("o_orderdate")).alias("fator"))


@query(f"WITH {PRICES} SELECT item_id, data, preco FROM prices WHERE data IS NOT NULL")
def q_series_by_date(spark, sf_dir):
    """Every price with its date, oldest first; a limit of 0 is none."""
    return ingestion.limited(ingestion.dated(prices(spark, sf_dir).select("item_id", "data", "preco")), 0)
