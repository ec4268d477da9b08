"""Queries of the pilot over municipalities, each with its SQL. Items are order lines with the descriptions and units of their parts;
every thirteenth contract has no register, first lines have an estimate of 0 and second lines none."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastrum.functions import rules
from lastrum.operators import pilot
from lastrum.plans.domain import PARTS, described_parts, prices, read
from lastrum.plans.domain import PRICES as _PRICES
from lastrum.plans.price_queries import _reference, rounded
from lastrum.plans.registry import Registry
from lastrum.plans.text_queries import _CLEAN, _UNIT, _classified

registry = Registry()
query = registry.query

#: Last day of the pilot.
UNTIL = "2001-07-31"
_STEPS = f"""{PARTS},
    pc AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS numero_controle, CAST(o_orderdate AS DATE) AS data, n_name AS uf, c_mktsegment AS municipio, o_orderstatus AS s
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{UNTIL}' - INTERVAL {pilot.DAYS} DAY AND DATE '{UNTIL}'),
    pi AS (SELECT numero_controle, l_linenumber AS numero_item, pc.uf, municipio, s, {_CLEAN} AS descricao, {_UNIT} AS unidade,
                  CASE WHEN l_linenumber > 2 THEN l_extendedprice / l_quantity ELSE l_extendedprice END AS preco
           FROM lineitem JOIN pc ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey WHERE texto <> '' AND o_orderkey % 13 <> 0),
    pu AS (SELECT *, strip_accents(upper(descricao)) AS u FROM pi),
    items AS (SELECT *, {_classified(rules.RULES)} FROM pu)"""
_TOP = f"""{_STEPS}, named AS (SELECT * REPLACE (coalesce(categoria, 'Sem Categoria') AS categoria) FROM items),
    counted AS (SELECT uf, municipio, categoria, descricao, count(*) AS ocorrencias, min(row(numero_controle, numero_item)) AS f, median(preco) FILTER (preco > 0) AS preco_mediano FROM named GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY uf, municipio ORDER BY ocorrencias DESC, f, categoria, descricao) AS posicao FROM counted),
    top AS (SELECT * FROM placed WHERE posicao <= {pilot.TOP}),
    prices AS (SELECT named.*, posicao FROM named JOIN top USING (uf, municipio, categoria, descricao) WHERE preco > 0)"""


def _contracts(spark, sf_dir):
    of = lambda name: read(spark, sf_dir, name)
    rows = of("orders").join(of("customer"), F.col("o_custkey") == F.col("c_custkey")).join(of("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(
        F.col("o_orderkey").cast("string").alias("numero_controle"),
        F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("cnpj"),
        F.year("o_orderdate").alias("ano"),
        (F.col("o_orderkey") + 1).alias("sequencial"),
        F.col("o_orderdate").cast("date").alias("data"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("situacao"),
        F.col("n_name").alias("uf"),
        F.col("c_mktsegment").alias("municipio"),
    )
    return pilot.recent(rows, F.lit(UNTIL).cast("date"))


def _items(spark, sf_dir):
    line = F.col("l_linenumber")
    estimate = F.when(line == 1, 0.0).when(line > 2, F.col("l_extendedprice") / F.col("l_quantity"))
    return read(spark, sf_dir, "lineitem").join(described_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("numero_controle"),
        line.alias("numero_item"),
        F.col("texto").alias("descricao"),
        "unidade",
        F.col("l_quantity").alias("quantidade"),
        estimate.alias("valor_estimado"),
        F.col("l_extendedprice").alias("valor_total"),
    )


def _rows(spark, sf_dir):
    return pilot.processed(_contracts(spark, sf_dir), _items(spark, sf_dir))


def _prices(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return pilot.prices_of(rows, pilot.most_frequent(rows))


@query(f"""WITH {_STEPS} SELECT numero_controle, numero_item, uf, municipio, descricao, unidade, categoria, score AS score_classificacao, round(preco, 4) AS preco,
    CAST(20 + CASE WHEN s = 'F' THEN 30 ELSE 15 END + CASE WHEN unidade <> 'OUTRO' THEN 15 ELSE 0 END + CASE WHEN categoria IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN score > CAST(0.8 AS DOUBLE) THEN 5 ELSE 0 END AS INT) AS pontos FROM items""")
def q_pilot_items(spark, sf_dir):
    return rounded(_rows(spark, sf_dir), 4, "preco").drop("data", "original")


@query(f"WITH {_STEPS}, n AS (SELECT uf, municipio, count(*) AS itens FROM items GROUP BY ALL) SELECT uf, municipio, count(*) AS contratacoes, coalesce(max(itens), 0) AS itens FROM pc LEFT JOIN n USING (uf, municipio) GROUP BY ALL")
def q_pilot_totals(spark, sf_dir):
    return pilot.totals(_contracts(spark, sf_dir), _rows(spark, sf_dir))


@query(f"WITH {_TOP} SELECT uf, municipio, categoria, descricao, ocorrencias, CAST(posicao AS INT) AS posicao, round(preco_mediano, 4) AS preco_mediano FROM top")
def q_pilot_top_items(spark, sf_dir):
    return rounded(pilot.top_items(_rows(spark, sf_dir)), 4, "preco_mediano")


_PLACE = "concat(uf, '/', municipio)"


@query(f"""WITH {_TOP}, g AS (SELECT {_PLACE} AS k, list_sort(list(preco)) AS v, count(*) AS n, avg(preco) AS m, stddev_samp(preco) AS s FROM prices GROUP BY 1),
    {_reference(_PLACE, 'true')}
    SELECT k AS local, g.n, round(m, 4) AS media, round(list_aggregate(v, 'median'), 4) AS mediana, round(s, 4) AS desvio, round(v[1], 4) AS minimo, round(v[g.n], 4) AS maximo,
    round(preco_referencia, 4) AS preco_referencia, confianca, n_excluidos FROM g JOIN ref USING (k)""")
def q_pilot_report(spark, sf_dir):
    out = pilot.report(_prices(spark, sf_dir)).withColumn("local", F.concat_ws("/", *pilot.PLACE))
    out = out.select("local", "n", "media", "mediana", "desvio", "minimo", "maximo", "preco_referencia", "confianca", "n_excluidos")
    return rounded(out, 4, "media", "mediana", "minimo", "maximo", "preco_referencia")


@query(f"""WITH {_TOP}, listed AS (SELECT uf, municipio, preco, row_number() OVER (PARTITION BY uf, municipio ORDER BY posicao, numero_controle, numero_item, preco) AS amostra FROM prices)
    SELECT uf, municipio, CAST(amostra AS INT) AS amostra, concat('Prefeitura de ', municipio) AS orgao, round(preco, 4) AS preco, 'HOMOLOGADO' AS qualidade FROM listed WHERE amostra <= {pilot.SAMPLES}""")
def q_pilot_samples(spark, sf_dir):
    return rounded(pilot.samples(_prices(spark, sf_dir)), 4, "preco")


@query(f"""WITH {_PRICES} SELECT uf, categoria, coalesce(bool_or(tipo_objeto = 'material'), false) AS parametro_i, true AS parametro_ii, coalesce(bool_or(tipo_objeto = 'servico' AND atipico), false) AS parametro_iii FROM prices GROUP BY 1, 2""")
def q_report_compliance(spark, sf_dir):
    """Reports by state and category; materials are awarded prices, and unusual prices of services come from an official table."""
    kind = F.when(F.col("tipo_objeto") == "material", "homologado").when((F.col("tipo_objeto") == "servico") & F.col("atipico"), "Tabela oficial")
    return pilot.compliance(prices(spark, sf_dir).withColumn("qualidade", kind), ("uf", "categoria"))
