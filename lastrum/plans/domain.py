"""The procurement tables as views over a star schema of orders, and the same views in SQL for the comparison with DuckDB.

Buyers are customers with their nation as state, contracts are orders, items are order lines; the category, description and unit
of an item come from its part. Lines with status F are processed price sources, the others items to be processed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastrum.operators import facts

# Descriptions and units that the text rules are applied to; each part gets one by its number.
DESCRIPTIONS = (
    "Papel A4 75g branco, conforme edital; pacote com 500 folhas",
    "Detergente líquido neutro 500ml MARCA: Ype Verde",
    "ALCOOL GEL 70% 1.000 ml ( ) ou similar",
    "Gasolina comum tipo C",
    "Óleo diesel S10 aditivado!",
    "Caneta esferográfica azul caixa com 50 unidades",
    "Cadeira para escritório giratória MODELO: XJ-900",
    "Serviço de limpeza predial, de acordo com o edital",
    "Cimento 50kg saco",
    "Tubo PVC 100 mm x 6 m  barra",
    "Carne de sol 2kg",
    "Notebook Intel i7 16GB vide edital",
    "Arroz tipo 1 pacote 5 kg VER ANEXO",
    "pavimentacao asfaltica da rua",
    "Locacao de veiculos",
    "",
    "Luva de nitrila 100 UN/CX",
    "Mesa de escritório 1,20 x 0,60 m em MDF",
    "SANGUE bovino e ANGU",
    "Toner HP original 500gr",
)
UNITS = ("UND", "unidade", "Caixa", "LITRO", "quilograma", "PEÇA", "UN.", "XPTO", "", "kg", "Galão", " ml ", "CM")
STATES = ("BA", "PE", "CE", "PA", "RS", "SP", "MG")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its contract, buyer, state and category: a star join whose dimensions Spark broadcasts if they are small."""
    of = lambda name: read(spark, sf_dir, name)
    star = of("lineitem").join(of("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(of("customer"), F.col("o_custkey") == F.col("c_custkey"))
    star = star.join(of("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(of("part"), F.col("l_partkey") == F.col("p_partkey"))
    padded = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return star.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.concat(padded("l_orderkey", 14), F.lit("-1-"), padded("l_linenumber", 6), F.lit("/"), F.year("o_orderdate").cast("string")).alias("numero_controle"),
        F.col("n_name").alias("uf"),
        F.col("c_mktsegment").alias("municipio"),
        F.col("o_orderdate").cast("date").alias("data"),
        F.col("p_type").alias("categoria"),
        F.col("p_name").alias("descricao"),
        F.col("p_brand").alias("unidade"),
        F.col("l_quantity").alias("quantidade"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("preco"),
        F.when(F.col("l_returnflag") == "A", "material").when(F.col("l_returnflag") == "N", "servico").alias("tipo_objeto"),
        (F.col("l_linestatus") == "F").alias("processado"),
        (F.col("l_discount") > 0.08).alias("atipico"),
        (F.col("p_size").cast("double") / 50).alias("score"),
    )


PRICES = """
    prices AS (
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item_id, l_orderkey AS order_id,
               concat(lpad(CAST(l_orderkey AS VARCHAR), 14, '0'), '-1-', lpad(CAST(l_linenumber AS VARCHAR), 6, '0'), '/', CAST(year(o_orderdate) AS VARCHAR)) AS numero_controle,
               n_name AS uf, c_mktsegment AS municipio, CAST(o_orderdate AS DATE) AS data, p_type AS categoria, p_name AS descricao, p_brand AS unidade,
               l_quantity AS quantidade, l_extendedprice / l_quantity AS preco,
               CASE l_returnflag WHEN 'A' THEN 'material' WHEN 'N' THEN 'servico' END AS tipo_objeto,
               l_linestatus = 'F' AS processado, l_discount > CAST(0.08 AS DOUBLE) AS atipico, CAST(p_size AS DOUBLE) / 50 AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

COLUMNS = ("item_id", "order_id", "numero_controle", "uf", "municipio", "data", "categoria", "descricao", "preco", "tipo_objeto", "score")
_LIST = ", ".join(COLUMNS)
UNIFIED = f"""{PRICES},
    a AS (SELECT {_LIST} FROM prices WHERE processado AND NOT atipico),
    b AS (SELECT {_LIST} FROM prices p WHERE NOT processado AND NOT EXISTS (SELECT 1 FROM a WHERE a.order_id = p.order_id)),
    unified AS (SELECT {_LIST}, 'A' AS fonte FROM a UNION ALL
                SELECT {_LIST.replace("categoria", "NULL").replace("score", "0.75")}, 'B' FROM b)"""


def branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Processed sources without atypical ones, and items that are not processed."""
    every = prices(spark, sf_dir)
    return every.where("processado AND NOT atipico").select(*COLUMNS), every.where("NOT processado").select(*COLUMNS)


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price fact in one scan of the items: the contracts with processed sources come from a narrow scan of their lines (every
    line has its contract, buyer, state and part)."""
    lines = read(spark, sf_dir, "lineitem").where((F.col("l_linestatus") == "F") & ~(F.col("l_discount") > 0.08))
    rows = prices(spark, sf_dir).where("NOT processado OR NOT atipico")
    rows = facts.unified_by(rows, F.col("processado"), lines.select(F.col("l_orderkey").alias("order_id")))
    return rows.select(*COLUMNS, "fonte")


def _pick(values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod("p_partkey", F.lit(len(values))).cast("int"))


def described_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, texto, unidade, uf): a description, unit and state for each part."""
    return read(spark, sf_dir, "part").select("p_partkey", _pick(DESCRIPTIONS).alias("texto"), _pick(UNITS).alias("unidade"), _pick(STATES).alias("uf"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_pick(values: tuple[str, ...]) -> str:
    return f"([{', '.join(map(quoted, values))}])[p_partkey % {len(values)} + 1]"


PARTS = f"parts AS (SELECT p_partkey, {_sql_pick(DESCRIPTIONS)} AS texto, {_sql_pick(UNITS)} AS unidade, {_sql_pick(STATES)} AS uf FROM part)"
