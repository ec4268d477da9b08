"""The price history holds every price, also those midway between two cents."""

from lastrum.functions import text
from lastrum.plans import text_queries


def test_money_rounds_ties_half_up(spark):
    rows = spark.createDataFrame([(0.125,), (0.375,), (1234.565,), (2.675,), (-0.125,), (1.0,)], "x double")
    assert [r[0] for r in rows.select(text.brl("x")).collect()] == ["R$ 0,13", "R$ 0,38", "R$ 1.234,57", "R$ 2,68", "R$ -0,13", "R$ 1,00"]


def test_history_links_keep_every_price(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert text_queries.q_history_links_all(spark, sf_dir).count() == n == text_queries.q_history_links(spark, sf_dir).count()
