"""Every processed price is a reference of the alerts, and prices without one of their state fall back."""

from pyspark.sql import functions as F

from lastrum.operators import usage
from lastrum.plans import price_queries
from lastrum.plans.domain import prices


def test_each_state_is_judged_by_its_own_prices(spark, sf_dir):
    every = prices(spark, sf_dir)
    own = every.where("processado").groupBy("categoria", "uf").agg(F.median("preco").alias("own"))
    got = price_queries.q_price_alerts_b_all(spark, sf_dir).join(every.select("item_id", "categoria", "uf"), "item_id").join(own, ["categoria", "uf"]).toPandas()
    assert got.uf.nunique() == own.select("uf").distinct().count() > 12 and (got.mediana - got.own).abs().max() < 1e-4


def test_fallback_and_no_reference(spark):
    reference = spark.createDataFrame([("a", "X", 10.0, 2.0, 5), ("a", "Y", 30.0, 4.0, 3), ("b", "X", 8.0, None, 1)], "categoria string, uf string, mediana double, dp double, n long")
    items = spark.createDataFrame([(1, "a", "X", 16.0), (2, "a", "Z", 26.0), (3, "c", "X", 5.0), (4, "b", "X", 8.0), (5, "b", "Z", 7.0)], "i int, categoria string, uf string, preco double")
    alerted = usage.alerts(items, reference)
    got = {r.i: (r.mediana, r.n, r.desvio_pct, r.percentil, r.status) for r in alerted.collect()}
    assert got == {1: (10.0, 5, 60.0, 99, "CRITICO"), 2: (20.0, 8, 30.0, 97, "ATENCAO"), 3: (None, None, None, None, "SEM_REFERENCIA"), 4: (8.0, 1, 0.0, 50, "NORMAL"), 5: (8.0, 1, -12.5, 1, "NORMAL")}
    stats = {r.categoria: (r.CRITICO, r.ATENCAO, r.NORMAL) for r in usage.alert_statistics(alerted, "categoria").collect()}
    assert stats == {"a": (1, 1, 0), "b": (0, 0, 2)}
