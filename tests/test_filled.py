"""Fills of nulls in a stored table, and medians of the most frequent items only."""

from lastrum.operators import analytics, quality
from lastrum.sources.stored import StoredTable

SCHEMA = "chave long, tipo string"


def test_only_nulls_are_filled(spark, tmp_path):
    rows = [(i, "obra" if i % 3 == 0 else None) for i in range(200)]
    table = StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, ["chave"], buckets=8)
    table.merge(0, spark.createDataFrame(rows, SCHEMA), lambda old, new: quality.inserted(old, new, ["chave"]))
    before = table.current()["folders"]
    new = spark.createDataFrame([(1, "servico"), (1, "material"), (3, "servico"), (4, None), (999, "obra"), (None, "obra")], SCHEMA)
    fill = lambda old, new: quality.filled(old, new, "chave", "tipo")
    assert table.merge(1, new, fill) == table.merge(1, new, fill) == 2
    after = table.current()["folders"]
    assert dict(table.read().collect()) == dict(rows) | {1: "material"} and table.read().count() == 200
    assert any(before[b] == after[b] for b in before) and before != after
    assert quality.filled(spark.createDataFrame([], SCHEMA), new, "chave", "tipo").count() == 0


def test_top_items_with_nulls_and_without_prices(spark):
    rows = [("c", "a", 1.0, 5), ("c", "a", 3.0, 2), ("c", "a", -9.0, 3), (None, "b", 0.0, 1), (None, "b", None, 4), ("c", None, 7.0, 6), ("d", "z", 1.0, 7)]
    items = spark.createDataFrame(rows, "categoria string, descricao string, preco double, seq long")
    got = [tuple(r) for r in analytics.top_items(items, 3).collect()]
    assert got == [("c", "a", 3, 2.0), ("Sem Categoria", "b", 2, None), ("c", None, 1, 7.0)]
    assert analytics.top_items(items.limit(0)).count() == 0
