"""Ingestion runs with failures, integrity of incomplete prices, and paging of the REST source."""

from datetime import datetime

import urllib.error

import pytest
from pyspark.sql import functions as F

from lastrum.operators import ingestion, quality
from lastrum.sources import landing


def test_runs_with_failed_and_late_states(spark):
    contracts = spark.createDataFrame([(1, "A", datetime(2024, 1, 1, 10)), (2, "A", datetime(2024, 1, 1, 8)), (3, "B", datetime(2024, 1, 1, 1)), (4, "C", None)], "contrato long, uf string, data timestamp_ntz")
    items = spark.createDataFrame([(1,), (1,), (3,), (9,)], "contrato long")
    states = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "uf string")
    out = ingestion.runs(contracts, items, states, F.lit("2024-01-01 12:30:00").cast("timestamp_ntz"))
    assert {r.uf: (r.contratos, r.itens, r.atraso_horas, r.dentro_sla, r.sucesso) for r in out.collect()} == {"A": (2, 2, 2.5, True, True), "B": (1, 1, 11.5, False, True), "C": (1, 0, None, False, True), "D": (0, 0, None, False, False)}
    assert tuple(ingestion.roll_up(out).first()) == (4, 3, "D", 4, 3, "B,C")
    assert tuple(ingestion.roll_up(out.limit(0)).first()) == (0, 0, "", 0, 0, "")


def test_categories_fan_out_and_null_keys_stay(spark):
    items = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "i int, k int")
    bridge = spark.createDataFrame([(10, "x"), (10, "y")], "k int, categoria_id string")
    names = spark.createDataFrame([("x", "X")], "categoria_id string, nome string")
    got = ingestion.with_categories(items, bridge, names, "k")
    assert sorted((r.i, r.categoria_id or "", r.nome or "") for r in got.collect()) == [(1, "x", "X"), (1, "y", ""), (2, "", ""), (3, "", "")]
    assert sorted(r.i for r in ingestion.deleted(items, items.where("k = 10 OR k IS NULL"), "k").collect()) == [2, 3]


def test_limits(spark):
    rows = spark.createDataFrame([(2, "b"), (1, None), (3, "a")], "i int, data string")
    assert [r.i for r in ingestion.dated(rows).collect()] == [3, 2]
    assert [ingestion.limited(rows, n).count() for n in (None, 0, -1, 2)] == [3, 3, 3, 2]


def test_integrity_names_what_is_missing(spark):
    schema = "preco double, categoria string, uf string"
    of = lambda rows: quality.integrity(spark.createDataFrame(rows, schema)).first()["problemas"]
    assert of([(1.0, "a", "b")]) == [] and of([(1.0, None, "b")]) == ["sem categorias"] and of([]) == ["sem preços", "sem categorias", "sem estados"]


def test_all_pages_by_default(monkeypatch):
    asked = []

    def get_json(url, strict=False):
        page = int(url.rsplit("/", 1)[1])
        asked.append(page)
        if page == 4 and strict and url.startswith("broken"):
            raise urllib.error.HTTPError(url, 500, "no", None, None)
        return {"totalPaginas": 5, "data": [{"n": page}]} if page <= 5 else None

    monkeypatch.setattr(landing, "get_json", get_json)
    reader = landing.ContractReader({"url": "u/{state}/{page}", "states": "A,B"})
    parts = reader.partitions()
    assert [(p.state, p.first, p.last) for p in parts] == [("A", 1, None), ("B", 1, None)]
    assert [r[1] for r in reader.read(parts[0])] == [1, 2, 3, 4, 5] and asked == [1, 2, 3, 4, 5, 6]
    with pytest.raises(urllib.error.HTTPError):
        list(landing.ContractReader({"url": "broken/{state}/{page}", "states": "A"}).read(parts[0]))
