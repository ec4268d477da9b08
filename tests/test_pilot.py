"""The pilot over municipalities against rows worked out by hand."""

from datetime import date

from pyspark.sql import functions as F

from lastrum.operators import pilot

CONTRACTS = "numero_controle string, cnpj string, ano int, sequencial int, data date, situacao int, uf string, municipio string"
ITEMS = "numero_controle string, numero_item int, descricao string, unidade string, quantidade double, valor_estimado double, valor_total double"


def tables(spark):
    day = date(2024, 3, 31)
    contracts = [
        ("a", "1", 2024, 1, day, 1, "BA", "X"),
        ("b", "1", 2024, 2, date(2024, 1, 1), 2, "BA", "X"),
        ("old", "1", 2023, 3, date(2023, 12, 31), 1, "BA", "X"),
        ("no register", "", 2024, 4, day, 1, "BA", "X"),
        ("no year", "1", 0, 5, day, 1, "BA", "X"),
        ("no place", "1", 2024, 6, day, 1, None, "X"),
        ("empty", "1", 2024, 7, day, 1, "PE", "Y"),
    ]
    items = [
        ("a", 1, "Gasolina comum", "LITRO", 2.0, 5.0, 10.0),
        ("a", 2, "gasolina COMUM!", "litro", 2.0, 0.0, 7.0),
        ("a", 3, "", "UN", 1.0, 1.0, 1.0),
        ("a", 4, None, "UN", 1.0, 1.0, 1.0),
        ("b", 1, "coisa sem regra", "XPTO", None, None, None),
        ("old", 1, "Gasolina comum", "LITRO", 1.0, 99.0, 99.0),
        ("no register", 1, "Gasolina comum", "LITRO", 1.0, 99.0, 99.0),
        ("no year", 1, "Gasolina comum", "LITRO", 1.0, 99.0, 99.0),
        ("no place", 1, "Gasolina comum", "LITRO", 1.0, 99.0, 99.0),
        ("nobody", 1, "Gasolina comum", "LITRO", 1.0, 99.0, 99.0),
    ]
    return pilot.recent(spark.createDataFrame(contracts, CONTRACTS), F.lit("2024-03-31").cast("date")), spark.createDataFrame(items, ITEMS)


def test_items_of_a_municipality(spark):
    contracts, items = tables(spark)
    rows = pilot.processed(contracts, items)
    got = {(r.numero_controle, r.numero_item): r for r in rows.collect()}
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 1)]
    assert [got[k].preco for k in sorted(got)] == [5.0, 7.0, None]
    assert got["a", 1].descricao == got["a", 2].descricao == "GASOLINA COMUM" and got["a", 2].original == "gasolina COMUM!"
    assert got["b", 1].unidade is None and got["b", 1].categoria is None and got["a", 1].unidade == got["a", 2].unidade is not None
    assert got["b", 1].pontos == 10 + 5 + 15 and got["a", 1].pontos >= 10 + 5 + 5 + 30 + 15 + 10
    assert {(r.uf, r.municipio): (r.contratacoes, r.itens) for r in pilot.totals(contracts.where("uf IS NOT NULL"), rows).collect()} == {("BA", "X"): (4, 3), ("PE", "Y"): (1, 0)}


def test_top_items_and_report(spark):
    contracts, items = tables(spark)
    rows = pilot.processed(contracts, items)
    top = {r.posicao: (r.descricao, r.ocorrencias, r.preco_mediano) for r in pilot.top_items(rows).collect()}
    assert top == {1: ("GASOLINA COMUM", 2, 6.0), 2: ("COISA SEM REGRA", 1, None)}
    assert [r.posicao for r in pilot.top_items(rows, 1).collect()] == [1]
    prices = pilot.prices_of(rows, pilot.most_frequent(rows))
    out = pilot.report(prices).collect()
    assert [(r.uf, r.municipio, r.n, r.media, r.preco_referencia, r.confianca, r.n_excluidos) for r in out] == [("BA", "X", 2, 6.0, 6.0, "BAIXA", 0)]
    assert [(r.amostra, r.orgao, r.preco) for r in pilot.samples(prices).orderBy("amostra").collect()] == [(1, "Prefeitura de X", 5.0), (2, "Prefeitura de X", 7.0)]
    assert pilot.samples(prices, 1).count() == 1


def test_empty_pilot(spark):
    contracts, items = tables(spark)
    rows = pilot.processed(contracts.limit(0), items)
    prices = pilot.prices_of(rows, pilot.most_frequent(rows))
    assert pilot.top_items(rows).count() == pilot.report(prices).count() == pilot.compliance(pilot.samples(prices)).count() == 0


def test_compliance(spark):
    rows = spark.createDataFrame([("a", "homologado"), ("a", None), ("b", None), ("c", "Tabela oficial"), ("c", "Preço homologado")], "r string, qualidade string")
    got = {r.r: (r.parametro_i, r.parametro_ii, r.parametro_iii) for r in pilot.compliance(rows, ("r",)).collect()}
    assert got == {"a": (True, True, False), "b": (False, True, False), "c": (True, True, True)}
