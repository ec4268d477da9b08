"""Scalar rules on single values, with results known beforehand."""

from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lastrum.functions import pricing, text
from lastrum.operators import stats


@pytest.fixture(scope="module")
def of(spark):
    """Evaluates a column over one text."""

    def run(make, value):
        return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]

    return run


@pytest.mark.parametrize("given,wanted", [("25/12/2024", date(2024, 12, 25)), (" 2024-01-15 ", date(2024, 1, 15)), ("05-03-2025", date(2025, 3, 5)), ("01.06.2023", date(2023, 6, 1)), ("", None), ("abc", None), ("31/02/2024", None), (None, None)])
def test_dates(of, given, wanted):
    assert of(text.normalise_date, given) == wanted


@pytest.mark.parametrize("given,wanted", [("12345678000199", "12.345.678/0001-99"), ("12.345.678/0001-99", "12.345.678/0001-99"), ("1234567800019", None), ("123456780001990", None), ("", None), (None, None)])
def test_cnpj(of, given, wanted):
    assert of(text.normalise_cnpj, given) == wanted


@pytest.mark.parametrize("given,wanted", [("UND", "UN"), ("unidade", "UN"), ("Caixa", "CX"), ("LITRO", "L"), ("quilograma", "KG"), ("M²", "M2"), ("PEÇA", "PC"), ("UN.", "UN"), ("XPTO", None), ("", None), (None, None)])
def test_units(of, given, wanted):
    assert of(text.normalise_unit, given) == wanted


@pytest.mark.parametrize("given,wanted", [("papel a4", "PAPEL A4"), ("papel conforme edital", "PAPEL"), ("a; \"b\"  c", "A B C"), ("papel ( ) a4", "PAPEL A4"), ("oﬁcina", "OFICINA"), ("guarda-chuva", "GUARDA-CHUVA"), ("CONFORME ESPECIFICAÇÕES TÉCNICAS", "TÉCNICAS"), (None, ""), ("", "")])
def test_cleaning(of, given, wanted):
    assert of(text.clean_description, given) == wanted
    assert of(lambda x: text.clean_description(x, form=text.nfkc), given) == wanted


@pytest.mark.parametrize(
    "given,wanted",
    [("Papel A4 75g branco", ("Papel A4", 1.0)), ("Detergente líquido neutro 500ml", ("Detergente", 1.0)), ("Alcool gel 70% 500ml", ("Álcool Gel", 1.0)), ("Gasolina comum tipo C", ("Gasolina Comum", 1.0)), ("Diesel S10 aditivado", ("Diesel S10", 1.0)), ("sabão em barra", ("Detergente", 0.8)), ("nada", None), (None, None)],
)
def test_classifier(of, given, wanted):
    got = of(text.classify, given)
    assert (got and tuple(got)) == wanted


def test_classifier_skips_rules_of_absent_categories(of):
    assert of(lambda x: text.classify(x, categories={"Papel A4"}), "detergente e papel a4")["categoria"] == "Papel A4"
    assert of(lambda x: text.classify(x, categories=set()), "papel a4") is None


@pytest.mark.parametrize("given,wanted", [("1.000ml", "1000 ML"), ("500gr", "500 G"), ("2l", "2 L"), ("5mm", "5MM"), ("10cm", "10 CM"), ("3m²", "3M²"), (None, "")])
def test_numbers(of, given, wanted):
    assert of(text.normalise_numbers, given) == wanted


def test_attributes(of):
    got = of(text.attributes, "Álcool MARCA: Start 500ml caixa com 12 plástico 10 x 20 cm")
    assert got.volume == "500 ML" and got.capacidade is None and got.unidade_embalagem == "CAIXA" and got.quantidade_embalagem == 12 and got.material == "PLÁSTICO" and got.dimensao == "10x20 CM"
    assert of(text.attributes, None) == Row(**dict.fromkeys(got.asDict()))


def test_synonyms(of):
    assert of(text.apply_synonyms, " charque ") == "CARNE BOVINA" and of(text.apply_synonyms, "sangue") == "SFUBAE"
    assert of(lambda x: text.apply_synonyms(x, F.lit("ba")), "abara") == "CUZCUZ DE FEIJAO" and of(lambda x: text.apply_synonyms(x, F.lit("SP")), "abara") == "ABARA"


@pytest.mark.parametrize("value,unit,to,wanted", [(500, "ML", "L", 0.5), (2, "L", "ML", 2000.0), (1500, "G", "KG", 1.5), (3, "kg", "G", 3000.0), (1, "L", "KG", None), (1, "CAIXA", "L", None)])
def test_conversion(spark, value, unit, to, wanted):
    got = spark.range(1).select(pricing.convert(F.lit(float(value)), F.lit(unit), F.lit(to)).alias("y")).first()["y"]
    assert got == (wanted if wanted is None else pytest.approx(wanted))


def value(spark, column):
    return spark.range(1).select(column.alias("y")).first()["y"]


def test_alerts(spark):
    lit = F.lit
    assert [value(spark, pricing.ratio_alert(lit(p), lit(100.0))) for p in (200.0, 130.0, 100.0, 80.0)] == ["CRITICO", "ATENCAO", "OK", "OK"]
    assert value(spark, pricing.ratio_alert(lit(5.0), lit(0.0))) == "OK"
    assert [value(spark, pricing.deviation_alert(pricing.deviation(lit(p), lit(24.5)))) for p in (24.0, 32.0, 40.0)] == ["NORMAL", "ATENCAO", "CRITICO"]
    s = value(spark, pricing.saving(lit(150.0), lit(100.0), lit(10.0)))
    assert (s.total, s.viavel) == (500.0, True) and value(spark, pricing.saving(lit(100.0), lit(100.0), lit(10.0))).viavel is False
    assert [value(spark, pricing.normal_percentile(lit(p), lit(10.0), lit(2.0))) for p in (10.0, 3.0, 17.0, 12.0)] == [50, 1, 99, 84]
    assert [value(spark, pricing.normal_percentile(lit(p), lit(10.0), lit(0.0))) for p in (10.0, 3.0, 17.0)] == [50, 1, 99]


def test_scores(spark):
    none, full = [F.lit(None)] * 9, [F.lit("u"), F.lit(date(2024, 1, 1)), F.lit(2.0), F.lit("HOMOLOGADO"), F.lit("s"), F.lit("h"), F.lit("UN"), F.lit(1), F.lit(0.9)]
    assert value(spark, pricing.quality_score(*none)) == 0 and value(spark, pricing.quality_score(*full)) == 100
    assert value(spark, pricing.quality_score(F.lit("u"), *none[1:])) == 10
    assert [value(spark, pricing.quality_score(*none[:3], F.lit(k), *none[4:])) for k in ("tabela_oficial", "ESTIMADO", "MERCADO", "?")] == [25, 15, 10, 0]
    got = [value(spark, pricing.coverage_level(pricing.coverage_index(F.lit(n), F.lit(c)))) for n, c in ((1000, 50), (500, 25), (100, 10))]
    assert got == ["ALTO", "MEDIO", "BAIXO"]


def test_small_rules(of, spark):
    assert of(text.positive_number, " 1,5 ") == 1.5 and of(text.positive_number, "-2") is None and of(text.positive_number, "x") is None
    assert tuple(of(text.control_number, "123-1-000045/2024")) == (45, 2024) and of(text.control_number, "nothing") is None
    assert of(lambda x: pricing.listing_link(x, "p"), "00123-1-000045/2024") == "p/00123/2024/45" and of(lambda x: pricing.listing_link(x, "p"), "odd") == "p/odd"
    assert of(lambda x: pricing.description_or(x, F.lit("obj")), "[SEED] ") == "obj" and of(lambda x: pricing.description_or(x, F.lit(None).cast("string")), None) == "—"
    assert of(lambda x: text.brl(x.cast("double")), "1234.5") == "R$ 1.234,50" and of(lambda x: text.truncated(x, 5), "abcdefg") == "ab..."
    assert tuple(of(text.catalogue_category, " 16884 ")) == ("Papel A4", 0.95) and of(text.catalogue_category, "x") is None
    assert of(text.object_kind, "obra e consultoria") == "obra" and of(lambda x: text.object_kind(x, works_first=False), "obra e consultoria") == "servico" and of(text.object_kind, None) == "material"
    assert of(text.tokens, "Água de Côco, água!") == ["agua", "coco", "agua"] == text.query_words("Água de Côco, água!")
    assert tuple(of(text.year_month, "2024-07-01")) == (2024, 7) and of(text.year_month, "2024-13") is None
    assert [value(spark, pricing.confidence(F.lit(s).cast("double"))) for s in (0.9, 0.0, None, 0.3)] == ["ALTA", "MEDIA", "MEDIA", "BAIXA"]


GROUPS = {"a": [10, 20, 30, 40, 50], "b": [42], "c": list(range(1, 9)), "d": [100] * 4, "e": [10, 20], "f": [10, 11, 12, 13, 14, 15, 100], "g": list(range(1, 101)), "h": [10] * 5 + [50], "i": [-3.5, -3.5, 0, 2], "j": list(range(100, 110))}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(g, float(p)) for g, ps in GROUPS.items() for p in ps] + [("none", None), ("a", None)]
    return spark.createDataFrame(rows, "g string, preco double")


def test_statistics(samples):
    got = {r.g: r for r in stats.described(samples, ["g"], "preco").collect()}
    assert set(got) == set(GROUPS)
    assert (got["a"].n, got["a"].media, got["a"].mediana, got["a"].minimo, got["a"].maximo, got["a"].q1, got["a"].q3) == (5, 30, 30, 10, 50, 15, 45)
    assert (got["b"].mediana, got["b"].desvio, got["b"].q1, got["b"].cv) == (42, None, None, None)
    assert (got["c"].q1, got["c"].q3, got["c"].iqr) == (2.5, 6.5, 4.0) and got["d"].cv == 0.0
    assert got["e"].mediana == 15 and (got["i"].mediana, got["i"].q1, got["i"].q3) == (-1.75, -3.5, 1.0)


def test_outlier_methods(samples):
    flagged = lambda m, g: sorted(r.preco for r in stats.outliers(samples, ["g"], "preco", m).where(f"outlier AND g = '{g}'").collect())
    assert flagged("iqr", "f") == [100] and flagged("iqr", "a") == [] and flagged("desvio", "h") == [50]
    assert flagged("percentil", "g") == [1, 2, 3, 4, 5, 96, 97, 98, 99, 100]
    with pytest.raises(ValueError):
        stats.outliers(samples, ["g"], "preco", "other")


def test_reference_prices(samples):
    got = {r.g: r for r in stats.reference_price(samples, ["g"], "preco").collect()}
    assert [got[g].confianca for g in ("j", "a", "e", "b")] == ["ALTA", "MEDIA", "BAIXA", "INSUFICIENTE"]
    assert (got["f"].preco_referencia, got["f"].n_excluidos) == (12.5, 1)
    methods = {r.g: r.metodo for r in stats.calibration(samples, ["g"], "preco").collect()}
    assert (methods["e"], methods["f"], methods["j"]) == ("desvio", "iqr", "percentil")
    levels = {r.g: r.nivel for r in stats.sample_quality(samples, ["g"], "preco").collect()}
    assert (levels["j"], levels["b"], levels["a"]) == ("EXCELENTE", "INSUFICIENTE", "REGULAR")
