"""Scalar rules of prices as column expressions: alerts, savings, units, scores, portal links. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lastrum.functions import rules
from lastrum.functions.numbers import fixed


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: Column | str, kind: str = "string") -> Column:
    """Whether a field counts as filled: neither null nor empty nor 0."""
    c = _col(x)
    return F.coalesce(c != "", F.lit(False)) if kind == "string" else F.coalesce(c != 0, F.lit(False)) if kind == "number" else c.isNotNull()


def confidence(score: Column | str) -> Column:
    """ALTA, MEDIA or BAIXA of a score from 0 to 1; a missing score or 0 counts as 0.75."""
    s = F.coalesce(F.nullif(_col(score), F.lit(0.0)), F.lit(0.75))
    return F.when(s >= 0.8, "ALTA").when(s >= 0.5, "MEDIA").otherwise("BAIXA")


def description_or(text: Column | str, other: Column | str) -> Column:
    """The description without its seed mark, else the other text, else a dash."""
    own = F.nullif(F.trim(F.regexp_replace(_col(text), r"(?i)^\[SEED\]\s*", "")), F.lit(""))
    return F.coalesce(own, F.nullif(F.trim(_col(other)), F.lit("")), F.lit("—"))


def listing_link(number: Column | str, base: str) -> Column:
    """Portal link of a listed price: register number, year, and sequence without zeros; on another form the number as it is."""
    n = _col(number)
    last = F.element_at(F.split(n, "-"), -1)
    seq = F.split_part(last, F.lit("/"), F.lit(1)).try_cast("int")
    year = F.split_part(last, F.lit("/"), F.lit(2)).try_cast("int")
    parts = F.concat_ws("/", F.split_part(n, F.lit("-"), F.lit(1)), year.cast("string"), seq.cast("string"))
    return F.concat(F.lit(f"{base}/"), F.when(seq.isNotNull() & year.isNotNull(), parts).otherwise(n))


def history_link(number: Column | str, base: str) -> Column:
    """Portal link of a price in a history: digits of the register, year, and the sequence with six digits; null on another form."""
    n = _col(number)
    last = F.element_at(F.split(n, "-"), -1)
    digits = F.regexp_replace(F.split_part(n, F.lit("-"), F.lit(1)), r"\D", "")
    parts = F.concat_ws("/", digits, F.split_part(last, F.lit("/"), F.lit(2)), F.lpad(F.split_part(last, F.lit("/"), F.lit(1)), 6, "0"))
    return F.when(n.like("%-%/%"), F.concat(F.lit(f"{base}/"), parts))


def ratio_alert(price: Column | str, median: Column | str) -> Column:
    """CRITICO above 1.5 times the median, ATENCAO above 1.2 times, else OK; OK too where the median is not positive."""
    ratio = F.when(_col(median) > 0, _col(price) / _col(median)).otherwise(0.0)
    return F.when(ratio > 1.5, "CRITICO").when(ratio > 1.2, "ATENCAO").otherwise("OK")


def deviation(price: Column | str, median: Column | str) -> Column:
    """Deviation from the median in per cent, 0 where the median is not positive."""
    return F.when(_col(median) > 0, fixed((_col(price) - _col(median)) / _col(median) * 100, 2)).otherwise(0.0)


def deviation_alert(percent: Column | str) -> Column:
    """CRITICO above 50 per cent, ATENCAO above 25, else NORMAL; SEM_REFERENCIA without a figure."""
    p = _col(percent)
    return F.when(p.isNull(), "SEM_REFERENCIA").when(p > 50, "CRITICO").when(p > 25, "ATENCAO").otherwise("NORMAL")


def normal_percentile(price: Column | str, median: Column | str, spread: Column | str) -> Column:
    """Percentile (1 to 99) by the normal distribution, from a polynomial; without spread 1, 50 or 99 by the side."""
    x, m, s = _col(price), _col(median), _col(spread)
    z = F.when(s > 0, (x - m) / s)
    t = 1 / (1 + rules.NORMAL_T * F.abs(z))
    tail = F.lit(0.0)
    for c in reversed(rules.NORMAL_POLY):
        tail = t * (F.lit(c) + tail)
    tail = tail * rules.NORMAL_D * F.exp(-z * z / 2)
    inner = F.greatest(F.lit(1), F.least(F.lit(99), F.floor(F.when(z >= 0, 1 - tail).otherwise(tail) * 100).cast("int")))
    by_side = F.when(x == m, 50).when(x > m, 99).otherwise(1)
    return F.when(m.isNull(), None).when(z.isNull(), by_side).when(z < -3, 1).when(z > 3, 99).otherwise(inner)


def saving(price: Column | str, reference: Column | str, quantity: Column | str) -> Column:
    """A struct (unitaria, total, percentual, viavel) of what buying at the reference would save."""
    x, r, q = _col(price), _col(reference), _col(quantity)
    unit = F.greatest(x - r, F.lit(0.0))
    return F.struct(unit.alias("unitaria"), (unit * q).alias("total"), F.coalesce(F.try_divide(unit, x) * 100, F.lit(0.0)).alias("percentual"), (unit > 0).alias("viavel"))


def unit_kind(unit: Column | str) -> Column:
    """A struct (grandeza, fator, base) of a measurable unit, or null."""
    entries = [x for u, (kind, factor) in rules.UNIT_FACTORS.items() for x in (F.lit(u), F.struct(F.lit(kind).alias("grandeza"), F.lit(factor).alias("fator"), F.lit(rules.BASE_UNITS[kind]).alias("base")))]
    return F.try_element_at(F.create_map(*entries), F.upper(_col(unit)))


def convert(value: Column | str, unit: Column | str, to: Column | str) -> Column:
    a, b = unit_kind(unit), unit_kind(to)
    return F.when(a["grandeza"] == b["grandeza"], _col(value) * a["fator"] / b["fator"])


def compare_prices(price_a: Column | str, unit_a: Column | str, price_b: Column | str, unit_b: Column | str) -> Column:
    """A struct (preco_base_a, preco_base_b, unidade_base, comparavel, razao); null if a unit is unknown. Prices are multiplied
    by the factor, as the rule says."""
    a, b = unit_kind(unit_a), unit_kind(unit_b)
    x, y, same = _col(price_a) * a["fator"], _col(price_b) * b["fator"], a["base"] == b["base"]
    out = F.struct(fixed(x, 6).alias("preco_base_a"), fixed(y, 6).alias("preco_base_b"), F.when(same, a["base"]).alias("unidade_base"), same.alias("comparavel"), F.when(same, fixed(F.try_divide(x, y), 4)).alias("razao"))
    return F.when(a.isNotNull() & b.isNotNull(), out)


def quality_score(url, day, quantity, kind, stored, sha, unit, category, class_score) -> Column:
    """Points from 0 to 100 for how complete, reliable and evidenced a price is; all arguments may be null."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    table = F.create_map(*[F.lit(x) for pair in rules.SOURCE_POINTS.items() for x in pair])
    unit_ok = present(F.trim(_col(unit))) & (F.upper(_col(unit)) != "OUTRO")
    total = (
        points(present(url), 10)
        + points(present(day, "any"), 5)
        + points(present(quantity, "number"), 5)
        + F.coalesce(F.try_element_at(table, F.upper(_col(kind))), F.lit(0))
        + points(present(stored), 10)
        + points(present(sha), 10)
        + points(unit_ok, 15)
        + points(present(category, "any"), 10)
        + points(_col(class_score) > 0.8, 5)
    )
    return F.least(total, F.lit(100))


def coverage_index(items: Column | str, categories: Column | str) -> Column:
    """From 0 to 1, by numbers of items (1000 suffice) and categories (50 suffice)."""
    return fixed(F.least(_col(items) / 1000, F.lit(1.0)) * 0.6 + F.least(_col(categories) / 50, F.lit(1.0)) * 0.4, 4)


def coverage_level(index: Column | str) -> Column:
    return F.when(_col(index) > 0.7, "ALTO").when(_col(index) > 0.4, "MEDIO").otherwise("BAIXO")


def best_price(awarded: Column | str, estimated: Column | str) -> Column:
    """A struct (preco, tipo_preco): the awarded price if there is one, else the estimate."""
    a, e = _col(awarded), _col(estimated)
    return F.struct(F.coalesce(a, e).alias("preco"), F.when(a.isNotNull(), "homologado").when(e.isNotNull(), "estimado").alias("tipo_preco"))


def first_awarded(results: Column | str, field: str = "valor") -> Column:
    """The first positive value of an array of results, by position; null without one."""
    return F.get(F.filter(_col(results), lambda r: r[field] > 0), F.lit(0))[field]


def annual_price(monthly: Column | str) -> Column:
    """A year costs ten months."""
    return _col(monthly) * 10


def small_variation(seed: Column | str, year: Column | str, month: Column | str) -> Column:
    """A factor within 5 per cent of 1 that depends on its arguments only."""
    return 1 + (F.pmod(_col(seed) * _col(month) + _col(year), F.lit(11)) - 5) / 100
