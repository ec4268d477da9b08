"""Text rules for item descriptions, as column expressions: cleaning, measures, attributes, synonyms, units, classification, keys.

All run in the JVM, but for nfkc(), the exact Unicode form, which is a pandas UDF. Null texts give null unless a docstring says
otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lastrum.functions import rules
from lastrum.functions.numbers import fixed


#: What stands between words of the search.
SEPARATORS = r"[^\p{L}\p{N}_]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _folds(form: str, ranges: Iterable[range]) -> tuple[dict[str, str], dict[str, str]]:
    """Characters that the form maps to one character, and to several, by their Unicode decomposition."""
    single, several = {}, {}
    for c in (chr(i) for r in ranges for i in r):
        to = unicodedata.normalize(form, c)
        if form == "NFKD":
            to = "".join(x for x in to if not unicodedata.combining(x))
        if to != c and to:
            (single if len(to) == 1 else several)[c] = to
    return single, several


_ACCENTS, _ = _folds("NFKD", [range(0xC0, 0x180)])
_SAME, _LONGER = _folds("NFKC", [range(0xA0, 0xC0), range(0x2002, 0x200B), range(0x2070, 0x2090), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F)])


def nfkc(text: Column | str) -> Column:
    """The exact compatibility form, for texts in any script."""

    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(form, "string")(_col(text))


def compatible(text: Column | str) -> Column:
    """The compatibility form of Latin-1 signs, superscripts, spaces, ligatures and full-width characters, without Python."""
    out = F.translate(_col(text), "".join(_SAME), "".join(_SAME.values()))
    for sign, to in _LONGER.items():
        out = F.replace(out, F.lit(sign), F.lit(to))
    return out


def strip_accents(text: Column | str) -> Column:
    """Latin letters without their accents."""
    one = {k: v for k, v in _ACCENTS.items() if len(v) == 1}
    return F.translate(_col(text), "".join(one), "".join(one.values()))


def _without(text: Column, patterns: Iterable[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, f"(?iU){p}", "")
    return text


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def remove_noise(text: Column | str) -> Column:
    """Without the standing phrases of calls for tender; null and empty give an empty text."""
    return squeeze(_without(F.coalesce(_col(text), F.lit("")), rules.NOISE))


def clean_description(text: Column | str, form=compatible) -> Column:
    """Compatibility form, upper case, no standing phrases, idle punctuation or empty brackets, single spaces; null gives ''."""
    out = _without(F.upper(form(F.coalesce(_col(text), F.lit("")))), rules.NOISE)
    out = F.regexp_replace(out, "[;:!?\"'`´*#@&%$]+", " ")
    return squeeze(F.regexp_replace(out, r"\(\s*\)", ""))


def normalise_numbers(text: Column | str) -> Column:
    """Measures in one spelling: 1.000ml as 1000 ML, 500gr as 500 G; null gives ''."""
    out = F.upper(F.coalesce(_col(text), F.lit("")))
    for pattern, to in rules.NUMBERS:
        out = F.regexp_replace(out, f"(?iU){pattern}", to.replace("\\", "$"))
    return squeeze(out)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", group), F.lit(""))


def attributes(text: Column | str) -> Column:
    """A struct of brand, model, volume, capacity (only without a volume), size, material and packing; absent ones are null."""
    up, of = F.upper(_col(text)), rules.ATTRIBUTES
    measure = lambda p: F.when(_found(up, p, 0).isNotNull(), F.concat_ws(" ", F.regexp_extract(up, f"(?iU){p}", 1), F.regexp_extract(up, f"(?iU){p}", 2)))
    volume = measure(of["volume"])
    sides = [_found(up, of["dimensao"], i) for i in (1, 2, 3, 4)]
    size = F.when(sides[0].isNotNull(), F.concat(F.concat_ws("x", *sides[:3]), F.coalesce(F.concat(F.lit(" "), sides[3]), F.lit(""))))
    pack, alternative = _found(up, of["unidade_embalagem"], 1), _found(up, of["quantidade_embalagem"], 3)
    number = F.when(pack.isNotNull(), _found(up, of["unidade_embalagem"], 2)).otherwise(_found(up, of["quantidade_embalagem"], 1))
    return F.struct(
        F.trim(_found(up, of["marca"], 1)).alias("marca"),
        F.trim(_found(up, of["modelo"], 1)).alias("modelo"),
        volume.alias("volume"),
        F.when(volume.isNull(), measure(of["capacidade"])).alias("capacidade"),
        size.alias("dimensao"),
        _found(up, of["material"], 1).alias("material"),
        F.coalesce(pack, alternative).alias("unidade_embalagem"),
        number.try_cast("int").alias("quantidade_embalagem"),
    )


def description_tokens(cleaned: Column | str) -> Column:
    """Words of more than one character of a cleaned description."""
    return F.filter(F.split(_col(cleaned), " "), lambda t: F.length(t) > 1)


def apply_synonyms(text: Column | str, state: Column | str | None = None) -> Column:
    """Regional words by their standard ones: plain substring replacement, in the order of the table, then those of the state."""
    out = F.trim(F.upper(_col(text)))
    for word, standard in rules.SYNONYMS.items():
        out = F.replace(out, F.lit(word), F.lit(standard))
    if state is None:
        return out
    chosen = F.upper(_col(state))
    by_state = out
    for uf, words in rules.STATE_SYNONYMS.items():
        own = out
        for word, standard in words.items():
            own = F.replace(own, F.lit(word.upper()), F.lit(standard.upper()))
        by_state = F.when(chosen == uf, own).otherwise(by_state)
    return by_state


def normalise_unit(unit: Column | str) -> Column:
    """The canonical unit, or null for an unknown one."""
    key = F.regexp_replace(F.upper(F.trim(_col(unit))), r"\.+$", "")
    table = F.create_map(*[F.lit(x) for pair in rules.UNITS.items() for x in pair])
    # in their compatibility form the signs for square and cubic metres are plain digits, so those spellings meet here
    return F.try_element_at(table, F.translate(key, "²³", "23"))


def normalise_cnpj(number: Column | str) -> Column:
    digits = F.regexp_replace(_col(number), r"\D", "")
    return F.when(F.length(digits) == 14, F.regexp_replace(digits, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"))


def normalise_date(text: Column | str) -> Column:
    """A date from Y-M-D, or from D/M/Y with slashes, hyphens or full stops; null for anything else and for impossible dates."""
    day_first, t = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", F.trim(_col(text))
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t)
    other = F.when(t.rlike(day_first), F.regexp_replace(t, day_first, "$3-$2-$1"))
    return F.try_to_timestamp(F.coalesce(iso, other), F.lit("y-M-d")).cast("date")


def year_month(text: Column | str) -> Column:
    """A struct (ano, mes) from YYYY-MM with anything after it, or null."""
    t = _col(text)
    month = F.regexp_extract(t, r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$", 2).try_cast("int")
    return F.when(month.between(1, 12), F.struct(F.substring(t, 1, 4).try_cast("int").alias("ano"), month.alias("mes")))


def classify(description: Column | str, table=rules.RULES, categories: set[str] | None = None) -> Column:
    """A struct (categoria, score): the first rule that matches, 1.0 for a main term, else 0.8; null without a match.

    With categories, rules of other categories are skipped."""
    up = strip_accents(F.upper(_col(description)))
    out = None
    for pattern, category, exact in table:
        if categories is not None and category not in categories:
            continue
        found = F.struct(F.lit(category).alias("categoria"), F.lit(1.0 if exact else 0.8).alias("score"))
        out = F.when(up.rlike(pattern), found) if out is None else out.when(up.rlike(pattern), found)
    return F.lit(None).cast("struct<categoria:string,score:double>") if out is None else out


def correction(classified: Column) -> Column:
    """What to do about a classification: review by hand, verify, or nothing (null)."""
    return F.when(classified.isNull(), "REVISAO_MANUAL").when(classified["score"] < 0.8, "VERIFICAR")


def catalogue_category(code: Column | str) -> Column:
    """A struct (categoria, confianca) of a catalogue code in any spelling of an integer; null for unknown ones."""
    entries = [x for c, (name, sure) in rules.CATALOGUE.items() for x in (F.lit(c), F.struct(F.lit(name).alias("categoria"), F.lit(sure).alias("confianca")))]
    return F.try_element_at(F.create_map(*entries), F.trim(_col(code)).try_cast("int"))


def object_kind(description: Column | str, works_first: bool = True) -> Column:
    """obra, servico or material; both orders of the first two tests are in use. Null and empty are material."""
    low = F.lower(F.coalesce(_col(description), F.lit("")))
    tests = [(rules.WORKS, "obra"), (rules.SERVICE, "servico")]
    (p, a), (q, b) = tests if works_first else tests[::-1]
    return F.when(low.rlike(p), a).when(low.rlike(q), b).otherwise("material")


def tokens(text: Column | str, stop_words: Iterable[str] = rules.STOP_WORDS) -> Column:
    """Words for the search: lower case, no accents, no stop words; repeats stay."""
    words = F.split(strip_accents(F.lower(F.coalesce(_col(text), F.lit("")))), SEPARATORS)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def query_words(query: str, stop_words: Iterable[str] = rules.STOP_WORDS) -> list[str]:
    """tokens() of a query that the caller holds."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return [w for w in re.split(r"\W+", plain) if w and w not in set(stop_words)]


def item_hash(description: Column | str, state: Column | str | None, price: Column | str | None, day: Column | str | None = None) -> Column:
    """SHA-256 of description, state, price with four decimals, and day; without a state and day it is the hash of the content."""
    money = F.lit("") if price is None else F.coalesce(F.format_string("%.4f", _col(price).cast("double")), F.lit(""))
    money = money if price is None else F.when(_col(price).isNull(), "").otherwise(money)
    parts = [F.upper(F.trim(F.coalesce(_col(description), F.lit("")))), *([] if state is None else [F.upper(F.coalesce(_col(state), F.lit("")))]), money]
    if state is not None:
        parts.append(F.lit("") if day is None else F.coalesce(_col(day).cast("string"), F.lit("")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def positive_number(text: Column | str) -> Column:
    """A number above 0 from a text with a decimal comma or point, else null."""
    value = F.replace(F.trim(_col(text)), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value > 0, value)


def control_number(number: Column | str) -> Column:
    """A struct (sequencial, ano) from the part after the last hyphen; null where it has no such form."""
    last = F.element_at(F.split(_col(number), "-"), -1)
    seq, year = F.split_part(last, F.lit("/"), F.lit(1)).try_cast("int"), F.split_part(last, F.lit("/"), F.lit(2)).try_cast("int")
    return F.when(seq.isNotNull() & year.isNotNull(), F.struct(seq.alias("sequencial"), year.alias("ano")))


def truncated(text: Column | str, n: int) -> Column:
    return F.when(F.length(_col(text)) > n, F.concat(F.left(_col(text), F.lit(n - 3)), F.lit("..."))).otherwise(_col(text))


def brl(value: Column | str) -> Column:
    """R$ 1.234,56, rounded half up."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(fixed(_col(value), 2), 2), ",.", ".,"))
