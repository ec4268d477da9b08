"""Queries over descriptions and documents: cleaning, classification, units, duplicates, search; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lastrum.functions import pricing, rules, text
from lastrum.functions.numbers import fixed
from lastrum.operators import grams, quality, ranked, search
from lastrum.operators.tables import new_path
from lastrum.plans.domain import PARTS, PRICES, described_parts, prices, quoted, read
from lastrum.plans.price_queries import rounded
from lastrum.plans.registry import Registry
from lastrum.sources.stored import StoredTable

registry = Registry()
query = registry.query


def _all(expression: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expression}, {quoted(pattern)}, {quoted(to)}, 'g')"


def _squeezed(expression: str) -> str:
    return f"trim({_all(expression, chr(92) + 's+', ' ')})"


def _noiseless(expression: str) -> str:
    for p in rules.NOISE:
        expression = _all(expression, f"(?i){p}")
    return expression


_CLEAN = _squeezed(_all(_all(_noiseless("upper(texto)"), "[;:!?\"'`´*#@&%$]+", " "), r"\(\s*\)"))
_NUMBERS = "upper(texto)"
for _pattern, _to in rules.NUMBERS:
    # a unit ends at a word boundary, after which nothing that the look-ahead excludes can follow in these texts
    _NUMBERS = _all(_NUMBERS, f"(?i){_pattern.split('(?!')[0]}", _to)
_UNIT = "CASE regexp_replace(upper(trim(unidade)), '\\.+$', '') " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.UNITS.items()) + " END"


@query(f"WITH {PARTS} SELECT p_partkey, {_CLEAN} AS limpa FROM parts")
def q_clean_text(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.clean_description("texto").alias("limpa"))


@query(f"WITH {PARTS} SELECT p_partkey, {_squeezed(_noiseless('texto'))} AS limpa FROM parts")
def q_noise_removal(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.remove_noise("texto").alias("limpa"))


@query(f"WITH {PARTS} SELECT p_partkey, {_squeezed(_NUMBERS)} AS medidas FROM parts")
def q_number_normalise(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.normalise_numbers("texto").alias("medidas"))


def _got(name: str, group: int) -> str:
    return f"nullif(regexp_extract(upper(texto), {quoted('(?i)' + rules.ATTRIBUTES[name])}, {group}), '')"


def _measure(name: str) -> str:
    return f"{_got(name, 1)} || ' ' || {_got(name, 2)}"


@query(f"""WITH {PARTS} SELECT p_partkey, trim({_got('marca', 1)}) AS marca, trim({_got('modelo', 1)}) AS modelo, {_measure('volume')} AS volume,
    CASE WHEN {_got('volume', 1)} IS NULL THEN {_measure('capacidade')} END AS capacidade,
    {_got('dimensao', 1)} || 'x' || {_got('dimensao', 2)} || coalesce('x' || {_got('dimensao', 3)}, '') || coalesce(' ' || {_got('dimensao', 4)}, '') AS dimensao,
    {_got('material', 1)} AS material, coalesce({_got('unidade_embalagem', 1)}, {_got('quantidade_embalagem', 3)}) AS unidade_embalagem,
    CAST(CASE WHEN {_got('unidade_embalagem', 1)} IS NOT NULL THEN {_got('unidade_embalagem', 2)} ELSE {_got('quantidade_embalagem', 1)} END AS INT) AS quantidade_embalagem FROM parts""")
def q_attributes(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.attributes("texto").alias("a")).select("p_partkey", "a.*")


@query(f"WITH {PARTS}, c AS (SELECT p_partkey, {_squeezed(_NUMBERS.replace('upper(texto)', 'upper(' + _CLEAN + ')'))} AS limpa FROM parts) SELECT p_partkey, limpa, array_to_string(list_filter(string_split(limpa, ' '), lambda t: length(t) > 1), '|') AS palavras FROM c")
def q_full_normalisation(spark, sf_dir):
    rows = described_parts(spark, sf_dir).select("p_partkey", text.normalise_numbers(text.clean_description("texto")).alias("limpa"))
    return rows.select("p_partkey", "limpa", F.array_join(text.description_tokens("limpa"), "|").alias("palavras"))


_SYNONYMS = "trim(upper(texto))"
for _word, _standard in rules.SYNONYMS.items():
    _SYNONYMS = f"replace({_SYNONYMS}, {quoted(_word)}, {quoted(_standard)})"


def _state_synonyms() -> str:
    cases = []
    for uf, words in rules.STATE_SYNONYMS.items():
        out = "s"
        for word, standard in words.items():
            out = f"replace({out}, {quoted(word.upper())}, {quoted(standard.upper())})"
        cases.append(f"WHEN '{uf}' THEN {out}")
    return f"CASE uf {' '.join(cases)} ELSE s END"


@query(f"WITH {PARTS}, g AS (SELECT p_partkey, uf, {_SYNONYMS} AS s FROM parts) SELECT p_partkey, {_state_synonyms()} AS padrao FROM g")
def q_synonyms(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.apply_synonyms("texto", "uf").alias("padrao"))


def _classified(table, categories=None) -> str:
    used = [r for r in table if categories is None or r[1] in categories]
    tests = lambda value: " ".join(f"WHEN regexp_matches(u, {quoted(p)}) THEN {value(c, e)}" for p, c, e in used)
    return f"CASE {tests(lambda c, e: quoted(c))} END AS categoria, CASE {tests(lambda c, e: f'CAST({1.0 if e else 0.8} AS DOUBLE)')} END AS score"


_UP = f"{PARTS}, up AS (SELECT p_partkey, strip_accents(upper(texto)) AS u FROM parts)"


@query(f"WITH {_UP}, c AS (SELECT p_partkey, {_classified(rules.RULES)} FROM up) SELECT *, CASE WHEN categoria IS NULL THEN 'REVISAO_MANUAL' WHEN score < CAST(0.8 AS DOUBLE) THEN 'VERIFICAR' END AS correcao FROM c")
def q_classify(spark, sf_dir):
    rows = described_parts(spark, sf_dir).select("p_partkey", text.classify("texto").alias("c"))
    return rows.select("p_partkey", "c.categoria", "c.score", text.correction(F.col("c")).alias("correcao"))


_KNOWN = {c for _, c, _ in rules.BATCH_RULES} - {"Papel A4", "Cartucho / Toner"}


@query(f"WITH {_UP} SELECT p_partkey, {_classified(rules.BATCH_RULES, _KNOWN)} FROM up")
def q_classify_batch(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.classify("texto", rules.BATCH_RULES, _KNOWN).alias("c")).select("p_partkey", "c.categoria", "c.score")


_KIND = {order: "CASE " + " ".join(f"WHEN regexp_matches(lower(texto), {quoted(p)}) THEN '{k}'" for p, k in tests) + " ELSE 'material' END" for order, tests in {"works": [(rules.WORKS, "obra"), (rules.SERVICE, "servico")], "service": [(rules.SERVICE, "servico"), (rules.WORKS, "obra")]}.items()}


@query(f"WITH {PARTS} SELECT p_partkey, {_KIND['works']} AS coletor, {_KIND['service']} AS migracao FROM parts")
def q_object_type(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.object_kind("texto").alias("coletor"), text.object_kind("texto", works_first=False).alias("migracao"))


_CODES = tuple(str(c) for c in list(rules.CATALOGUE)[::6]) + ("12", "x1", " 19054 ", "")


@query(f"""WITH c AS (SELECT p_partkey, ([{', '.join(map(quoted, _CODES))}])[p_partkey % {len(_CODES)} + 1] AS codigo FROM part), k AS (SELECT * FROM (VALUES {', '.join(f"({c}, {quoted(n)}, {s}::DOUBLE)" for c, (n, s) in rules.CATALOGUE.items())}) v(codigo, categoria, confianca))
    SELECT p_partkey, categoria, confianca FROM c LEFT JOIN k ON k.codigo = TRY_CAST(trim(c.codigo) AS INT)""")
def q_catalog_map(spark, sf_dir):
    code = F.get(F.array(*map(F.lit, _CODES)), F.pmod("p_partkey", F.lit(len(_CODES))).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", text.catalogue_category(code).alias("c")).select("p_partkey", "c.categoria", "c.confianca")


@query(f"WITH {PARTS} SELECT p_partkey, {_UNIT} AS unidade FROM parts")
def q_unit_normalise(spark, sf_dir):
    return described_parts(spark, sf_dir).select("p_partkey", text.normalise_unit("unidade").alias("unidade"))


_FACTORS = f"factors AS (SELECT * FROM (VALUES {', '.join(f'({quoted(u)}, {quoted(k)}, {f}::DOUBLE, {quoted(rules.BASE_UNITS[k])})' for u, (k, f) in rules.UNIT_FACTORS.items())}) v(u, grandeza, fator, base))"
_PAIR = f"{PARTS}, {_FACTORS}, n AS (SELECT p_partkey, {_UNIT} AS a, ['L', 'G', 'M'][p_partkey % 3 + 1] AS b, p_retailprice AS v FROM parts JOIN part USING (p_partkey))"


def _pairs(spark, sf_dir):
    rows = described_parts(spark, sf_dir).join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    return rows.select("p_partkey", text.normalise_unit("unidade").alias("a"), F.get(F.array(F.lit("L"), F.lit("G"), F.lit("M")), F.pmod("p_partkey", F.lit(3)).cast("int")).alias("b"), F.col("p_retailprice").alias("v"))


@query(f"WITH {_PAIR} SELECT p_partkey, round(CASE WHEN x.grandeza = y.grandeza THEN v * x.fator / y.fator END, 6) AS convertido FROM n LEFT JOIN factors x ON x.u = a LEFT JOIN factors y ON y.u = b")
def q_unit_convert(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", fixed(pricing.convert("v", "a", "b"), 6).alias("convertido"))


@query(f"""WITH {_PAIR} SELECT p_partkey, round(v * x.fator, 6) AS preco_base_a, CASE WHEN x.u IS NOT NULL THEN round((v + 1) * y.fator, 6) END AS preco_base_b, CASE WHEN x.base = y.base THEN x.base END AS unidade_base,
    x.base = y.base AS comparavel, CASE WHEN x.base = y.base THEN round(v * x.fator / ((v + 1) * y.fator), 4) END AS razao FROM n LEFT JOIN factors x ON x.u = a LEFT JOIN factors y ON y.u = b""")
def q_unit_compare(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", pricing.compare_prices("v", "a", F.col("v") + 1, "b").alias("c")).select("p_partkey", "c.*")


_CNPJ = "CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 14, '0') WHEN 1 THEN '12.345.678/' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') || '-99' ELSE CAST(c_custkey AS VARCHAR) END"


@query(f"""WITH d AS (SELECT c_custkey, regexp_replace({_CNPJ}, '\\D', '', 'g') AS d FROM customer) SELECT c_custkey,
    CASE WHEN length(d) = 14 THEN substr(d, 1, 2) || '.' || substr(d, 3, 3) || '.' || substr(d, 6, 3) || '/' || substr(d, 9, 4) || '-' || substr(d, 13, 2) END AS cnpj FROM d""")
def q_cnpj(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.lpad(key, 14, "0")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("12.345.678/"), F.lpad(key, 4, "0"), F.lit("-99"))).otherwise(key)
    return read(spark, sf_dir, "customer").select("c_custkey", text.normalise_cnpj(raw).alias("cnpj"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS data, strftime(o_orderdate, '%Y-%m') AS periodo, CAST(date_trunc('month', o_orderdate) AS DATE) AS mes,
    CAST(year(o_orderdate) AS INT) AS ano, CASE WHEN o_orderkey % 2 = 0 THEN CAST(month(o_orderdate) AS INT) END AS mes_numero FROM orders""")
def q_date_parse(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, " yyyy-MM-dd ")).when(k == 2, F.date_format(d, "d.M.yyyy")).when(k == 3, F.lit("31/02/2020")).otherwise("abc")
    month = text.year_month(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM")).otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-13"))))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.normalise_date(raw).alias("data"), F.date_format(d, "yyyy-MM").alias("periodo"), F.trunc(d.cast("date"), "MM").alias("mes"), F.year(d).alias("ano"), month["mes"].alias("mes_numero"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS valor FROM lineitem")
def q_positive_number(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.replace(F.format_string("%.2f", "l_discount"), F.lit("."), F.lit(",")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.positive_number(raw).alias("valor"))


@query(f"WITH {PRICES} SELECT item_id, CAST(split_part(split_part(numero_controle, '-', 3), '/', 1) AS INT) AS sequencial, CAST(year(data) AS INT) AS ano FROM prices")
def q_control_number(spark, sf_dir):
    return prices(spark, sf_dir).select("item_id", text.control_number("numero_controle").alias("n")).select("item_id", "n.sequencial", "n.ano")


@query(f"WITH {PRICES} SELECT item_id, concat('https://portal.example/', split_part(numero_controle, '-', 1), '/', CAST(year(data) AS VARCHAR), '/', split_part(split_part(numero_controle, '-', 3), '/', 1)) AS link, 'R$ ' || translate(format('{{:,.2f}}', round(preco, 2)), ',.', '.,') AS preco, CASE WHEN length(descricao) > 10 THEN left(descricao, 7) || '...' ELSE descricao END AS curta FROM prices")
def q_history_links(spark, sf_dir):
    return _history(prices(spark, sf_dir))


def _history(rows):
    return rows.select("item_id", pricing.history_link("numero_controle", "https://portal.example").alias("link"), text.brl("preco").alias("preco"), text.truncated("descricao", 10).alias("curta"))


@query(f"WITH {PRICES} SELECT item_id, concat('https://portal.example/', split_part(numero_controle, '-', 1), '/', CAST(year(data) AS VARCHAR), '/', split_part(split_part(numero_controle, '-', 3), '/', 1)) AS link, 'R$ ' || translate(format('{{:,.2f}}', round(preco, 2)), ',.', '.,') AS preco, CASE WHEN length(descricao) > 10 THEN left(descricao, 7) || '...' ELSE descricao END AS curta FROM prices")
def q_history_links_all(spark, sf_dir):
    """q_history_links over every price, also those midway between two cents."""
    return _history(prices(spark, sf_dir))


# --- duplicates, sources and samples

_HASHED = f"{PRICES}, h AS (SELECT *, floor(preco / 100) * 100 AS faixa FROM prices WHERE processado)"
_ITEM_HASH = "sha256(concat_ws('|', upper(trim(descricao)), upper(uf), printf('%.4f', faixa), ''))"


def _hashed(spark, sf_dir):
    rows = prices(spark, sf_dir).where("processado").withColumn("faixa", (F.floor(F.col("preco") / 100) * 100).cast("double"))
    return rows.withColumns({"chave": text.item_hash("descricao", "uf", "faixa"), "conteudo": text.item_hash("descricao", None, "faixa")})


@query(f"""WITH {_HASHED}, g AS (SELECT uf, count(*) AS total, count(DISTINCT {_ITEM_HASH}) AS distintos FROM h GROUP BY uf)
    SELECT uf, total, distintos, total - distintos AS duplicados, round((total - distintos) / total * 100, 2) AS taxa, (total - distintos) / total * 100 <= 5 AS dentro_sla FROM g""")
def q_dedup_rate(spark, sf_dir):
    return quality.duplicate_rate(_hashed(spark, sf_dir), "uf", "chave")


@query(f"""WITH {_HASHED}, r AS (SELECT item_id, uf, {_ITEM_HASH} AS chave, row_number() OVER (PARTITION BY {_ITEM_HASH} ORDER BY item_id) AS ocorrencia FROM h)
    SELECT item_id, uf, chave, CAST(ocorrencia AS INT) AS ocorrencia FROM r WHERE ocorrencia > 1 ORDER BY item_id LIMIT 100""")
def q_dedup_suspects(spark, sf_dir):
    return quality.suspects(_hashed(spark, sf_dir), "chave", "item_id").select("item_id", "uf", "chave", "ocorrencia")


@query(f"""WITH {_HASHED} SELECT sha256(concat_ws('|', upper(trim(descricao)), printf('%.4f', faixa))) AS conteudo, array_to_string(list_sort(list(DISTINCT uf)), ',') AS ufs, count(*) AS n, min(item_id) AS exemplo
    FROM h GROUP BY 1 HAVING count(DISTINCT uf) > 1""")
def q_cross_source_dups(spark, sf_dir):
    return quality.shared_content(_hashed(spark, sf_dir), "conteudo", "uf", "item_id", "item_id").select("conteudo", F.array_join("grupos", ",").alias("ufs"), "n", "exemplo")


@query(f"""WITH {PRICES}, u AS (SELECT md5(concat_ws('|', descricao, CAST(data AS VARCHAR), uf)) AS chave, item_id, CASE WHEN processado THEN 0 ELSE 1 END AS src FROM prices),
    r AS (SELECT *, row_number() OVER (PARTITION BY chave ORDER BY src, item_id) AS k FROM u) SELECT chave, item_id FROM r WHERE k = 1""")
def q_consolidate_sources(spark, sf_dir):
    every = prices(spark, sf_dir).withColumn("chave", F.md5(F.concat_ws("|", "descricao", F.col("data").cast("string"), "uf")))
    parts = [every.where(test).select("chave", "item_id") for test in ("processado", "NOT processado")]
    return quality.consolidated(parts, "chave", "item_id")


@query("SELECT coalesce(s_suppkey, c_custkey) AS chave, coalesce(s_name, c_name) AS nome, CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS versao FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def q_upsert_latest(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chave"), F.col("c_name").alias("nome"), F.lit(0).alias("versao"))
    new = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chave"), F.col("s_name").alias("nome"), F.lit(1).alias("versao"))
    return quality.upserted(old, new, "chave", "versao")


@query("SELECT coalesce(s_suppkey, c_custkey) AS chave, coalesce(s_name, c_name) AS nome, CAST(CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS INT) AS versao FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def q_stored_upsert(spark, sf_dir):
    """The same upsert into a stored table, of which the second batch rewrites the buckets of its keys only."""
    rows = lambda name, key, text, version: read(spark, sf_dir, name).select(F.col(key).alias("chave"), F.col(text).alias("nome"), F.lit(version).alias("versao"))
    table = StoredTable(spark, new_path(spark, "buyers"), "chave long, nome string, versao int", ["chave"])
    for batch, new in enumerate((rows("customer", "c_custkey", "c_name", 0), rows("supplier", "s_suppkey", "s_name", 1))):
        table.merge(batch, new, lambda old, new: quality.upserted(old, new, "chave", "versao"))
    return table.read()


@query(f"WITH {PARTS} SELECT p_partkey, CASE WHEN uf = 'BA' THEN 'servico' ELSE {_KIND['works']} END AS tipo FROM parts")
def q_kind_backfill(spark, sf_dir):
    """Kinds of a stored table where they are null: only the buckets that hold such rows are written, and kinds that are there stay."""
    parts = described_parts(spark, sf_dir).select("p_partkey", "texto", F.when(F.col("uf") == "BA", "servico").alias("tipo"))
    table = StoredTable(spark, new_path(spark, "kinds"), parts.schema, ["p_partkey"])
    table.merge(0, parts, lambda old, new: quality.inserted(old, new, ["p_partkey"]))
    missing = table.read().where("tipo IS NULL").select("p_partkey", text.object_kind("texto").alias("tipo"))
    table.merge(1, missing, lambda old, new: quality.filled(old, new, "p_partkey", "tipo"))
    return table.read().select("p_partkey", "tipo")


@query("SELECT s_suppkey AS chave, s_name AS nome FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def q_insert_absent(spark, sf_dir):
    old = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chave"), F.col("s_name").alias("nome"))
    new = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chave"), F.col("c_name").alias("nome"))
    return quality.inserted(old, new.unionAll(new), ["chave"])


_RESULTS = """i AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS e, o_totalprice AS u FROM orders),
    r AS (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS e, CASE WHEN max(l_tax) > CAST(0.04 AS DOUBLE) THEN min(l_extendedprice) END AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    f AS (SELECT i.o_orderkey, coalesce(i.e, r.e) AS valor_estimado, h AS valor_homologado, coalesce(h, u) AS valor_unitario, CASE WHEN h IS NOT NULL THEN 'homologado' ELSE 'estimado' END AS tipo_preco FROM i LEFT JOIN r USING (o_orderkey))"""


def _refilled(spark, sf_dir):
    none = F.lit(None).cast("double")
    items = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("valor_estimado"), none.alias("valor_homologado"), F.col("o_totalprice").alias("valor_unitario"), F.lit("estimado").alias("tipo_preco"))
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    results = lines.agg(F.max("l_extendedprice").alias("valor_estimado"), F.when(F.max("l_tax") > 0.04, F.min("l_extendedprice")).alias("valor_homologado"))
    return quality.refilled(items, results, "o_orderkey")


@query(f"WITH {_RESULTS} SELECT * FROM f")
def q_refill_awarded(spark, sf_dir):
    return _refilled(spark, sf_dir)


@query(f"WITH {_RESULTS} SELECT o_orderkey, coalesce(valor_homologado, valor_estimado) AS preco, CASE WHEN valor_homologado IS NOT NULL THEN 'homologado' WHEN valor_estimado IS NOT NULL THEN 'estimado' END AS tipo_preco FROM f")
def q_best_price(spark, sf_dir):
    return _refilled(spark, sf_dir).select("o_orderkey", pricing.best_price("valor_homologado", "valor_estimado").alias("b")).select("o_orderkey", "b.*")


_CHECKED = f"""{PARTS}, c AS (SELECT *, {_CLEAN} AS limpa FROM parts), g AS (SELECT * REPLACE (limpa AS texto) FROM c), s AS (SELECT *, {_SYNONYMS} AS s FROM g), p AS (SELECT *, {_state_synonyms()} AS padrao FROM s),
    v AS (SELECT p_partkey, uf, (limpa <> '')::INT * 4 + (padrao <> limpa)::INT * 2 + CASE WHEN unidade = '' THEN 1 WHEN {_UNIT} IS NOT NULL THEN 2 ELSE 0 END + (length(limpa) > 5)::INT * 2 AS pontos FROM p)"""


@query(f"WITH {_CHECKED} SELECT p_partkey, pontos, pontos >= 6 AS classificado FROM v")
def q_norm_validation(spark, sf_dir):
    return quality.validated(described_parts(spark, sf_dir), "texto", "uf", "unidade").select("p_partkey", "pontos", "classificado")


@query(f"""WITH {_CHECKED}, q AS (SELECT uf, count(*) AS n, count(*) FILTER (pontos >= 6) AS classificados, round(avg(pontos / 10), 4) AS score_medio FROM v GROUP BY uf)
    SELECT *, round(classificados / n * 100, 2) AS taxa, classificados / n * 100 >= 85 AS dentro_sla FROM q""")
def q_norm_quality(spark, sf_dir):
    return quality.normalisation_quality(quality.validated(described_parts(spark, sf_dir), "texto", "uf", "unidade"), "uf")


@query()
def q_stratified_sample(spark, sf_dir):
    return quality.stratified(read(spark, sf_dir, "part"), "p_type", "p_partkey", 200)


@query(f"WITH {PRICES} SELECT CAST((count(preco) = 0)::INT + (count(DISTINCT categoria) = 0)::INT + (count(DISTINCT uf) = 0)::INT AS INT) AS n_problemas FROM prices")
def q_integrity(spark, sf_dir):
    return quality.integrity(prices(spark, sf_dir)).select(F.size("problemas").alias("n_problemas"))


# --- search

_STOP = ", ".join(map(quoted, rules.STOP_WORDS))


def _tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({column}, ''))), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))"


_TFIDF = f"""t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    idf AS (SELECT term, ln((SELECT count(*) FROM documents) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), raw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
    dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS dw FROM raw),
    qt AS (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark), qf AS (SELECT item_id, term, count(*) AS tf FROM qt GROUP BY 1, 2), qr AS (SELECT item_id, term, tf * idf AS w FROM qf JOIN idf USING (term)),
    qw AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS qw FROM qr),
    scores AS (SELECT item_id, doc_id, least(round(sum(qw * dw), 6), 1.0) AS score FROM dw JOIN qw USING (term) GROUP BY 1, 2)"""


@query(f"WITH {_TFIDF} SELECT doc_id, count(*) AS n_termos, round(sum(dw), 4) AS soma, round(max(dw), 4) AS maior FROM dw GROUP BY doc_id")
def q_tfidf_weights(spark, sf_dir):
    w = search.tfidf(read(spark, sf_dir, "documents"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_termos"), fixed(F.sum("weight"), 4).alias("soma"), fixed(F.max("weight"), 4).alias("maior"))


@query(f"WITH {_TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS posicao FROM scores WHERE score > 0) SELECT item_id, doc_id, score, CAST(posicao AS INT) AS posicao FROM r WHERE posicao <= 5")
def q_semantic_topk(spark, sf_dir):
    scored = search.semantic_scores(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", "text")
    return search.top_k(scored, "item_id", "doc_id", 5)


@query(f"WITH {_TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS posicao FROM scores WHERE score > 0) SELECT item_id, doc_id, score, CAST(posicao AS INT) AS posicao FROM r WHERE posicao <= 20")
def q_ranked_index(spark, sf_dir):
    """The best 20 by an index of blocks, which most postings stay closed in."""
    return ranked.top(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", 20)


#: Texts that are searched for: one that documents hold, and a longer one.
EXACT, PHRASE = "all rights reserved", "all rights reserved by the author"
_WORDS = text.query_words(PHRASE)
_HITS = " + ".join(f"contains(lower(text), {quoted(w)})::INT" for w in _WORDS)


_EXACT = text.query_words(EXACT)
_EXACT_HITS = " + ".join(f"contains(lower(text), {quoted(w)})::INT" for w in _EXACT)


@query(f"SELECT doc_id, round(({_EXACT_HITS}) / {len(_EXACT)}, 4) AS score_relevancia FROM documents WHERE contains(lower(text), {quoted(EXACT)}) OR ({_EXACT_HITS}) = {len(_EXACT)}")
def q_fulltext(spark, sf_dir):
    return search.full_text(read(spark, sf_dir, "documents"), "text", EXACT, _EXACT).select("doc_id", "score_relevancia")


#: Characters of each benchmark item that are searched for.
_HEAD = 40


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, lower(substr(text, 1, {_HEAD})) AS p FROM benchmark), documents WHERE contains(lower(text), p)")
def q_substring_index(spark, sf_dir):
    """Documents that contain the beginning of a benchmark item, by the index of trigrams."""
    index = grams.build(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = grams.search(index, read(spark, sf_dir, "benchmark"), "item_id", F.substring("text", 1, _HEAD))
    return found.select(F.col("pattern").alias("item_id"), F.col("key").alias("doc_id"))


def _semantic(spark, sf_dir):
    one = spark.createDataFrame([(0, PHRASE)], "item_id long, text string")
    scored = search.semantic_scores(one, read(spark, sf_dir, "documents"), "item_id", "doc_id", "text")
    return search.top_k(scored, "item_id", "doc_id", 30)


_HYBRID = f"""{_TFIDF.replace("FROM benchmark", f"FROM (SELECT 0 AS item_id, {quoted(PHRASE)} AS text)")},
    s AS (SELECT doc_id, score AS s FROM scores WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30), x AS (SELECT doc_id, ({_HITS}) / {len(_WORDS)} AS t FROM documents WHERE ({_HITS}) > 0 OR contains(lower(text), {quoted(PHRASE)})),
    h AS (SELECT coalesce(s.doc_id, x.doc_id) AS doc_id, round(coalesce(s, 0) * 0.6::DOUBLE + coalesce(t, 0) * 0.4::DOUBLE, 4) AS score_combinado, round(coalesce(s, 0), 4) AS score_semantica, round(coalesce(t, 0), 4) AS score_textual FROM s FULL JOIN x ON s.doc_id = x.doc_id)"""


@query(f"WITH {_HYBRID} SELECT * FROM h WHERE score_combinado > 0 ORDER BY score_combinado DESC, doc_id LIMIT 10")
def q_hybrid(spark, sf_dir):
    textual = read(spark, sf_dir, "documents").select("doc_id", search.text_score("text", PHRASE, _WORDS, any_word=True).alias("t")).where("t IS NOT NULL")
    both = search.hybrid(_semantic(spark, sf_dir).select("doc_id", F.col("score").alias("s")), textual, "doc_id")
    return both.orderBy(F.col("score_combinado").desc(), "doc_id").limit(10)


@query(f"""WITH {_HYBRID}, e AS (SELECT doc_id FROM documents WHERE contains(lower(text), {quoted(PHRASE)}))
    SELECT doc_id FROM e UNION ALL (SELECT doc_id FROM s WHERE NOT EXISTS (SELECT 1 FROM e) ORDER BY s DESC, doc_id LIMIT 10)""")
def q_search_fallback(spark, sf_dir):
    hits = read(spark, sf_dir, "documents").where(F.lower("text").contains(PHRASE)).select("doc_id")
    best = _semantic(spark, sf_dir).where("posicao <= 10").select("doc_id")
    return search.search_with_fallback(hits, best, len(PHRASE.split()))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
    SELECT vec_id, least(round(list_cosine_similarity(embedding::DOUBLE[], v), 6), 1.0) AS cosseno FROM embeddings, q""")
def q_cosine_embeddings(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    one = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("v"))
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", search.cosine("embedding", "v").alias("cosseno"))  # one row


@query(f"WITH b AS (SELECT item_id, {_tokens('text')} AS w FROM benchmark) SELECT item_id, CAST(len(w) AS INT) AS n, array_to_string(w, ' ') AS palavras FROM b")
def q_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", text.tokens("text").alias("w"))
    return rows.select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("palavras"))


__all__ = ["registry", "rounded"]
