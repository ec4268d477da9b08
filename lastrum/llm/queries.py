"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lastrum.llm import decontaminate, exact_dedup, filter_audit, html_text, licenses, manifest, mixing, near_dedup, quality, secrets, toxicity, url_filter, warc
from lastrum.llm.shared import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find(table(spark, sf_dir, "documents")).drop("rid")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.entries(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(table(spark, sf_dir, "documents"), width=3, percent=85).drop("print", "text_hash")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("source", "place", "path")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: A-Z to a-z only, in DuckDB.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FITS = {rule: f"(host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}')" for rule in url_filter.RULES}
_LONGEST = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))

ORACLES = {
    "op8_url_filter": f"""
        WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
        q AS (SELECT *, (host = 'spam-farm.example.com' OR ends_with(host, '.spam-farm.example.com')) AS listed,
                     CASE {" ".join(f"WHEN {_FITS[x]} THEN '{x[1]}{x[2]}'" for x in _LONGEST)} END AS rule,
                     CASE {" ".join(f"WHEN {_FITS[x]} THEN '{x[0]}'" for x in _LONGEST)} END AS said FROM p)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM q
    """,
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
}

ORACLES["op11_filter_audit"] = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        concat(CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
               CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
               CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM d LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (SELECT a.f || b.f || x.f || y.f || z.f AS filter_order FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.f, b.f, x.f, y.f, z.f])) = 5),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, CASE WHEN step > 1 THEN '[' || left(filter_order, step - 1) || ']' ELSE '0' END AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
    r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT regexp_matches(fails, earlier) AND NOT contains(fails, own)), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT regexp_matches(fails, earlier) AND contains(fails, own)), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (regexp_matches(fails, earlier) AND contains(fails, own)), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT regexp_matches(fails, earlier) AND contains(fails, own)), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (NOT regexp_matches(fails, earlier) AND contains(fails, own)), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""



def _written(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _tree(level: str, key: str, levels: int) -> str:
    """Tables {level}1 to {level}{levels} over {level}0(key, p, n, d): a node alone on its level stays as it is."""
    up = f"CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END"
    return ", ".join(f"{level}{k} AS (SELECT {key}, p // 16 AS p, ceil(any_value(n) / 16)::BIGINT AS n, {up} AS d FROM {level}{k - 1} GROUP BY {key}, p // 16)" for k in range(1, levels + 1))


def _fold(level: str, key: str, k: int) -> str:
    """Of a node q at level k: what its parent is with the digest f, and the siblings."""
    run = f"FROM {level}{k} s WHERE s.{key} IS NOT DISTINCT FROM q.{key} AND s.p // 16 = q.p // 16"
    return f"CASE WHEN n = 1 THEN f ELSE sha256(coalesce((SELECT string_agg(s.d, '' ORDER BY s.p) {run} AND s.p < q.p), '') || f || coalesce((SELECT string_agg(s.d, '' ORDER BY s.p) {run} AND s.p > q.p), '')) END AS f, proof || coalesce((SELECT string_agg(s.d, '' ORDER BY s.p) {run} AND s.p <> q.p), '') AS proof"


#: Enough levels for 16 to this power rows of a source, and sources.
_DEEP = 6
_WALK = ", ".join(f"w{k + 1} AS (SELECT doc_id, src, p // 16 AS p, ceil(n / 16)::BIGINT AS n, {_fold('a', 'src', k)} FROM w{k} q)" for k in range(_DEEP))
_WALK_TOP = ", ".join(f"v{k + 1} AS (SELECT doc_id, src, one, p // 16 AS p, ceil(n / 16)::BIGINT AS n, {_fold('b', 'one', k)} FROM v{k} q)" for k in range(_DEEP))
#: The checksum of the decimal id, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::UBIGINT], [0::UBIGINT, 0, 0, 0, 0, 0, 0])))), lambda c, x: xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1))), 4294967295::UBIGINT)"
_HEAD = " || ".join(map(_written, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")))

ORACLES["op12_merkle_manifest"] = f"""
    WITH l AS (SELECT doc_id, source AS src, sha256({_HEAD} || {_written('text')}) AS d, CASE WHEN {_CRC} % 5 = 0 AND text IS NOT NULL THEN sha256({_HEAD} || {_written(LOWER.replace("coalesce(text, '')", "text"))}) END AS forged FROM documents),
    t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY src) AS n FROM l),
    a0 AS (SELECT src, p, n, d FROM t0), {_tree('a', 'src', _DEEP)},
    b0 AS (SELECT 0 AS one, src, row_number() OVER (ORDER BY encode(src) NULLS FIRST) - 1 AS p, count(*) OVER () AS n, d FROM a{_DEEP}), {_tree('b', 'one', _DEEP)},
    w0 AS (SELECT doc_id, src, p, n, coalesce(forged, d) AS f, '' AS proof FROM t0), {_WALK},
    v0 AS (SELECT w.doc_id, w.src, 0 AS one, b0.p, b0.n, w.f, w.proof FROM (SELECT *, row_number() OVER () AS k FROM w{_DEEP}) w JOIN b0 ON b0.src IS NOT DISTINCT FROM w.src), {_WALK_TOP}
    SELECT t0.doc_id, t0.d AS leaf, b0.d AS subroot, b{_DEEP}.d AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = b{_DEEP}.d AS verified
    FROM v{_DEEP} v JOIN t0 ON t0.doc_id = v.doc_id JOIN b0 ON b0.src IS NOT DISTINCT FROM t0.src, b{_DEEP}
"""

ORACLES["op13_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), k AS (SELECT *, CASE WHEN strlen(t) >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS keep FROM p),
    r AS (SELECT *, keep IS NOT NULL AND keep IS DISTINCT FROM page_id AS again FROM k)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keep END AS refers_to FROM r
"""

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_near_dedup": op9_near_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc": op13_warc,
}
