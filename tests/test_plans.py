"""Each registered query against its SQL in DuckDB over the small tables."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from lastrum.plans import ingestion_queries, pilot_queries, price_queries, text_queries, usage_queries

REGISTRIES = (price_queries.registry, text_queries.registry, usage_queries.registry, ingestion_queries.registry, pilot_queries.registry)
QUERIES = {k: v for r in REGISTRIES for k, v in r.queries.items()}
ORACLES = {k: v for r in REGISTRIES for k, v in r.oracles.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float | Decimal):
        return float(x)
    return x.isoformat() if isinstance(x, date | datetime) else x


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    wanted = duck.execute(ORACLES[name])
    names = sorted(got.columns)
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == names
    kinds = {d[0]: str(d[1]) for d in wanted.description}
    assert {c: KINDS[t] for c, t in got.dtypes} == {c: k if k != "STRING" else "VARCHAR" for c, k in kinds.items()}
    key = lambda row: tuple((v is not None, str(type(v)), v) for v in row)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in wanted.fetchall()), key=key)
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        assert all(same(p, q) for p, q in zip(x, y, strict=True)), (names, x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_have_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_stratified_sample(spark, sf_dir):
    first, again = (QUERIES["q_stratified_sample"](spark, sf_dir).toPandas() for _ in range(2))
    assert len(first) <= 200 and first.p_partkey.is_unique and first.p_type.nunique() == 6 and first.equals(again)
    assert first.p_type.value_counts().between(20, 50).all()
