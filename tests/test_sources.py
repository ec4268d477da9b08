"""Landed pages, the REST source, sinks, streams, and operators on rows made for them."""

import io
import json
import threading
import urllib.error
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lastrum.operators import facts, inflation, quality, search, usage
from lastrum.plans.domain import prices
from lastrum.sources import landing, sinks
from lastrum.streaming import jobs


def contract(i, uf, situation=2):
    return {"numeroControlePNCP": f"{i:014d}-1-{i:06d}/2024", "anoCompra": 2024, "sequencialCompra": i, "dataPublicacaoPncp": f"2024-0{1 + i % 3}-05T10:00:00", "objetoCompra": "x" * 3000, "situacaoCompraId": situation, "valorTotalEstimado": 10.0, "orgaoEntidade": {"cnpj": "1", "razaoSocial": "O"}, "unidadeOrgao": {"ufSigla": uf, "municipioNome": "M"}}


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "p").mkdir()
    for k in range(2):
        (tmp_path / "p" / f"{k}.json").write_text(json.dumps({"data": [contract(10 * k + i, "SP" if i % 2 else "GO", 1 + i % 2) for i in range(4)], "totalPaginas": 2}))
    (tmp_path / "p" / "bad.json").write_text("{not json")
    (tmp_path / "p" / "empty.json").write_text('{"data": []}')
    return f"file://{tmp_path}/p"


def test_pages(spark, landed):
    pages = landing.read_pages(spark, landed)
    rows = landing.contracts(pages, "sp").collect()
    assert len(rows) == 4 and {r.status for r in rows} == {"homologada"} and all(len(r.objeto) == 2000 and r.valor_total == 10 for r in rows)
    assert landing.contracts(pages).count() == 8 and landing.broken_pages(pages).count() == 1


def test_items(spark, tmp_path):
    rows = [
        {"numeroControlePNCP": "1", "numeroItem": 1, "descricao": "a", "unidadeMedida": "CX", "valorUnitarioEstimado": 5.0, "resultados": [{"valorUnitarioHomologado": 0.0}, {"valorUnitarioHomologado": 4.0}, {"valorUnitarioHomologado": 3.0}]},
        {"numeroControlePNCP": "1", "numeroItem": 2, "descricao": "b", "unidadeMedida": {"nome": "Litro"}, "valorUnitarioEstimado": 6.0},
        {"numeroControlePNCP": "1", "numeroItem": 3},
    ]
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, rows)))
    got = landing.items(spark.read.schema(landing.ITEMS).json(f"file://{tmp_path}/i.json")).orderBy("numero_item").collect()
    assert [(r.valor_unitario, r.tipo_preco, r.unidade) for r in got] == [(4.0, "homologado", "CX"), (6.0, "estimado", "Litro"), (None, "estimado", "UN")]


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        state, page = self.path.strip("/").split("/")
        body = json.dumps({"data": [contract(int(page), state)], "totalPaginas": 3}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_rest_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(landing.ContractSource)
    url = f"http://127.0.0.1:{server.server_port}/{{state}}/{{page}}"
    df = spark.read.format("contracts").option("url", url).option("states", "SP,GO").option("pages", "5").option("pagesPerTask", "2").load()
    got = {(r.uf, r.pagina) for r in df.collect()}
    server.shutdown()
    assert got == {(s, p) for s in ("SP", "GO") for p in (1, 2, 3)}


def test_retries():
    waits, calls = [], []

    class Answer(io.BytesIO):
        status = 200

    def flaky(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError
        return Answer(b'{"a": 1}')

    assert landing.get_json("u", wait=waits.append, open_url=flaky) == {"a": 1} and waits == [1.0, 2.0]

    def gone(url, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    assert landing.get_json("u", wait=waits.append, open_url=gone) is None and len(waits) == 2


def test_sinks(spark, sf_dir, tmp_path):
    some = prices(spark, sf_dir).where("processado AND uf IN ('NATION_1', 'NATION_2')")
    sinks.write_prices_csv(some, f"file://{tmp_path}/csv", rows=50)
    (part,) = (tmp_path / "csv").glob("*.csv")
    lines = part.read_bytes().decode().splitlines()
    assert part.read_bytes().startswith(b"\xef\xbb\xbf") and lines[0].lstrip("﻿") == ";".join(sinks.PRICE_COLUMNS) and len(lines) == 51
    assert all(len(x.split(";")) == len(sinks.PRICE_COLUMNS) and len(x.split(";")[5].split(".")[1]) == 2 for x in lines[1:])
    sinks.write_json(some, f"file://{tmp_path}/json", 10)
    (doc,) = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/json").collect()]
    assert len(doc["precos"]) == 10 and doc["ufs"] == ["NATION_1", "NATION_2"] and doc["total"] == some.count()
    sinks.write_cube(some, f"file://{tmp_path}/cube")
    assert spark.read.parquet(f"file://{tmp_path}/cube").agg(F.sum("qtd_referencias")).first()[0] == some.count()
    for _ in range(2):
        sinks.append_log(spark.range(3), f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 6
    sinks.write_csv(spark.range(2), f"file://{tmp_path}/audit")
    assert spark.read.csv(f"file://{tmp_path}/audit", header=True).columns == ["id"]


def test_incremental_ingestion(spark, landed, tmp_path):
    for n in (8, 9):
        jobs.ingest_pages(spark, landed, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
        got = spark.read.parquet(f"file://{tmp_path}/out")
        assert got.count() == n and {r.mes for r in got.select("mes").distinct().collect()} <= {"2024-01", "2024-02", "2024-03"}
        (tmp_path / "p" / "later.json").write_text(json.dumps({"data": [contract(99, "SP")]}))


def test_streamed_rate_limit_is_that_of_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", start + timedelta(seconds=(i * i * 7) % 600), i) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long").coalesce(1)
    df.write.parquet(f"file://{tmp_path}/in")
    stream = jobs.rate_limit(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), 4, 60)
    q = stream.writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = lambda r: (r.key, r.ts, r.n_janela, r.permitido)
    batch = usage.rate_limited(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "key", "ts", "id", 4, 60)
    assert sorted(map(key, spark.table("limited").collect())) == sorted(map(key, batch.collect())) and batch.where("NOT permitido").count() > 0


def test_union_is_disjoint_and_whole(spark):
    schema = "item_id string, order_id long, categoria string, score double"
    a, b = spark.createDataFrame([("1", 1, "x", 0.9), ("1", 1, "x", 0.9)], schema), spark.createDataFrame([("2", 1, "y", 0.1), ("3", 2, "y", 0.1), ("4", None, "y", None)], schema)
    got = sorted((r.item_id, r.fonte, r.categoria, r.score) for r in facts.unified(a, b).collect())
    assert got == [("1", "A", "x", 0.9)] * 2 + [("3", "B", None, 0.75), ("4", "B", None, 0.75)]


def test_factors_compose(spark):
    index = inflation.ipca(spark)
    rows = [(o, t) for o in range(2018 * 12, 2028 * 12, 7) for t in (2021 * 12, 2024 * 12 + 5, 2030 * 12)]
    got = {(r.o, r.t): r.fator for r in inflation.factors(spark.createDataFrame(rows, "o int, t int"), index, "o", "t").collect()}
    assert all((f is None) == (o > t) for (o, t), f in got.items()) and all(f == 1 for (o, t), f in got.items() if o == t)
    for o in {o for o, _ in got if o < 2021 * 12}:
        assert got[o, 2024 * 12 + 5] == pytest.approx(got[o, 2021 * 12] * got[2021 * 12, 2024 * 12 + 5] if (2021 * 12, 2024 * 12 + 5) in got else got[o, 2024 * 12 + 5], abs=1e-5)


def test_sources_are_consolidated_once(spark):
    a, b = spark.createDataFrame([("k", 2, "a2"), ("k", 1, "a1")], "chave string, seq int, v string"), spark.createDataFrame([("k", 0, "b"), ("l", 0, "b")], "chave string, seq int, v string")
    assert sorted((r.chave, r.v) for r in quality.consolidated([a, b], "chave", "seq").collect()) == [("k", "a1"), ("l", "b")]


def test_sample_and_rest_part_the_rows(spark):
    df = spark.range(500).withColumn("s", F.when(F.col("id") < 400, "big").when(F.col("id") < 499, "mid").otherwise("tiny"))
    sample = quality.stratified(df, "s", "id", 50)
    assert sample.count() <= 50 and sample.where("s = 'tiny'").count() == 1
    assert quality.rest_of_sample(df, sample, "id").count() == 500 - sample.count()


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "papel branco"), (2, None), (3, "")], "id long, text string")
    assert search.tfidf(docs, "id", "text").select("id").distinct().count() == 1
    got = docs.select("id", search.text_score("text", "xx", []).alias("s")).collect()
    assert [r.s for r in got] == [0.0, 0.0, 0.0]  # without words everything matches
    none = docs.where("false").select("id")
    assert search.search_with_fallback(none, docs.select("id"), 4).count() == 3 and search.search_with_fallback(none, docs.select("id"), 3).count() == 0
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([3.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in zero.select(search.cosine("a", "b").alias("c")).collect()] == [0.0, 0.0, 1.0]
