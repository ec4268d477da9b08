"""Calls to an interface, one for each row of a table: each gives one row, with its answer or its failure.

Tasks make the calls of their rows; the number of parts bounds the calls at a time. A call that stays broken after its tries is a row
with the fault, so that it neither ends the job nor gets lost; resume() makes only the calls that have no answer yet.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.operators.quality import refilled
from lastrum.operators.tables import save
from lastrum.sources.landing import get_json

ANSWERS = "call string, url string, answer string, error string"


def fetch(calls: DataFrame, parts: int = 8, tries: int = 3, wait: Callable[[float], None] = time.sleep, open_url=urllib.request.urlopen) -> DataFrame:
    """ANSWERS for calls(call, url), saved: of each row the answer as JSON, which is null for no content, or the fault.

    A call that the table names twice is made once."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                answer = error = None
                try:
                    found = get_json(url, tries, wait, open_url, strict=True)
                    answer = None if found is None else json.dumps(found, ensure_ascii=False)
                except urllib.error.HTTPError as fault:
                    error = f"HTTP {fault.code}"
                except (OSError, ValueError) as fault:  # no connection, or no JSON
                    error = f"{type(fault).__name__}: {fault}"
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name, url, answer, error)], ["call", "url", "answer", "error"])

    return save(calls.select("call", "url").dropDuplicates(["call"]).repartition(parts, "call").mapInArrow(made, ANSWERS), "answers")


def failures(answers: DataFrame) -> DataFrame:
    return answers.where("error IS NOT NULL").select("call", "url", "error")


def resume(calls: DataFrame, answers: DataFrame, **how) -> DataFrame:
    """answers with those of the calls that have none or a failure made anew: each call has one row."""
    done = answers.where("error IS NULL")
    return done.unionByName(fetch(calls.join(done.select("call"), "call", "left_anti"), **how))


def item_calls(contracts: DataFrame, base: str) -> DataFrame:
    """The calls for the items of contracts(numero_controle, cnpj, ano, sequencial)."""
    return contracts.select(F.col("numero_controle").alias("call"), F.concat(F.lit(f"{base}/orgaos/"), "cnpj", F.lit("/compras/"), F.col("ano").cast("string"), F.lit("/"), F.col("sequencial").cast("string"), F.lit("/itens")).alias("url"))


def recovered(items: DataFrame, contracts: DataFrame, base: str, **how) -> tuple[DataFrame, DataFrame]:
    """Awarded items without an estimate, refilled from their contracts; and the failures. Only those contracts are called.

    items(numero_controle, numero_item, valor_estimado, valor_homologado, valor_unitario, tipo_preco)"""
    broken = items.where("tipo_preco = 'homologado' AND valor_estimado IS NULL").select("numero_controle").distinct()
    answers = fetch(item_calls(contracts.join(broken, "numero_controle", "left_semi"), base), **how)
    got = answers.where("answer IS NOT NULL").select(F.col("call").alias("numero_controle"), F.explode(F.from_json("answer", "array<struct<numeroItem:int,valorUnitarioEstimado:double>>")).alias("i"))
    key = F.concat_ws("#", "numero_controle", "numero_item")
    results = got.select("numero_controle", F.col("i.numeroItem").alias("numero_item"), F.col("i.valorUnitarioEstimado").alias("valor_estimado"), F.lit(None).cast("double").alias("valor_homologado"))
    results = results.withColumn("_key", key).dropDuplicates(["_key"]).select("_key", "valor_estimado", "valor_homologado")
    return refilled(items.withColumn("_key", key), results, "_key").drop("_key"), failures(answers)
