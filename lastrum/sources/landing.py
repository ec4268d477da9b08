"""Sources: landed JSON pages of contracts and items, tables by explicit schema, and the REST interface as a Spark data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lastrum.functions.pricing import first_awarded

CONTRACT = """numeroControlePNCP string, anoCompra int, sequencialCompra int, dataPublicacaoPncp string, objetoCompra string,
modalidadeNome string, situacaoCompraId int, valorTotalEstimado double, valorTotalHomologado double,
orgaoEntidade struct<cnpj:string, razaoSocial:string, esferaId:string>, unidadeOrgao struct<ufSigla:string, municipioNome:string>"""
PAGES = f"data array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in CONTRACT.replace(chr(10), ' ').split(', ') if '<' not in f and ':' not in f)},orgaoEntidade:struct<cnpj:string,razaoSocial:string,esferaId:string>,unidadeOrgao:struct<ufSigla:string,municipioNome:string>>>, totalPaginas int, totalRegistros long, _bad string"
ITEMS = "numeroControlePNCP string, numeroItem int, descricao string, unidadeMedida string, valorUnitarioEstimado double, valorTotal double, quantidade double, resultados array<struct<valorUnitarioHomologado:double>>"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; a schema that is given is not inferred from files."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties={k: str(v) for k, v in options.items()})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages. Broken ones are kept with their text in _bad; broken_pages() gives them, contracts() leaves them out."""
    return spark.read.schema(PAGES).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)


def broken_pages(pages: DataFrame) -> DataFrame:
    return pages.where("data IS NULL").select("_bad")


def contracts(pages: DataFrame, state: str | None = None) -> DataFrame:
    """One row per contract, flat. A status of 2 is awarded; its value is the awarded one if there is one."""
    rows = pages.where("data IS NOT NULL").select(F.explode("data").alias("c"))
    out = rows.select(
        F.col("c.numeroControlePNCP").alias("numero_controle"),
        F.col("c.orgaoEntidade.cnpj").alias("cnpj"),
        F.col("c.orgaoEntidade.razaoSocial").alias("razao_social"),
        F.col("c.unidadeOrgao.ufSigla").alias("uf"),
        F.col("c.unidadeOrgao.municipioNome").alias("municipio"),
        F.substring("c.objetoCompra", 1, 2000).alias("objeto"),
        F.col("c.modalidadeNome").alias("modalidade"),
        F.to_date(F.substring("c.dataPublicacaoPncp", 1, 10)).alias("data_publicacao"),
        F.when(F.col("c.situacaoCompraId") == 2, "homologada").otherwise("publicada").alias("status"),
        F.coalesce("c.valorTotalHomologado", "c.valorTotalEstimado").alias("valor_total"),
    )
    return out if state is None else out.where(F.col("uf") == state.upper())


def items(raw: DataFrame) -> DataFrame:
    """Items of landed results: the first positive awarded price replaces the estimate. A unit may be a text or an object."""
    awarded = first_awarded(F.col("resultados"), "valorUnitarioHomologado")
    unit = F.coalesce(F.get_json_object("unidadeMedida", "$.nome"), F.col("unidadeMedida"))
    return raw.select(
        F.col("numeroControlePNCP").alias("numero_controle"),
        F.col("numeroItem").alias("numero_item"),
        F.substring("descricao", 1, 2000).alias("descricao"),
        F.coalesce(F.nullif(unit, F.lit("")), F.lit("UN")).alias("unidade"),
        "quantidade",
        F.col("valorUnitarioEstimado").alias("valor_estimado"),
        awarded.alias("valor_homologado"),
        F.coalesce(awarded, "valorUnitarioEstimado").alias("valor_unitario"),
        F.when(awarded.isNotNull(), "homologado").otherwise("estimado").alias("tipo_preco"),
    )


#: Answers after which a call is made again: too many requests, and faults of the server.
AGAIN = (429, 500, 502, 503, 504)


def get_json(url: str, tries: int = 3, wait: Callable[[float], None] = time.sleep, open_url=urllib.request.urlopen, strict: bool = False):
    """The decoded answer; None for no content and, unless strict, for an HTTP error. Time-outs, broken connections and the answers in
    AGAIN are tried again, after 1, 2, 4 ... seconds or as long as the answer asks; the last fault is raised, and Spark then runs the task
    again."""
    for attempt in range(tries):
        pause = 2.0**attempt
        try:
            with open_url(url, timeout=30) as answer:
                return None if answer.status == 204 else json.loads(answer.read() or "null")
        except urllib.error.HTTPError as fault:
            if fault.code not in AGAIN or attempt == tries - 1:
                if strict:
                    raise
                return None
            asked = (fault.headers or {}).get("Retry-After", "")
            pause = max(pause, float(asked)) if asked.isdecimal() else pause
        except OSError:
            if attempt == tries - 1:
                raise
        wait(pause)
    return None


class PagePartition(InputPartition):
    def __init__(self, state: str, first: int, last: int | None):
        self.state, self.first, self.last = state, first, last


class ContractReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[PagePartition]:
        states = [s for s in self.options.get("states", "").split(",") if s]
        if "pages" not in self.options:
            return [PagePartition(s, 1, None) for s in states]
        pages, each = int(self.options["pages"]), int(self.options.get("pagesPerTask", 10))
        return [PagePartition(s, p, min(pages, p + each - 1)) for s in states for p in range(1, pages + 1, each)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        ask = lambda page: get_json(self.options["url"].format(state=partition.state, page=page, since=self.options.get("since", ""), until=self.options.get("until", "")), strict=True)
        page, total = partition.first, None
        while partition.last is None or page <= partition.last:
            answer = ask(page)
            if answer is None:  # no content: past the end, or a page that is missing
                if total is None and page > 1:
                    total = (ask(1) or {}).get("totalPaginas")
                if page <= (total or 0):
                    raise OSError(f"page {page} of {partition.state} has no content, but there are {total}")
                return
            total = answer.get("totalPaginas") or 0
            if page > total:
                return
            for row in answer.get("data") or []:
                yield partition.state, page, json.dumps(row, ensure_ascii=False)
            page += 1


class ContractSource(DataSource):
    """spark.dataSource.register(ContractSource); spark.read.format("contracts").option("url", "https://host/{state}/{page}")...

    Without the option pages, a task reads all pages of a state, to the last that the answers name; with it, a range of them. A
    page that can't be had fails the task, so a result is never short of a page."""

    @classmethod
    def name(cls) -> str:
        return "contracts"

    def schema(self) -> str:
        return "uf string, pagina int, contrato string"

    def reader(self, schema) -> ContractReader:
        return ContractReader(dict(self.options))
