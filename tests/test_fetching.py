"""Calls against a server that refuses, breaks off and has nothing: nothing is lost and nothing comes twice."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lastrum.sources import fetching, landing


class Server(BaseHTTPRequestHandler):
    seen: Counter = Counter()
    mended = False

    def do_GET(self):
        path = self.path.strip("/")
        Server.seen[path] += 1
        kind, n = path.split("/")[0], Server.seen[path]
        code = {"busy": 429 if n < 3 else 200, "down": 503 if n < 2 else 200, "dead": 200 if Server.mended else 503, "none": 204, "gone": 404}.get(kind, 200)
        if kind == "cut" and not Server.mended:
            self.connection.close()
            return
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0")
        self.end_headers()
        if code == 200:
            self.wfile.write(b"{no json" if kind == "odd" else json.dumps(self.answer(path)).encode())

    def answer(self, path):
        if path.endswith("/itens"):
            return [{"numeroItem": k, "valorUnitarioEstimado": 10.0 * k} for k in (1, 2)]
        return {"path": path}

    def log_message(self, *args):
        pass


@pytest.fixture
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Server.seen.clear()
    Server.mended = False
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def quick(seconds):
    pass


def test_each_call_has_one_row(spark, base):
    names = [f"{kind}/{k}" for kind in ("good", "busy", "down", "dead", "none", "gone", "cut", "odd") for k in range(3)]
    calls = spark.createDataFrame([(n, f"{base}/{n}") for n in names] + [("good/0", f"{base}/good/0")], "call string, url string")
    answers = fetching.fetch(calls, wait=quick)
    rows = {r["call"]: r for r in answers.collect()}
    assert sorted(rows) == sorted(names) and answers.count() == len(names)
    assert all(json.loads(rows[n]["answer"]) == {"path": n} for n in names if n.split("/")[0] in ("good", "busy", "down"))
    assert all(rows[n]["answer"] is None and rows[n]["error"] is None for n in names if n.startswith("none"))
    said = {n: rows[n]["error"] for n in names if rows[n]["error"]}
    assert {n.split("/")[0] for n in said} == {"dead", "gone", "cut", "odd"} and said["dead/1"] == "HTTP 503" and said["gone/0"] == "HTTP 404"
    assert Server.seen["good/0"] == 1 and Server.seen["busy/1"] == 3 and Server.seen["down/1"] == 2 and Server.seen["gone/1"] == 1
    Server.mended = True
    before = Server.seen.copy()
    again = {r["call"]: r["error"] for r in fetching.resume(calls, answers, wait=quick).collect()}
    assert sorted(again) == sorted(names) and {n.split("/")[0] for n, e in again.items() if e} == {"gone", "odd"}
    assert {n for n in names if Server.seen[n] > before[n]} == set(said)


def test_only_contracts_of_broken_rows_are_called(spark, base):
    contracts = spark.createDataFrame([(f"c{k}", f"{k:014d}", 2024, k) for k in range(6)], "numero_controle string, cnpj string, ano int, sequencial int")
    kinds = {0: ("homologado", None, 5.0), 1: ("homologado", 7.0, 6.0), 2: ("estimado", None, None), 3: ("homologado", None, 4.0)}
    rows = [(f"c{k}", n, e, h, h, t) for k, (t, e, h) in kinds.items() for n in (1, 2)]
    items = spark.createDataFrame(rows, "numero_controle string, numero_item int, valor_estimado double, valor_homologado double, valor_unitario double, tipo_preco string")
    done, failed = fetching.recovered(items, contracts, base, wait=quick)
    got = {(r["numero_controle"], r["numero_item"]): (r["valor_estimado"], r["valor_homologado"], r["valor_unitario"], r["tipo_preco"]) for r in done.collect()}
    assert failed.count() == 0 and sorted(Server.seen) == [f"orgaos/{k:014d}/compras/2024/{k}/itens" for k in (0, 3)]
    assert got == {(f"c{k}", n): (10.0 * n if k in (0, 3) else e, h, h, t) for k, (t, e, h) in kinds.items() for n in (1, 2)}


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        page = int(self.path.rsplit("/")[-1])
        self.send_response(204 if page == 3 or page > 6 else 200)
        self.end_headers()
        if page != 3 and page <= 6:
            self.wfile.write(json.dumps({"data": [{"n": page}], "totalPaginas": 6}).encode())

    def log_message(self, *args):
        pass


@pytest.mark.parametrize(("options", "whole"), [({}, False), ({"pages": "6", "pagesPerTask": "2"}, False), ({"pages": "2"}, True)])
def test_a_missing_page_is_an_error(options, whole):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = landing.ContractReader({"url": f"http://127.0.0.1:{server.server_port}/{{state}}/{{page}}", "states": "SP", **options})
    read = lambda: [row[1] for part in reader.partitions() for row in reader.read(part)]
    if whole:
        assert read() == [1, 2]
    else:
        with pytest.raises(OSError, match="page 3 of SP"):
            read()
    assert list(reader.read(landing.PagePartition("SP", 7, 9))) == []
    server.shutdown()
