"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def rounded_half_up(sql: str) -> str:
    """The SQL with each round(x, digits) done on a decimal: Spark rounds the written value half up, DuckDB the binary one."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, end, comma = 1, m.end(), None
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        comma = end - 1 if comma is None else comma
        inner = rounded_half_up(sql[m.end() : comma])
        out += sql[at : m.start()] + f"CAST(round(CAST({inner} AS DECIMAL(30, 9)){sql[comma : end - 1]}) AS DOUBLE)"
        at = end
    return out + sql[at:]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under its own name; without SQL its rows are tested otherwise."""

        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = rounded_half_up(sql)
            return f

        return register
