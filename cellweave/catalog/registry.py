"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixtures import FIXTURE_SQL
from ..workspace import Workspace, workspace

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
_NAMES = {n: n for n in (*TABLES, "pixels")}

for _name, _text in FIXTURE_SQL.items():
    CTES[_name] = _text.format(**_NAMES)


def cte(name: str, text: str) -> None:
    CTES[name] = text


def compose(final: str) -> str:
    """Prefix ``final`` with the common table expressions it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if word in CTES and word not in order and word not in visiting:
                visiting.append(word)
                visit(CTES[word])
                visiting.remove(word)
                order.append(word)

    visiting: list[str] = []
    visit(final)
    if not order:
        return final.strip()
    parts = ",\n".join(f"{n} as materialized ({CTES[n].strip()})" for n in order)
    # a nested list of common table expressions is joined to the outer one
    body = final.strip()
    recursive = body.lower().startswith("with recursive ")
    if recursive:
        return f"with recursive {parts},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {parts},\n{body[len('with '):]}"
    return f"with {parts}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any named table or common table expression."""
    def add(fn: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def oracles() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLES.items()}


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]
    return lambda spark, sf_dir: fn(workspace(spark, sf_dir))


def r(column: str | Column, digits: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def rs(*names: str, digits: int = 6) -> list[Column]:
    return [r(n, digits).alias(n) for n in names]


def R(expr: str, digits: int = 6) -> str:
    return f"(round({expr},{digits})+0.0)"


def RS(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{R(n, digits)} as {n}" for n in names)


def big(*names: str) -> str:
    return ", ".join(f"cast({n} as bigint) as {n}" for n in names)


def bigs(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]
