"""Query registry: name -> (Spark callable, SQL twin)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelscope.plans.inspection import ORACLE_TABLES, Inspection

_QUERIES: dict[str, Callable[[Inspection], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; ``sql`` may name any derived table."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return wrap


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the derived tables it names, dependencies first."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", text))
        for table, body in ORACLE_TABLES.items():
            if table in words and table not in wanted and body is not text:
                visit(body)
                if table not in wanted:
                    wanted.append(table)

    visit(sql)
    if not wanted:
        return sql
    head = ",\n".join(f"{t} AS ({ORACLE_TABLES[t].strip()})" for t in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:]
        recursive = rest.upper().startswith("RECURSIVE ")
        rest = rest[10:] if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{rest}"
    return f"WITH {head}\n{body}"


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Inspection(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle() -> dict[str, str]:
    return {name: with_tables(sql) for name, sql in _ORACLE.items()}
