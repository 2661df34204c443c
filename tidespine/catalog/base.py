"""Query registry: each entry is a DataFrame function over the given tables, with an optional SQL twin."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidespine.catalog.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix a SELECT with the view definitions it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in needed)
    body = body.strip()
    if not needed:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a function taking ``Tables``."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql)
        return fn
    return register
