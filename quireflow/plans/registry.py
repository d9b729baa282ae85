"""Queries over the given tables: a Spark callable and, where SQL can say it, the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def sql_view(name: str, body: str, uses: tuple[str, ...] = ()) -> None:
    """Registers a derived view for use by reference SQL."""
    SQL_VIEWS[name] = (uses, body)


def with_views(body: str, uses: tuple[str, ...], recursive: bool = False) -> str:
    """Puts the named views, and the views they use, in front of a query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in SQL_VIEWS[name][0]:
                visit(needed)
            ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS (\n{SQL_VIEWS[name][1].strip()}\n)" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):].strip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, covers: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Decorator: registers run(spark, folder) under `name`; `covers` lists the survey rows it shows."""

    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else with_views(sql, uses)
        QUERIES[name] = Query(name, tuple(covers.split()), run, text)
        return run

    return register
