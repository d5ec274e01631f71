"""The registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from carefold.plans.inputs import Inputs

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; without ``sql`` its check is a unit test instead."""

    def add(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def framed(*parts: str) -> str:
    """The parts of a key in one string that tells them apart, as ``functions.ids`` builds it."""
    text = [f"CAST({p} AS VARCHAR)" for p in parts]
    return " || '|' || ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in text)


def values_sql(rows: list[tuple], names: str) -> str:
    """A VALUES table of constants."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (int, float)):
            return f"{float(value)!r}::DOUBLE" if isinstance(value, float) else str(value)
        return "'" + str(value).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({names})"
