"""One query for each operator, over its whole table, with the matching DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.queries import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12

_MODULES = (op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.query.__name__: m.query for m in _MODULES} | {k: f for m in _MODULES for k, f in getattr(m, "MORE", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {m.query.__name__: m.SQL for m in _MODULES if m.SQL is not None} | {k: x for m in _MODULES for k, x in getattr(m, "MORE_SQL", {}).items()}
