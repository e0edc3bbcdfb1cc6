"""Registered queries: one Spark callable per operator, with its SQL twin.

Each entry maps ``<id>_<name>`` to ``(fn(spark, sf_dir) -> DataFrame, sql | None)``.
``sql`` is DuckDB text over the base tables; ``None`` marks operators whose
results are checked by invariants and tests instead (seeded models, files,
streams).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
QUERY_MODULES = ["q_etl", "q_catalog", "q_records", "q_models", "q_jobs", "q_files", "q_more"]


def _wrap_calls(sql: str, fn: str, cast: str) -> str:
    """Wrap every ``fn(...)`` call in ``CAST(... AS cast)`` (DuckDB returns HUGEINT)."""
    out, i, key = [], 0, fn + "("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(fn)
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _wrap_calls(sql[j + len(key):k], fn, cast)
        out.append(sql[i:j] + f"CAST({fn}({inner}) AS {cast})")
        i = k + 1


def register(name: str, sql: str | None = None):
    if sql is not None:
        sql = _wrap_calls(sql, "count_if", "BIGINT")
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Query, str | None]]:
    # Importing the modules fills REGISTRY.
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"carelake.plans.{mod}")
    return REGISTRY
