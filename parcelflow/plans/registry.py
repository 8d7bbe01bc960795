"""Name → Spark query and, where SQL can say it, the oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelflow.adapters import ADAPTERS, Tables, duckdb_cte
from parcelflow.session import with_true_sizes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Puts the adapter views that a statement names in front of it."""
    used = [a for a in ADAPTERS if re.search(rf"\b{a}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(duckdb_cte(a) for a in used)
    body = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(with_true_sizes(spark), folder))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn

    return add
