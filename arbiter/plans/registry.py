"""Query registry: name → (Spark builder, optional oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        text = sql() if callable(sql) else sql
        REGISTRY[name] = Query(name, fn, text, (fn.__doc__ or "").strip())
        return fn

    return deco
