"""Every operator as a runnable query over the test tables, most with the same in SQL.

A query gets ``Tables`` and returns a DataFrame; the library itself never rounds, the
queries do, so that two engines summing in different orders agree.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.adapters import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
AREAS = ("tables", "diary", "roster", "intakes", "scenarios", "items", "children")


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` may use the named views."""
    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else (with_views(sql, *views.split()) if views else sql)
        REGISTRY[name] = Query(name, run, text)
        return run
    return register


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round the named (default: all floating-point) columns."""
    names = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def r(columns, digits: int = 6, prefix: str = "") -> str:
    """SQL counterpart of ``rounded``."""
    return ", ".join(f"round({prefix}{c}, {digits}) AS {c}" for c in columns)


def load() -> dict[str, Query]:
    for area in AREAS:
        importlib.import_module(f"larder.catalogue.{area}")
    return REGISTRY
