"""All registered queries of the retrieval operators, with the SQL that an independent engine checks them by."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from .plans.views import Tables
from .tables import only_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the logical tables as a query (spark, sf_dir) -> DataFrame."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: only_rows(spark, lambda: f(Tables(spark, sf_dir)), name)
        if sql:
            ORACLES[name] = sql
        return f

    return register


for _part in ("ingest", "search", "library", "conversations"):
    importlib.import_module(f"millrace.plans.{_part}")
