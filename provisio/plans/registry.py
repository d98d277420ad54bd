"""Named queries, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from provisio.plans.oracle import CTES, with_views
from provisio.plans.projections import Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", ctes: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``views`` names the legal views the SQL reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            used = views.split() or [v for v in CTES if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql + ctes)]
            head = with_views(*used) if used else ""
            if ctes:
                head = f"{head},\n{ctes}" if head else f"WITH {ctes}"
            ORACLES[name] = f"{head}\n{sql}"
        return fn

    return register
