"""The library's queries over the test tables, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from tallyspark.sources.testdata import ctes, view

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers a function of domain tables; sql may use the same tables by name. SQL that starts
    with a common table expression of its own goes on after a comma."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            body = sql.strip()
            start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
            given = ctes(list(views))
            given = given.replace("WITH", "WITH RECURSIVE", 1) if "RECURSIVE" in start else given
            ORACLES[name] = given + (", " if start else "") + body[len(start) :]
        return f

    return add


def pct_sql(part: str, total: str, scale: int = 2) -> str:
    """part * 100 / total, half up, in whole units of the scale; for amounts with two decimals."""
    n = 10**scale * 100
    p, t = f"CAST(({part}) * 100 AS HUGEINT)", f"CAST(({total}) * 100 AS HUGEINT)"
    return f"CAST(CASE WHEN coalesce({total}, 0) = 0 THEN 0 ELSE sign({p}) * ((2 * abs({p}) * {n} + abs({t})) // (2 * abs({t}))) / {10.0**scale} END AS DECIMAL(19,{scale}))"


for _module in ("summaries", "invoicing", "portfolio", "detection", "classifying", "ingesting", "composites", "streams"):
    importlib.import_module(f"tallyspark.plans.{_module}")
