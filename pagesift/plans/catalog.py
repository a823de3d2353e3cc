"""Registry of the named queries (one per operator key) and their SQL oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables; the oracle is DuckDB SQL over the same tables.  Modules named
``reg_*`` register themselves on import.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, Callable[[], str] | str] = {}

MODULES = (
    "pagesift.plans.reg_text",
    "pagesift.plans.reg_html",
    "pagesift.plans.reg_params",
    "pagesift.plans.reg_config",
    "pagesift.plans.reg_dom",
    "pagesift.plans.reg_frontier",
    "pagesift.plans.reg_select",
    "pagesift.plans.reg_stream",
)


def register(key: str, sql=None):
    """Decorator: register a query; ``sql`` is a string or a zero-argument function."""

    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: (v() if callable(v) else v) for k, v in ORACLE.items()}
