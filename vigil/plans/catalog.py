"""Registry of every implemented query: name → (Spark callable, oracle SQL).

Callables take (spark, sf_dir) and return a DataFrame over the whole
tables.  SQL is DuckDB text over the same tables (views named after
them); ``None`` marks operators checked by invariants only.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from vigil.plans.sqltext import bigint_counts
from vigil.session import ensure_session_defaults

MODULES = [
    "vigil.plans.q_detect",
    "vigil.plans.q_history",
    "vigil.plans.q_accounts",
    "vigil.plans.q_clean",
    "vigil.plans.q_baseline",
    "vigil.plans.q_sampling",
    "vigil.plans.q_models",
    "vigil.plans.q_stream",
    "vigil.plans.q_live",
]


def _with_defaults(fn: Callable) -> Callable:
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ensure_session_defaults(spark)
        return fn(spark, sf_dir)
    return run


def _collect():
    qs: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for name, (fn, text) in mod.REGISTRY.items():
            if name in qs:
                raise ValueError(f"duplicate query {name}")
            qs[name] = _with_defaults(fn)
            if text is not None:
                sql[name] = bigint_counts(text)
    return qs, sql


def queries() -> dict[str, Callable]:
    return _collect()[0]


def oracle_sql() -> dict[str, str]:
    return _collect()[1]
