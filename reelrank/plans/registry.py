"""Registry of named queries: a Spark builder and, where SQL can say the same
thing, its DuckDB twin.  ``__spark_entry__`` exposes both dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_cards, q_catalog, q_features, q_files, q_ingest, q_merge, q_reports, q_model, q_explain, q_stream  # noqa: F401


def _rounded_query(fn, cols):
    from ..functions.display import decimal_round

    def run(spark, sf_dir):
        df = fn(spark, sf_dir)
        return df.withColumns({c: decimal_round(c, 6) for c in cols})
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def _rounded_sql(sql: str, cols) -> str:
    from ..functions.display import sql_decimal_round
    rep = ", ".join(f'{sql_decimal_round(chr(34) + c + chr(34), 6)} AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def spark_queries() -> dict:
    """Registered queries; double outputs of oracle-checked queries are
    rounded to 6 decimals with the engine-independent rule."""
    from .double_columns import DOUBLE_COLUMNS
    load_all()
    return {k: (_rounded_query(f, DOUBLE_COLUMNS[k]) if k in DOUBLE_COLUMNS else f)
            for k, f in QUERIES.items()}


def oracle_queries() -> dict:
    from .double_columns import DOUBLE_COLUMNS
    load_all()
    return {k: (_rounded_sql(s, DOUBLE_COLUMNS[k]) if k in DOUBLE_COLUMNS else s)
            for k, s in ORACLE.items()}
