"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(needs: str, sql: str, skip_oracle: bool = False):
    """Register a function of Views; ``sql`` reads the tables and views in ``needs``."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if not skip_oracle:
            ORACLE[f.__name__] = oracle(needs, sql)
        return f

    return add


from . import log_queries, state_queries, write_queries  # noqa: E402, F401
