"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segrec.operators.facts import BASE, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a function of a Star under ``name``; ``sql`` follows the shared definitions unless ``base`` is false.

    SQL that defines frames of its own starts with a comma.
    """

    def register(function: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Star(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = BASE + sql if base else sql
        return function

    return register
