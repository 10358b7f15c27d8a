"""Where queries register: a name, a function of the tables, and its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.sources.adapters import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Tables; ``$x`` in the SQL stands for the adapter x."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = re.sub(r"\$([a-z]+)", lambda m: CTES[m[1]], sql)
        return f

    return add
