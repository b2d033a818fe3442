"""Registry of queries: each entry is a Spark plan and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return add


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round result columns so that summation order does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
