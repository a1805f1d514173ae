"""Query registry: ``@query(key, oracle_sql)`` collects the registered
queries; ``kestrel.plans.catalog`` imports every query module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIG = 6


def query(key: str, oracle: str | None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def r6(c) -> F.Column:
    """Round to 6 digits (both sides of every oracle comparison do)."""
    return F.round(F.col(c) if isinstance(c, str) else c, DIG)
