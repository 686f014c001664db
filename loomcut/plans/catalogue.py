"""Every query of the engine, with SQL that a second engine can run where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import relational, sourcecode


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.QUERIES | sourcecode.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLES | sourcecode.ORACLES
