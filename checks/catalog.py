"""Registry of queries and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ctes import CTES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_ctes(sql: str) -> str:
    """Prefix a SELECT with the shared common table expressions it uses, directly or not."""
    names = list(CTES)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in names if name in needed)
    return f"WITH {parts}\n{sql.strip()}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return function

    return register


def ts_text(ts: str | Column) -> Column:
    """Instant as text, for comparison across engines."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(column: str | Column, separator: str = "|") -> Column:
    return F.array_join(column, separator)


def shown(column: str | Column) -> Column:
    """Nullable whole number as text, empty where null, so that engines cannot differ in its type."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.cast("string"), F.lit(""))
