"""Registry of queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, floats: tuple[str, ...] | str = ()):
    """Registers a query (spark, sf_dir) -> DataFrame. `sql`: its twin; its `floats` are rounded as the query's doubles are."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            cols = floats.split() if isinstance(floats, str) else floats
            body = sql.strip().rstrip(";")
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round(({c})::DOUBLE, {DIGITS}) AS {c}' for c in cols)}) FROM (\n{body}\n)" if cols else body
        return f

    return add
