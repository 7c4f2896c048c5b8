"""Registration of queries and their oracles."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .oracle_parts import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Registers a query; `oracle` is the equivalent SQL, left out where SQL cannot express the result."""

    def register(build):
        QUERIES[key] = build
        if oracle is not None:
            ORACLES[key] = sql(oracle)
        return build

    return register


def rounded(df: DataFrame, digits=6) -> DataFrame:
    """Doubles at a fixed number of decimals, so that the order of float sums does not show."""
    return df.select(
        *[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    )


def r(*columns: str, digits=6) -> str:
    """The same for oracle SQL: `expr` or `expr AS name`."""
    parts = []
    for column in columns:
        expr, _, name = column.rpartition(" AS ")
        parts.append(f"round({expr or name}, {digits}) + 0.0 AS {name}")
    return ", ".join(parts)
