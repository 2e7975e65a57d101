"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.panel import Panel

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its result gets plain comparable column types."""

    def wrap(fn: Callable[[Callable[[str], DataFrame]], DataFrame | Panel]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(t: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{t}.parquet")

            table.folder, table.spark = sf_dir, spark

            out = fn(table)
            return plain(out.df if isinstance(out, Panel) else out, digits)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, whole numbers as bigint, fractions rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = 6) -> str:
    """SQL text: rounded, without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def d(expr: str) -> str:
    """SQL text: a date as text."""
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR)"


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()
