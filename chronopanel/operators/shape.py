"""Projections, recoding and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """The contiguous run of columns from ``first`` to ``last``."""
    cols = df.columns
    return cols[cols.index(first) : cols.index(last) + 1]


def columns_containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def without_null_columns(df: DataFrame) -> DataFrame:
    """Keep the columns that hold no NULL (one aggregation pass decides)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] == 0])


def recode(x: Column | str, groups: dict[str, Sequence[str]], default: str) -> Column:
    """Map values to the name of the group that lists them."""
    col = F.col(x) if isinstance(x, str) else x
    out = None
    for name, members in groups.items():
        test = col.isin(*members)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def level_order(x: Column | str, levels: Sequence[str]) -> Column:
    """1-based rank of a value in its level list; NULL when it is not listed."""
    pos = F.array_position(F.lit(list(levels)), F.col(x) if isinstance(x, str) else x)
    return F.when(pos > 0, pos).cast("long")


def longer(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), names_to, values_to)


def wider(df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence[str], value: Column) -> DataFrame:
    """One column per name; naming them spares Spark the extra pass for distinct values."""
    return df.groupBy(*ids).pivot(names_from, list(names)).agg(value)


def bind_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scenarios(future: DataFrame, cases: dict[str, dict[str, float]], name: str = "scenario") -> DataFrame:
    """Every future row under every scenario; the cases are literals, so rows expand in place."""
    options = F.array(
        *[
            F.struct(F.lit(k).alias(name), *[F.lit(float(v)).alias(c) for c, v in vals.items()])
            for k, vals in cases.items()
        ]
    )
    out = future.withColumn("__s", F.explode(options))
    fields = [name, *next(iter(cases.values()))]
    return out.select(*future.columns, *[F.col(f"__s.{f}") for f in fields])


def over_proportions(df: DataFrame, ps: Sequence[float], name: str = "p") -> DataFrame:
    """Repeat each row once per proportion, with the proportion as a column."""
    return df.withColumn(name, F.explode(F.lit([float(p) for p in ps])))
