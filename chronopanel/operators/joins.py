"""Joins of a panel with covariates, forecasts and drill-back tables.

No broadcast is forced: Spark measures a side at run time and broadcasts it
only below its size threshold, otherwise it shuffles both sides.  Observations
that are drilled back to are always shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_covariates(panel: DataFrame, tables: Sequence[DataFrame], on: str) -> DataFrame:
    """Left-join covariate tables on the index; missing values become 0."""
    out = reduce(lambda a, b: a.join(b, on, "left"), tables, panel)
    added = [c for t in tables for c in t.columns if c != on]
    return out.fillna(0, subset=added)


def outer_merge(
    panel: DataFrame, tables: Sequence[DataFrame], on: str, key: str, drop_phantom: bool = False
) -> DataFrame:
    """Full outer merge on the index with NULL -> 0.

    Index values only a covariate has become rows without a key.  They form one
    phantom series with key '0', unless ``drop_phantom`` leaves them out.
    """
    out = reduce(lambda a, b: a.join(b, on, "full_outer"), tables, panel)
    if drop_phantom:
        return out.where(F.col(key).isNotNull()).fillna(0)
    return out.fillna(0).fillna({key: "0"})


def drill_back(selected: DataFrame, observations: DataFrame, key: Sequence[str]) -> DataFrame:
    """All observations of the selected series (many to many).

    Observations are never broadcast, however small their files: a few bytes on disk
    can be millions of rows in the driver.
    """
    return selected.join(observations.hint("merge"), list(key), "left")


def pair_forecasts(forecasts: DataFrame, actuals: DataFrame, on: Sequence[str]) -> DataFrame:
    return forecasts.join(actuals, list(on), "inner")
