"""Roll-ups, correlations, histograms, densities and simple lines."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.panel import Panel, floor_to


def roll_up(
    df: DataFrame, ts: str, grain: str, key: Sequence[str], index: str, **measures: Column
) -> Panel:
    """Aggregate raw rows to one row per key and calendar step.

    The partial aggregation runs before the shuffle, so a key with most of the
    raw rows costs one row per step and map task.
    """
    out = df.groupBy(*key, floor_to(ts, grain).alias(index)).agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    return Panel(out, tuple(key), index, grain)


def coarsen(panel: Panel, grain: str, index: str, **measures: Column) -> Panel:
    """Roll a panel up to a coarser grain, keeping its key."""
    return roll_up(panel.df, panel.index, grain, panel.key, index, **measures)


def collapse(panel: Panel, keep: Sequence[str], **measures: Column) -> Panel:
    """Aggregate over the key columns not kept; the index always stays."""
    out = panel.df.groupBy(*keep, panel.index).agg(*[c.alias(n) for n, c in measures.items()])
    return panel.on(out, key=tuple(keep))


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Correlation of every pair of columns in one aggregation, long form."""
    pairs = list(combinations(columns, 2))
    wide = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"__{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*by, F.explode(cells).alias("p")).select(*by, "p.*")


def histogram(df: DataFrame, key: Sequence[str], x: str, bins: int) -> DataFrame:
    """Equal-width bins per key: bin number, left edge, count and density."""
    lim = df.groupBy(*key).agg(
        F.min(x).cast("double").alias("__lo"),
        F.max(x).cast("double").alias("__hi"),
        F.count(x).alias("__n"),
    )
    joined = df.where(F.col(x).isNotNull()).join(lim, list(key))
    width = (F.col("__hi") - F.col("__lo")) / bins
    raw = F.floor((F.col(x) - F.col("__lo")) / width) + 1
    b = F.when(F.col("__hi") > F.col("__lo"), F.least(raw, F.lit(bins))).otherwise(F.lit(1))
    out = joined.groupBy(*key, b.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.max(F.col("__lo")).alias("__lo"),
        F.max(width).alias("width"),
        F.max("__n").alias("__n"),
    )
    return out.select(
        *key,
        "bin",
        (F.col("__lo") + (F.col("bin") - 1) * F.col("width")).alias("left"),
        "count",
        F.try_divide(F.col("count"), F.col("__n") * F.col("width")).alias("density"),
    )


def kernel_density(df: DataFrame, key: Sequence[str], x: str, points: int = 64, bins: int = 256) -> DataFrame:
    """Gaussian kernel density of binned values on a grid over the range.

    After binning a key has at most ``bins`` rows, so its bins fit in one array
    and each grid point folds over that array.
    """
    lim = df.groupBy(*key).agg(
        F.min(x).cast("double").alias("lo"),
        F.max(x).cast("double").alias("hi"),
        F.count(x).alias("n"),
        F.stddev_samp(x).alias("sd"),
    )
    joined = df.where(F.col(x).isNotNull()).join(lim, list(key))
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col(x) - F.col("lo")) / step), F.lit(bins - 1))
    counted = joined.groupBy(*key, b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    packed = counted.groupBy(*key).agg(F.collect_list(F.struct("b", "c")).alias("cells"))
    spread = packed.join(lim, list(key)).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    at = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    width = 1.06 * F.col("sd") * F.pow(F.col("n"), -0.2)

    def kernel(acc: Column, cell: Column) -> Column:
        centre = F.col("lo") + (cell["b"] + 0.5) * (F.col("hi") - F.col("lo")) / bins
        z = (at - centre) / width
        return acc + cell["c"] * F.exp(-z * z / 2)

    total = F.aggregate("cells", F.lit(0.0), kernel)
    dens = total / (F.col("n") * width * math.sqrt(2 * math.pi))
    return spread.select(*key, F.col("point").cast("long"), at.alias("grid"), dens.alias("density"))


def line_fit(df: DataFrame, key: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line per key."""
    return df.groupBy(*key).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def mean_and_error(df: DataFrame, key: Sequence[str], x: str) -> DataFrame:
    """Mean, standard error and root mean square, NULLs left out."""
    return df.groupBy(*key).agg(
        F.avg(x).alias("mean"),
        (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"),
        F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"),
    )
