"""Classical and filter-chain seasonal decompositions, as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronopanel.operators.windows import centred_ma
from chronopanel.panel import Panel, framed


def classical(panel: Panel, y: str, kind: str = "additive", period: int | None = None) -> Panel:
    """Trend, seasonal figure and rest of each series.

    The season position is the position modulo the period.  Series shorter than
    two periods get NULL components.  Adds ``trend, seasonal, random,
    season_adjust``.
    """
    m = period or panel.period
    multiplicative = kind == "multiplicative"

    def without(a: Column, b: Column) -> Column:
        return F.try_divide(a, b) if multiplicative else a - b

    p = panel.with_position("t").with_season("season", m)
    p = centred_ma(p, y, m, "trend")
    value = F.col(y).cast("double")
    df = p.df.withColumn("__detrended", without(value, F.col("trend")))
    df = _with_figure(p.on(df), m)
    long_enough = F.col("__n") >= 2 * m
    level = F.col("__mean")
    df = df.withColumn("seasonal", F.when(long_enough, without(F.col("__figure"), level)))
    df = df.withColumn("trend", F.when(F.col("seasonal").isNotNull(), F.col("trend")))
    df = df.withColumn("season_adjust", without(value, F.col("seasonal")))
    df = df.withColumn("random", without(F.col("season_adjust"), F.col("trend")))
    return p.on(df.drop("__detrended", "__figure", "__mean", "__n"))


def _with_figure(p: Panel, m: int) -> DataFrame:
    """Adds the mean of each season position, the mean of these over the first ``m`` rows, and the series length.

    With blocks these are aggregations joined back, of one row a season position.
    """
    if p.block is None:
        df = p.df.withColumn("__figure", F.avg("__detrended").over(Window.partitionBy(*p.key, "season")))
        # Each position occurs exactly once among the first m rows.
        mean = F.avg(F.when(F.col("t") <= m, F.col("__figure"))).over(p.whole())
        return df.withColumn("__mean", mean).withColumn("__n", F.max("t").over(p.whole()))
    figures = p.df.groupBy(*p.key, "season").agg(F.avg("__detrended").alias("__figure"), F.max("t").alias("__last"))
    own = figures.groupBy(*p.key).agg(F.avg("__figure").alias("__mean"), F.max("__last").alias("__n"))
    figures = figures.join(own, list(p.key)).drop("__last")
    return p.df.join(figures, [*p.key, "season"]).select(*p.df.columns, "__figure", "__mean", "__n")


def denoise(
    panel: Panel, y: str, kind: str = "additive", period: int | None = None, subtract: bool = False
) -> Panel:
    """Adds ``denoised`` and ``detrended`` series from a classical decomposition.

    A multiplicative rest is a ratio and is divided out; ``subtract=True``
    takes it off the value instead, for results that were made that way.
    """
    p = classical(panel, y, kind, period)
    ratio = kind == "multiplicative" and not subtract

    def off(part: str) -> Column:
        value = F.col(y).cast("double")
        return F.try_divide(value, F.col(part)) if ratio else value - F.col(part)

    return p.on(p.df.withColumns({"denoised": off("random"), "detrended": off("trend")}))


def _weighted(x: str, weights: Sequence[float], w: WindowSpec) -> Column:
    """Weighted mean of the neighbours that exist, weights rescaled to sum to 1."""
    half = len(weights) // 2
    total, mass = F.lit(0.0), F.lit(0.0)
    for i, wt in enumerate(weights):
        at = F.lag(x, half - i).over(w)
        total = total + F.coalesce(at * wt, F.lit(0.0))
        mass = mass + F.when(at.isNotNull(), F.lit(float(wt))).otherwise(F.lit(0.0))
    return F.when(F.abs(mass) > 1e-12, total / mass)


def henderson_weights(terms: int) -> list[float]:
    """Symmetric Henderson trend weights for an odd number of terms."""
    p = terms // 2
    n = p + 2
    scale = 8 * n * (n**2 - 1) * (4 * n**2 - 1) * (4 * n**2 - 9) * (4 * n**2 - 25)
    return [
        315
        * ((n - 1) ** 2 - j**2)
        * (n**2 - j**2)
        * ((n + 1) ** 2 - j**2)
        * (3 * n**2 - 16 - 11 * j**2)
        / scale
        for j in range(-p, p + 1)
    ]


# Seasonal filters of the ratio-to-moving-average method: fixed values.
MA_3X3 = [1.0, 2.0, 3.0, 2.0, 1.0]
MA_3X5 = [1.0, 2.0, 3.0, 3.0, 3.0, 2.0, 1.0]


def _seasonal_factors(p: Panel, ratio: str, weights: Sequence[float], out: str, m: int) -> Panel:
    by_season = Window.partitionBy(*p.key, "season").orderBy(p.index)
    df = p.df.withColumn("__raw", _weighted(ratio, weights, by_season))
    level = [0.5] + [1.0] * (m - 1) + [0.5]
    df = df.withColumn("__level", _weighted("__raw", level, p.window()))
    return p.on(df.withColumn(out, F.try_divide("__raw", "__level")).drop("__raw", "__level"))


def x11_filters(panel: Panel, y: str, period: int | None = None) -> Panel:
    """Ratio-to-moving-average adjustment: the filter chain, without outlier steps.

    2xm trend, 3x3 seasonal filter, Henderson trend, 3x5 seasonal filter,
    Henderson trend.  At the ends filters use the rows that exist.
    """
    panel.need_whole("x11_filters")
    m = period or panel.period
    h = henderson_weights(13)
    p = panel.with_position("t").with_season("season", m)
    p = centred_ma(p, y, m, "__t1")
    p = p.on(p.df.withColumn("__si", F.try_divide(F.col(y).cast("double"), F.col("__t1"))))
    p = _seasonal_factors(p, "__si", MA_3X3, "__s1", m)
    p = p.on(p.df.withColumn("__a1", F.try_divide(F.col(y).cast("double"), F.col("__s1"))))
    p = framed(p, {"__t2": lambda w: _weighted("__a1", h, w)}, 6, 6)
    p = p.on(p.df.withColumn("__si2", F.try_divide(F.col(y).cast("double"), F.col("__t2"))))
    p = _seasonal_factors(p, "__si2", MA_3X5, "seasonal", m)
    sa = F.try_divide(F.col(y).cast("double"), F.col("seasonal"))
    p = p.on(p.df.withColumn("season_adjust", sa))
    p = framed(p, {"trend": lambda w: _weighted("season_adjust", h, w)}, 6, 6)
    df = p.df.withColumn("random", F.try_divide("season_adjust", "trend"))
    return panel.on(df.drop("__t1", "__si", "__s1", "__a1", "__t2", "__si2"))


def long_components(panel: Panel, method: str, rest: str = "random") -> DataFrame:
    """One decomposition in the common long form."""
    return panel.df.select(
        *panel.key,
        panel.index,
        F.lit(method).alias("method"),
        "trend",
        "seasonal",
        F.col(rest).alias("rest"),
        "season_adjust",
    )
