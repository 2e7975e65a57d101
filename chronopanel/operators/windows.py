"""Moving frames, lags and plot data over ordered series.

Every operator goes through :func:`chronopanel.panel.framed`, which uses one
shared window per panel, or blocks with copied edge rows when the panel asks for
them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronopanel.panel import FrameExpr, Panel, framed


def _complete_mean(x: str, before: int, after: int) -> FrameExpr:
    width = before + after + 1

    def expr(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-before, after)
        return F.when(F.count(x).over(frame) == width, F.avg(x).over(frame))

    return expr


def moving_mean(panel: Panel, x: str, before: int, after: int, name: str) -> Panel:
    """Moving mean, NULL where the frame is short or holds a NULL."""
    return framed(panel, {name: _complete_mean(x, before, after)}, before, after)


def moving_means(panel: Panel, x: str, specs: dict[str, tuple[int, int]]) -> Panel:
    """Several moving means in one pass: name -> (before, after)."""
    return framed(
        panel,
        {n: _complete_mean(x, b, a) for n, (b, a) in specs.items()},
        max(b for b, _ in specs.values()),
        max(a for _, a in specs.values()),
    )


def centred_ma(panel: Panel, x: str, order: int, name: str) -> Panel:
    """Centred moving average; an even order averages two neighbouring frames."""
    half = order // 2
    if order % 2:
        return moving_mean(panel, x, half, half, name)

    def expr(w: WindowSpec) -> Column:
        inner, outer = w.rowsBetween(-half + 1, half - 1), w.rowsBetween(-half, half)
        total = F.sum(x).over(outer) + F.sum(x).over(inner)
        return F.when(F.count(x).over(outer) == order + 1, total / (2 * order))

    return framed(panel, {name: expr}, half, half)


def daily_from_cumulative(panel: Panel, x: str, name: str) -> Panel:
    """Increments of a cumulative series; the first value is kept."""
    return framed(panel, {name: lambda w: F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0))}, 1)


def difference(panel: Panel, x: str, lags: Sequence[int], name: str) -> Panel:
    """Nested differences: ``lags=[12, 1]`` is the first difference of the seasonal one."""
    out, col = panel, x
    for i, k in enumerate(lags):
        src, dst = col, name if i == len(lags) - 1 else f"__d{i}"
        out = framed(out, {dst: lambda w, s=src, k=k: F.col(s) - F.lag(s, k).over(w)}, k)
        col = dst
    temp = [c for c in out.df.columns if c.startswith("__d")]
    return out.on(out.df.drop(*temp))


def with_row_number(panel: Panel, name: str = "rn") -> Panel:
    return panel.on(panel.with_position(name).df)


def lag_pairs(panel: Panel, x: str, lags: Sequence[int]) -> DataFrame:
    """Long table (key, index, lag, x, lagged): each value with its k-th predecessor."""
    cols = {f"__l{k}": (lambda w, k=k: F.lag(x, k).over(w)) for k in lags}
    df = framed(panel, cols, max(lags)).df
    pairs = F.array(
        *[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"__l{k}").alias("lagged")) for k in lags]
    )
    out = df.select(*panel.key, panel.index, x, F.explode(pairs).alias("p"))
    out = out.select(*panel.key, panel.index, "p.lag", x, "p.lagged")
    return out.where(F.col("lagged").isNotNull())


def season_plot(panel: Panel, x: str, cycle: str) -> DataFrame:
    """(key, cycle, position in cycle, value) for a year, week or day cycle."""
    i = F.col(panel.index)
    position = {
        ("year", "month"): F.month(i),
        ("year", "quarter"): F.quarter(i),
        ("year", "week"): F.weekofyear(i),
        ("year", "day"): F.dayofyear(i),
        ("week", "day"): F.weekday(i) + 1,
        ("week", "hour"): F.weekday(i) * 24 + F.hour(i),
        ("day", "hour"): F.hour(i),
    }[(cycle, panel.grain)]
    whole_weeks = cycle == "year" and panel.grain == "week"
    start = F.extract(F.lit("YEAROFWEEK"), i) if whole_weeks else F.date_trunc(cycle, i)
    if cycle == "year" and not whole_weeks:
        start = F.year(i)
    elif cycle != "year":
        start = start.cast("date")
    return panel.df.select(
        *panel.key, start.alias("cycle"), position.cast("long").alias("position"), F.col(x)
    )


def subseries(panel: Panel, x: str, season: Column, name: str = "season") -> DataFrame:
    """Each value with the mean of its season position."""
    df = panel.df.withColumn(name, season)
    place = [*panel.key, name]
    if panel.block is None:
        df = df.withColumn("season_mean", F.avg(x).over(Window.partitionBy(*place)))
    else:
        df = df.join(df.groupBy(*place).agg(F.avg(x).alias("season_mean")), place)
    return df.select(*panel.key, panel.index, name, x, "season_mean")


def label_events(
    df: DataFrame, day: str, base: dt.date, offsets: dict[int, str], name: str
) -> DataFrame:
    """Label every row with the latest named date that is not after it."""
    label = F.lit(None).cast("string")
    for days, text in sorted(offsets.items()):
        at = base + dt.timedelta(days=days)
        label = F.when(F.col(day) >= F.lit(at), F.lit(text)).otherwise(label)
    return df.withColumn(name, label)


def cumulative(panel: Panel, x: str, name: str) -> Panel:
    """Running sum; with blocks, earlier blocks enter as one subtotal each."""
    rows = (Window.unboundedPreceding, 0)
    if panel.block is None:
        return framed(panel, {name: lambda w: F.sum(x).over(w.rowsBetween(*rows))})
    p = panel.placed()
    df = p.df.withColumn("__b", F.floor((F.col(p.position) - 1) / panel.block))
    before = Window.partitionBy(*panel.key).orderBy("__b").rowsBetween(rows[0], -1)
    totals = df.groupBy(*panel.key, "__b").agg(F.sum(x).alias("__s"))
    totals = totals.select(
        *panel.key, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o")
    )
    inner = Window.partitionBy(*panel.key, "__b").orderBy(p.position).rowsBetween(*rows)
    df = df.join(totals, [*panel.key, "__b"])
    total = F.sum(x).over(inner)
    # A block may begin with missing values: the sum so far is the earlier blocks'.
    started = F.coalesce(total, F.when(F.col("__o") != 0, F.lit(0)))
    df = df.withColumn(name, started + F.col("__o")).drop("__b", "__o")
    return panel.on(df if panel.position else df.drop(p.position))
