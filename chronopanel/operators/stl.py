"""STL: seasonal-trend decomposition by loess.

Loess passes feed each other, so one series is one sequential job; Spark spreads
the series.  A series has one row per calendar step, which bounds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.operators.baseline import seasonal_tail
from chronopanel.panel import Panel, shift
from chronopanel.session import spread


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


def _local_fit(y, at, left, width, span, degree, robust):
    """Loess values at points ``at`` (1-based) over windows of ``width`` rows from ``left``."""
    n = len(y)
    cols = left[:, None] + np.arange(width)[None, :]
    pos = cols + 1.0
    dist = np.abs(pos - at[:, None])
    h = np.maximum(at - pos[:, 0], pos[:, -1] - at)
    if span > n:
        h = h + (span - n) // 2
    h = h[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(dist <= 0.001 * h, 1.0, (1 - (dist / h) ** 3) ** 3)
    w = np.where(dist <= 0.999 * h, w, 0.0)
    if robust is not None:
        w = w * robust[cols]
    mass = w.sum(1, keepdims=True)
    ok = mass[:, 0] > 0
    w = np.divide(w, mass, out=np.zeros_like(w), where=mass > 0)
    if degree > 0:
        centre = (w * pos).sum(1, keepdims=True)
        spread = (w * (pos - centre) ** 2).sum(1, keepdims=True)
        tilt = np.divide(
            at[:, None] - centre, spread, out=np.zeros_like(spread),
            where=np.sqrt(spread) > 0.001 * max(n - 1, 1),
        )
        w = w * (tilt * (pos - centre) + 1)
    return (w * y[cols]).sum(1), ok


def _smooth(y, span, degree, jump, robust):
    """Loess over a whole regular series, evaluated every ``jump`` rows."""
    n = len(y)
    if n < 2:
        return y.copy()
    width, jump = min(span, n), min(jump, n - 1)
    at = np.arange(0, n, jump)
    reach = (span + 1) // 2
    left = np.clip(at + 1 - reach, 0, n - width) if span < n else np.zeros(len(at), dtype=int)
    if at[-1] != n - 1:
        at, left = np.append(at, n - 1), np.append(left, left[-1])
    fit, ok = _local_fit(y, at + 1.0, left, width, span, degree, robust)
    fit = np.where(ok, fit, y[at])
    return fit if jump == 1 else np.interp(np.arange(n), at, fit)


def _cycle_smooth(y, m, span, degree, jump, robust):
    """Smooth every season position on its own, one step longer at both ends."""
    n = len(y)
    out = np.empty(n + 2 * m)
    for j in range(m):
        sub = y[j::m]
        rw = None if robust is None else robust[j::m]
        k, width = len(sub), min(span, len(sub))
        mid = _smooth(sub, span, degree, jump, rw)
        ends, ok = _local_fit(
            sub, np.array([0.0, k + 1.0]), np.array([0, k - width]), width, span, degree, rw
        )
        first, last = np.where(ok, ends, mid[[0, -1]])
        out[j : j + m * (k + 2) : m] = np.concatenate([[first], mid, [last]])
    return out


def _running(x, k):
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[k:] - c[:-k]) / k


def stl_components(y, m, season_window=11, trend_window=None, robust=False):
    """(trend, seasonal) of one series; ``season_window=None`` means periodic."""
    n = len(y)
    periodic = season_window is None
    s_span = 10 * n + 1 if periodic else season_window
    t_span = trend_window or _odd(1.5 * m / (1 - 1.5 / s_span))
    l_span = _odd(m)
    s_jump, t_jump, l_jump = (int(np.ceil(s / 10)) for s in (s_span, t_span, l_span))
    trend, seasonal, rw = np.zeros(n), np.zeros(n), None
    inner, outer = (1, 15) if robust else (2, 0)
    for i in range(outer + 1):
        for _ in range(inner):
            cyc = _cycle_smooth(y - trend, m, s_span, 0, s_jump, rw)
            low = _running(_running(_running(cyc, m), m), 3)
            low = _smooth(low, l_span, 1, l_jump, None)
            seasonal = cyc[m : m + n] - low
            trend = _smooth(y - seasonal, t_span, 1, t_jump, rw)
        if i < outer:
            r = np.abs(y - seasonal - trend)
            lim = 6 * np.median(r)
            if lim <= 0:
                break
            rw = np.where(r <= 0.001 * lim, 1.0, (1 - (r / lim) ** 2) ** 2)
            rw = np.where(r <= 0.999 * lim, rw, 0.0)
    if periodic:
        means = np.array([seasonal[j::m].mean() for j in range(m)])
        seasonal = means[np.arange(n) % m]
    return trend, seasonal


def _multi(y, periods, season_window, trend_window, robust):
    """Several periods: each is fitted in turn with the others taken out."""
    if len(periods) == 1:
        return stl_components(y, periods[0], season_window, trend_window, robust)
    parts = {m: np.zeros(len(y)) for m in periods}
    trend = np.zeros(len(y))
    for _ in range(2):
        for i, m in enumerate(sorted(periods)):
            rest = y - sum(v for k, v in parts.items() if k != m)
            window = season_window if season_window is None else season_window + 4 * i
            trend, parts[m] = stl_components(rest, m, window, trend_window, robust)
    return trend, sum(parts.values())


def stl(
    panel: Panel,
    y: str,
    periods: Sequence[int] | None = None,
    season_window: int | None = 11,
    trend_window: int | None = None,
    robust: bool = False,
) -> Panel:
    """Adds ``trend, seasonal, remainder, season_adjust``; one task per series.

    Series with missing values or fewer than two periods get NULL components.
    """
    panel.need_whole("stl")
    periods = tuple(periods or (panel.period,))
    index = panel.index
    df = panel.df.select(*panel.key, index, F.col(y).cast("double").alias(y))
    parts = ["trend", "seasonal", "remainder", "season_adjust"]
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in parts])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        v = pdf[y].to_numpy(float)
        if len(v) < 2 * max(periods) or np.isnan(v).any():
            return pdf.assign(**{c: np.nan for c in parts})
        trend, seasonal = _multi(v, periods, season_window, trend_window, robust)
        return pdf.assign(
            trend=trend, seasonal=seasonal, remainder=v - trend - seasonal, season_adjust=v - seasonal
        )

    out = spread(df, panel.key).groupBy(*panel.key).applyInPandas(fit, schema)
    return panel.on(out.withColumns({c: F.nanvl(c, F.lit(None)) for c in parts}))


def seasonal_forecast(panel: Panel, h: int, period: int | None = None) -> DataFrame:
    """Forecast of a decomposed panel: naive on the adjusted part plus the last season."""
    m = period or panel.period
    p = panel.with_position("t")
    tail = seasonal_tail(p, "seasonal", m)
    last = p.df.groupBy(*panel.key).agg(
        F.max_by("season_adjust", "t").alias("level"), F.max(panel.index).alias("__end")
    )
    out = last.join(tail, list(panel.key)).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return out.select(
        *panel.key,
        F.col("h").cast("long").alias("h"),
        shift("__end", F.col("h"), panel.grain).alias(panel.index),
        (F.col("level") + F.col("tail")[F.pmod(F.col("h") - 1, F.lit(m))]).alias("mean"),
    )
