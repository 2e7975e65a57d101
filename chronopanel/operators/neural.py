"""Autoregressive neural networks: small nets on lags, averaged.

Training is iterative, so a series is one job; all its networks are trained
together as one stacked array and Spark spreads the series.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.operators import features
from chronopanel.panel import Panel, shift
from chronopanel.session import spread


def _train(x, y, hidden, nets, rounds, rng):
    """Full-batch Adam on ``nets`` independent one-hidden-layer networks."""
    n, d = x.shape
    shapes = [(nets, d, hidden), (nets, 1, hidden), (nets, hidden, 1), (nets, 1, 1)]
    w = [rng.normal(0, 0.5, s) for s in shapes]
    mom, var = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    xb, target = x[None], y[None, :, None]
    for i in range(1, rounds + 1):
        act = 1 / (1 + np.exp(-(xb @ w[0] + w[1])))
        err = (act @ w[2] + w[3] - target) / n
        back = (err @ w[2].transpose(0, 2, 1)) * act * (1 - act)
        grads = [
            np.broadcast_to(xb.transpose(0, 2, 1), (nets, d, n)) @ back,
            back.sum(1, keepdims=True),
            act.transpose(0, 2, 1) @ err,
            err.sum(1, keepdims=True),
        ]
        rate = 0.05 * (1 - i / (rounds + 1))
        for j, g in enumerate(grads):
            mom[j] = 0.9 * mom[j] + 0.1 * g
            var[j] = 0.999 * var[j] + 0.001 * g * g
            w[j] = w[j] - rate * (mom[j] / (1 - 0.9**i)) / (np.sqrt(var[j] / (1 - 0.999**i)) + 1e-8)
    return w


def _apply(w, row):
    act = 1 / (1 + np.exp(-(row[None, None] @ w[0] + w[1])))
    return float((act @ w[2] + w[3]).mean())


def automatic_lags(panel: Panel, y: str, lag_max: int = 10, period: int | None = None) -> DataFrame:
    """(key, lags): the order of the autoregression with the least AIC, at least one.

    The season's means are taken out of series of two periods or more, and
    their partial autocorrelations give the residual variances of all orders.
    """
    m, key = period or panel.period, list(panel.key)
    p = panel.with_position("__t").with_season("__s", m, "__t")
    v, n = F.col(y).cast("double"), F.count(F.lit(1)).over(panel.whole())
    season = F.when(n >= 2 * m, F.avg(v).over(Window.partitionBy(*key, "__s"))).otherwise(F.lit(0.0)) if m > 1 else F.lit(0.0)
    wide = features.pacf_wide(p.on(p.df.withColumn("__a", v - season)), "__a", lag_max)
    sizes = panel.df.groupBy(*key).agg(F.count(y).alias("__n"))
    return wide.join(sizes, key).select(*key, features.ar_order(F.col("pacf"), F.col("__n")).alias("lags"))


def forecast_nnet(
    split: Panel,
    y: str,
    xs: Sequence[str] = (),
    lags: int | None = 7,
    seasonal_lags: int = 1,
    hidden: int | None = None,
    networks: int = 10,
    rounds: int = 300,
    seed: int = 1,
    period: int | None = None,
    lam: float | str | None = None,
    residuals: bool = False,
    lag_max: int = 10,
    series: int | None = None,
) -> DataFrame:
    """Forecast the test rows of a split: (key, h, index, actual, mean).

    Inputs are lags, seasonal lags and the covariates of the forecast row.
    ``lags=None`` takes each series' autoregressive order, at most ``lag_max``
    (`automatic_lags`).  ``lam`` is an optional Box-Cox parameter, ``"auto"`` the
    most stable one of each series; a series without one, or with values outside
    its domain, stays as it is.  ``networks`` repeats are averaged.  With ``residuals`` the fitted training
    rows instead: (key, index, resid).  ``series`` is their number, if known: no task starts without one.
    """
    split.need_whole("forecast_nnet")
    m = period or split.period
    index, key = split.index, list(split.key)
    df = split.df.select(*key, index, "part", "h", F.col(y).cast("double").alias("__y"), *xs)
    past_rows = split.on(split.df.where("part = 'train'").select(*key, index, F.col(y).cast("double").alias("__y")))
    if lags is None:
        df = df.join(automatic_lags(past_rows, "__y", lag_max, m).withColumnRenamed("lags", "__p"), key, "left")
    else:
        df = df.withColumn("__p", F.lit(lags).cast("long"))
    if lam == "auto":
        df = df.join(features.guerrero(past_rows, "__y", m).withColumnRenamed("lambda_guerrero", "__lam"), key, "left")
    else:
        df = df.withColumn("__lam", F.lit(lam).cast("double"))
    fields = [f for f in df.schema.fields if f.name in (*key, index, "h")]
    schema = T.StructType([*fields, T.StructField("actual", T.DoubleType()), T.StructField("mean", T.DoubleType())])
    if residuals:
        schema = T.StructType([*[f for f in fields if f.name != "h"], T.StructField("resid", T.DoubleType())])

    def link(v, lam):
        if lam is None:
            return v
        return np.log(v) if lam == 0 else (np.power(v, lam) - 1) / lam

    def unlink(v, lam):
        if lam is None:
            return v
        return np.exp(v) if lam == 0 else np.power(np.maximum(v * lam + 1, 0), 1 / lam)

    def settings(pdf: pd.DataFrame, past: np.ndarray) -> tuple[list[int], float | None]:
        order, power = pdf["__p"].iloc[0], pdf["__lam"].iloc[0]
        at = {*range(1, (1 if pd.isna(order) else int(order)) + 1), *(m * j for j in range(1, seasonal_lags + 1))}
        # The grid's zero is a rounding error away from zero.
        power = None if pd.isna(power) else 0.0 if abs(power) < 1e-9 else float(power)
        if lam == "auto" and power is not None:
            least = np.nanmin(past, initial=np.inf)
            power = None if least < 0 or (power <= 0 and least <= 0) else power
        return sorted(at), power

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        fut = pdf[pdf["part"] == "test"]
        out = fut[[*key, index, "h"]].assign(actual=fut["__y"], mean=np.nan)
        past = pdf[pdf["part"] == "train"]
        if residuals:
            out = past[[*key, index]].assign(resid=np.nan)
        at, power = settings(pdf, past["__y"].to_numpy(float))
        units = hidden or int(round((len(at) + len(xs) + 1) / 2))
        raw = link(past["__y"].to_numpy(float), power)
        mu, sd = np.nanmean(raw) if len(raw) else 0.0, np.nanstd(raw) if len(raw) else 0.0
        if len(raw) <= max(at) + 5 or not sd > 0:
            return out[[f.name for f in schema]]
        z = (raw - mu) / sd
        reg, reg_new = past[list(xs)].to_numpy(float), fut[list(xs)].to_numpy(float)
        if len(xs):
            rm, rs = reg.mean(0), reg.std(0)
            rs = np.where(rs > 0, rs, 1.0)
            reg, reg_new = (reg - rm) / rs, (reg_new - rm) / rs
        deep = max(at)
        x = np.column_stack([z[deep - k : len(z) - k] for k in at] + ([reg[deep:]] if len(xs) else []))
        ok = ~(np.isnan(x).any(1) | np.isnan(z[deep:]))
        name = "|".join(str(pdf[c].iloc[0]) for c in key)
        rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
        w = _train(x[ok], z[deep:][ok], units, networks, rounds, rng)
        if residuals:
            act = 1 / (1 + np.exp(-(x[ok][None] @ w[0] + w[1])))
            fitted = unlink((act @ w[2] + w[3]).mean(0)[:, 0] * sd + mu, power)
            out.iloc[np.flatnonzero(ok) + deep, -1] = past["__y"].to_numpy(float)[deep:][ok] - fitted
            return out[[f.name for f in schema]]
        run_z, preds = list(z), []
        for i in range(len(fut)):
            row = np.array([run_z[-k] for k in at] + list(reg_new[i] if len(xs) else []))
            run_z.append(_apply(w, row))
            preds.append(run_z[-1])
        out["mean"] = unlink(np.array(preds) * sd + mu, power)
        return out[[f.name for f in schema]]

    return spread(df, key, series).groupBy(*key).applyInPandas(run, schema)


def forecast_nnet_ahead(panel: Panel, y: str, h: int, **options) -> DataFrame:
    """Forecast ``h`` steps past the end of every series."""
    ends = panel.df.groupBy(*panel.key).agg(F.max(panel.index).alias("__end"))
    future = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h)))).select(
        *panel.key,
        shift("__end", F.col("h"), panel.grain).alias(panel.index),
        F.lit("test").alias("part"),
        F.col("h").cast("long").alias("h"),
    )
    past = panel.df.select(*panel.key, panel.index, y).withColumn("part", F.lit("train"))
    both = panel.on(past.unionByName(future, allowMissingColumns=True))
    return forecast_nnet(both, y, **options).drop("actual")
