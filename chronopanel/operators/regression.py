"""Least squares per series from Gram sums.

Spark reduces each series to the sums of products of its columns (partial sums
before the shuffle); Python sees only those k x k systems, a batch at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.tails import normal_quantile
from chronopanel.functions.transforms import Response
from chronopanel.panel import Panel, future_rows

FIT = "struct<coef:array<double>,inv:array<double>,rss:double,rank:int>"


def sweep(gram: np.ndarray, pivots: Sequence[int], tol: float = 1e-9):
    """Sweep a batch of Gram matrices (B, k, k) on ``pivots`` in order.

    A pivot that earlier ones explain is skipped, so its coefficient stays 0 and
    later columns are fitted as if it were absent.  Returns the swept matrices
    and the mask of used pivots.
    """
    a = gram.astype(float).copy()
    size = np.abs(np.einsum("bii->bi", gram)) + 1e-300
    used = np.zeros(a.shape[:2], dtype=bool)
    for j in pivots:
        d = a[:, j, j]
        ok = d > tol * size[:, j]
        d = np.where(ok, d, 1.0)
        row = a[:, j, :] / d[:, None]
        new = a - a[:, :, j][:, :, None] * row[:, None, :]
        new[:, j, :] = row
        new[:, :, j] = -a[:, :, j] / d[:, None]
        new[:, j, j] = 1 / d
        a = np.where(ok[:, None, None], new, a)
        used[:, j] = ok
    return a, used


def unpack(grams: pd.Series, k: int) -> np.ndarray:
    """Upper-triangle arrays to full symmetric matrices (B, k, k)."""
    flat = np.array([np.asarray(g, dtype=float) for g in grams]).reshape(-1, k * (k + 1) // 2)
    out = np.zeros((len(flat), k, k))
    iu = np.triu_indices(k)
    out[:, iu[0], iu[1]] = flat
    out[:, iu[1], iu[0]] = flat
    return out


def gram_sums(columns: Sequence[Column]) -> Column:
    """Aggregate: upper triangle of the column products, row by row."""
    cols = list(columns)
    return F.array(
        *[F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    )


def centred_sums(columns: Sequence[Column]) -> Column:
    """Aggregate: n, the column means, and the upper triangle of the centred products.

    Covariances are merged from partial means, so a large level costs no digits.
    """
    cols = list(columns)
    n = F.count(F.lit(1)).cast("double")
    return F.struct(
        n.alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.covar_pop(cols[i], cols[j]) * n for i in range(len(cols)) for j in range(i, len(cols))]).alias("gram"),
    )


def centred_solver(k: int):
    """UDF: centred sums of k columns and y (last) -> fit with the intercept first.

    ``inv`` is the inverse of the raw products with the intercept, put together
    from the centred inverse and the means.
    """

    @F.pandas_udf(FIT)
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sums in batches:
            if len(sums) == 0:
                yield pd.DataFrame({"coef": [], "inv": [], "rss": [], "rank": []})
                continue
            a, used = sweep(unpack(sums["gram"], k + 1), range(k))
            mean = np.array([np.asarray(m, float) for m in sums["mean"]])
            slope = np.where(used[:, :k], a[:, :k, k], 0.0)
            inner = np.where(used[:, :k, None] & used[:, None, :k], a[:, :k, :k], 0.0)
            cross = -np.einsum("bi,bij->bj", mean[:, :k], inner)
            inv = np.zeros((len(a), k + 1, k + 1))
            inv[:, 1:, 1:], inv[:, 0, 1:], inv[:, 1:, 0] = inner, cross, cross
            inv[:, 0, 0] = 1 / sums["n"].to_numpy() - np.einsum("bi,bi->b", cross, mean[:, :k])
            level = mean[:, k] - np.einsum("bi,bi->b", slope, mean[:, :k])
            yield pd.DataFrame(
                {
                    "coef": list(np.concatenate([level[:, None], slope], axis=1)),
                    "inv": list(inv.reshape(len(a), -1)),
                    "rss": np.maximum(a[:, k, k], 0.0),
                    "rank": (used[:, :k].sum(1) + 1).astype("int32"),
                }
            )

    return solve


def solver(k: int):
    """UDF: Gram array of k columns and y (last) -> coefficients, inverse, rss, rank."""

    @F.pandas_udf(FIT)
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for grams in batches:
            if len(grams) == 0:
                yield pd.DataFrame({"coef": [], "inv": [], "rss": [], "rank": []})
                continue
            a, used = sweep(unpack(grams, k + 1), range(k))
            both = used[:, :k, None] & used[:, None, :k]
            yield pd.DataFrame(
                {
                    "coef": list(np.where(used[:, :k], a[:, :k, k], 0.0)),
                    "inv": list(np.where(both, a[:, :k, :k], 0.0).reshape(len(a), -1)),
                    "rss": np.maximum(a[:, k, k], 0.0),
                    "rank": used[:, :k].sum(1).astype("int32"),
                }
            )

    return solve


def subset_solver(k: int, subsets: Sequence[Sequence[int]]):
    """UDF: one Gram array -> fits of several column subsets, in order."""
    subsets = [list(s) for s in subsets]

    @F.pandas_udf("array<struct<coef:array<double>,rss:double,rank:int>>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for grams in batches:
            if len(grams) == 0:
                yield pd.Series([], dtype=object)
                continue
            full = unpack(grams, k + 1)
            rows = [[] for _ in range(len(full))]
            for s in subsets:
                pick = [*s, k]
                a, used = sweep(full[:, pick][:, :, pick], range(len(s)))
                coef = np.zeros((len(full), k))
                coef[:, s] = np.where(used[:, : len(s)], a[:, : len(s), len(s)], 0.0)
                for i, cell in enumerate(rows):
                    cell.append(
                        {
                            "coef": coef[i].tolist(),
                            "rss": max(float(a[i, -1, -1]), 0.0),
                            "rank": int(used[i, : len(s)].sum()),
                        }
                    )
            yield pd.Series(rows)

    return solve


def fit_ols(
    df: DataFrame, key: Sequence[str], y: str, xs: Sequence[str], intercept: bool = True
) -> DataFrame:
    """One row per key: n, coef (intercept first), inv, rss, tss, rank.

    Rows with a NULL in any used column are left out; aliased columns get
    coefficient 0.
    """
    cols = [F.col(x).cast("double") for x in xs]
    yc = F.col(y).cast("double")
    full = yc.isNotNull()
    for c in cols:
        full = full & c.isNotNull()
    tss = (F.var_pop(yc) * F.count(yc)).alias("tss")
    gram, solve = (centred_sums, centred_solver) if intercept else (gram_sums, solver)
    sums = df.where(full).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), gram([*cols, yc]).alias("__g"), tss)
    out = sums.withColumn("__f", solve(len(cols))("__g"))
    return out.select(*key, "n", "tss", "__f.coef", "__f.inv", "__f.rss", "__f.rank")


def linear_value(xs: Sequence[str], coef: str = "coef", intercept: bool = True) -> Column:
    """Fitted value of a row that carries the coefficient array."""
    out = F.col(coef)[0] if intercept else F.lit(0.0)
    for i, x in enumerate(xs):
        out = out + F.col(coef)[i + int(intercept)] * F.col(x)
    return out


def augment_ols(
    df: DataFrame, fit: DataFrame, key: Sequence[str], y: str, xs: Sequence[str]
) -> DataFrame:
    """Adds ``fitted`` and ``resid``."""
    out = df.join(fit.select(*key, "coef"), list(key), "left")
    out = out.withColumn("fitted", linear_value(xs)).drop("coef")
    return out.withColumn("resid", F.col(y) - F.col("fitted"))


def glance(fit: DataFrame, key: Sequence[str]) -> DataFrame:
    """r2, adj_r2, sigma2, log_lik, aic, aicc, bic of fitted rows."""
    n, k, rss = F.col("n"), F.col("rank"), F.col("rss")
    logs = n * F.log(rss / n)
    r2 = 1 - F.try_divide(rss, F.col("tss"))
    return fit.select(
        *key,
        "n",
        F.col("rank").cast("long"),
        r2.alias("r2"),
        (1 - (1 - r2) * F.try_divide(n - 1, n - k)).alias("adj_r2"),
        F.try_divide(rss, n - k).alias("sigma2"),
        (-(n * (math.log(2 * math.pi) + 1) + logs) / 2).alias("log_lik"),
        (logs + 2 * (k + 1)).alias("aic"),
        (logs + 2 * (k + 1) + F.try_divide(2 * (k + 1) * (k + 2), n - k - 2)).alias("aicc"),
        (logs + (k + 1) * F.log(n)).alias("bic"),
    )


def tidy(fit: DataFrame, key: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Coefficient table: term, estimate, std_error, statistic."""
    k = len(terms)
    s2 = F.try_divide(F.col("rss"), F.col("n") - F.col("rank"))
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("term"),
                F.col("coef")[i].alias("estimate"),
                F.sqrt(s2 * F.col("inv")[i * k + i]).alias("std_error"),
            )
            for i, t in enumerate(terms)
        ]
    )
    out = fit.select(*key, F.explode(cells).alias("c")).select(*key, "c.*")
    return out.withColumn("statistic", F.try_divide("estimate", "std_error"))


def leave_one_out(
    df: DataFrame, fit: DataFrame, key: Sequence[str], y: str, xs: Sequence[str]
) -> DataFrame:
    """Mean squared leave-one-out error from the leverages (second pass over the rows)."""
    k = len(xs) + 1
    design = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    rows = df.join(fit.select(*key, "coef", "inv"), list(key))
    lev = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            lev = lev + design[i] * design[j] * F.col("inv")[i * k + j]
    err = (F.col(y) - linear_value(xs)) / (1 - lev)
    return rows.groupBy(*key).agg(F.avg(err * err).alias("cv"))


def glance_with_cv(df: DataFrame, fit: DataFrame, key: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """The glance row with the mean squared leave-one-out error ``cv``."""
    return glance(fit, key).join(leave_one_out(df, fit, key, y, xs), list(key))


def predict_ols(
    rows: DataFrame, fit: DataFrame, key: Sequence[str], xs: Sequence[str]
) -> DataFrame:
    """``mean`` and ``sd`` of new rows, with the parameter uncertainty in ``sd``."""
    k = len(xs) + 1
    design = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    out = rows.join(fit.select(*key, "n", "rank", "rss", "coef", "inv"), list(key))
    lev = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            lev = lev + design[i] * design[j] * F.col("inv")[i * k + j]
    s2 = F.try_divide(F.col("rss"), F.col("n") - F.col("rank"))
    out = out.withColumn("mean", linear_value(xs)).withColumn("sd", F.sqrt(s2 * (1 + lev)))
    return out.drop("n", "rank", "rss", "coef", "inv")


def fourier_columns(t: str, m: float, k: int) -> dict[str, Column]:
    """sin and cos pairs 1..k of a period ``m``; at half the period the sine is zero everywhere and left out."""
    out = {}
    for j in range(1, k + 1):
        angle = F.col(t) * (2 * math.pi * j / m)
        if 2 * j != m:
            out[f"s{j}"] = F.sin(angle)
        out[f"c{j}"] = F.cos(angle)
    return out


def forecast_tslm(
    panel: Panel, y: str, h: int, harmonics: int = 1, response: Response = Response(), period: int | None = None, level: float = 0.95
) -> DataFrame:
    """Trend and ``harmonics`` Fourier pairs, fitted to a transformed response and forecast ``h`` steps ahead.

    (key, h, index, median, mean, lower, upper) on the values' scale; the mean is
    bias-adjusted, the interval's ends are transformed quantiles.  Half the period of
    harmonics is the model with a dummy for every season.
    """
    key, m = list(panel.key), period or panel.period
    p = panel.with_position("t")
    waves = fourier_columns("t", m, harmonics)
    xs = ["t", *waves]
    fit = fit_ols(p.df.withColumns(waves).withColumn("__z", response.forward(y)), key, "__z", xs)
    ends = p.df.groupBy(*key).agg(F.max("t").alias("__last"))
    rows = future_rows(panel, h).join(ends, key).withColumn("t", F.col("__last") + F.col("h"))
    out = predict_ols(rows.withColumns(waves), fit, key, xs).withColumnRenamed("mean", "__mu")
    reach = F.col("sd") * normal_quantile((1 + level) / 2)
    return out.select(
        *key, "h", panel.index, response.median("__mu").alias("median"), response.mean("__mu", "sd").alias("mean"),
        response.median(F.col("__mu") - reach).alias("lower"), response.median(F.col("__mu") + reach).alias("upper"),
    )


def with_level(fit: Column) -> Column:
    """A fit of centred columns with the intercept put first; means are in ``g.mean``, y's last."""
    mean = F.col("g.mean")
    share = F.aggregate(F.zip_with(fit["coef"], mean, lambda b, m: F.coalesce(b * m, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    level = F.element_at(mean, -1) - share
    return F.struct(F.concat(F.array(level), fit["coef"]).alias("coef"), fit["rss"].alias("rss"), (fit["rank"] + 1).alias("rank"))


def fourier_fits(panel: Panel, y: str, k_max: int, period: int | None = None) -> DataFrame:
    """Trend plus 1..k_max harmonics per series, k_max at most half the period: (key, k, n, rank, rss, tss, coef).

    One set of sums covers the largest model; the smaller ones are sub-blocks.
    """
    m = period or panel.period
    p = panel.with_position("t")
    waves = fourier_columns("t", m, k_max)
    df = p.df.withColumns(waves).where(F.col(y).isNotNull())
    yc = F.col(y).cast("double")
    cols = [F.col("t").cast("double"), *[F.col(c) for c in waves], yc]
    sums = df.groupBy(*panel.key).agg(
        F.count(F.lit(1)).alias("n"), centred_sums(cols).alias("g"), (F.var_pop(yc) * F.count(yc)).alias("tss")
    )
    subsets = [range(1 + 2 * j - (2 * j >= m)) for j in range(1, k_max + 1)]
    fits = sums.withColumn("f", F.transform(subset_solver(len(cols) - 1, subsets)("g.gram"), with_level))
    out = fits.select(*panel.key, "n", "tss", F.posexplode("f").alias("k", "f"))
    return out.select(
        *panel.key, (F.col("k") + 1).cast("long").alias("k"), "n", "tss", "f.coef", "f.rss", "f.rank"
    )


def fit_seasonal(
    df: DataFrame,
    key: Sequence[str],
    y: str,
    xs: Sequence[str],
    season: str = "season",
    slope_on: str | None = None,
) -> DataFrame:
    """Regression on season dummies plus ``xs``, without building the dummies.

    Season means are taken out inside each (key, season) group, so the solve
    sees only the other columns.  With ``slope_on`` every season also has its
    own slope on that column.  Returns one row per (key, season) with ``alpha``
    (season level), ``slope`` and the shared ``coef``, plus n, rank, rss, tss.
    """
    cols = [F.col(x).cast("double") for x in xs]
    yc = F.col(y).cast("double")
    full = yc.isNotNull()
    for c in cols:
        full = full & c.isNotNull()
    vals = cols + [yc]
    k = len(vals)
    lead = [F.col(slope_on).cast("double")] if slope_on else []
    allv = lead + vals
    k_all = len(allv)
    per_season = df.where(full).groupBy(*key, season).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.avg(v).alias(f"__m{i}") for i, v in enumerate(allv)],
        *[
            F.covar_pop(allv[i], allv[j]).alias(f"__c{i}_{j}")
            for i in range(k_all)
            for j in range(i, k_all)
        ],
    )

    def within(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"__c{i}_{j}") * F.col("__n")

    off = len(lead)
    if slope_on:
        def part(i: int, j: int) -> Column:
            own = F.when(within(0, 0) > 1e-9, within(0, i + 1) * within(0, j + 1) / within(0, 0))
            return within(i + 1, j + 1) - F.coalesce(own, F.lit(0.0))
    else:
        part = within
    g = F.array(*[F.sum(part(i, j)) for i in range(k) for j in range(i, k)])
    total_mean = F.sum(F.col("__n") * F.col(f"__m{off + k - 1}")) / F.sum("__n")
    between = F.sum(F.col("__n") * F.pow(F.col(f"__m{off + k - 1}"), 2)) - F.sum("__n") * F.pow(total_mean, 2)
    slopes = F.count_if(within(0, 0) > 1e-9) if slope_on else F.lit(0)
    solved = per_season.groupBy(*key).agg(
        F.sum("__n").alias("n"),
        g.alias("__g"),
        (F.count(F.lit(1)) + slopes).alias("__seasons"),
        (F.sum(within(off + k - 1, off + k - 1)) + between).alias("tss"),
    ).withColumn("__f", solver(k - 1)("__g"))
    solved = solved.select(
        *key,
        "n",
        "tss",
        F.col("__f.rss").alias("rss"),
        F.col("__f.coef").alias("coef"),
        (F.col("__f.rank") + F.col("__seasons")).cast("int").alias("rank"),
    )
    out = per_season.join(solved, list(key))
    adj = F.col(f"__m{off + k - 1}")
    for i in range(k - 1):
        adj = adj - F.col("coef")[i] * F.col(f"__m{off + i}")
    slope = F.lit(0.0)
    if slope_on:
        num = within(0, k)
        for i in range(k - 1):
            num = num - F.col("coef")[i] * within(0, i + 1)
        slope = F.when(within(0, 0) > 1e-9, num / within(0, 0)).otherwise(F.lit(0.0))
        adj = adj - slope * F.col("__m0")
    return out.select(
        *key, season, adj.alias("alpha"), slope.alias("slope"), "coef", "n", "rank", "rss", "tss"
    )


def predict_seasonal(
    rows: DataFrame,
    fit: DataFrame,
    key: Sequence[str],
    xs: Sequence[str],
    season: str = "season",
    slope_on: str | None = None,
    name: str = "mean",
) -> DataFrame:
    """Value of the seasonal regression for rows that carry the design columns."""
    out = rows.join(fit.select(*key, season, "alpha", "slope", "coef"), [*key, season], "left")
    value = F.col("alpha")
    if slope_on:
        value = value + F.col("slope") * F.col(slope_on)
    for i, x in enumerate(xs):
        value = value + F.col("coef")[i] * F.col(x)
    return out.withColumn(name, value).drop("alpha", "slope", "coef")


def season_summary(fit: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key of a seasonal fit, ready for :func:`glance`."""
    return fit.groupBy(*key).agg(
        F.first("n").alias("n"), F.first("rank").alias("rank"), F.first("rss").alias("rss"), F.first("tss").alias("tss")
    )


def knot_columns(t: str, knots: Sequence[float]) -> dict[str, Column]:
    """Extra slopes of a piecewise linear trend."""
    return {f"knot{i + 1}": F.greatest(F.col(t) - F.lit(float(k)), F.lit(0.0)) for i, k in enumerate(knots)}
