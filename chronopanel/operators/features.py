"""Per-series features and tests: autocorrelation, stationarity, shape."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from chronopanel.functions.tails import chi2_tail
from chronopanel.operators.regression import fit_ols
from chronopanel.operators.windows import difference, framed
from chronopanel.panel import Panel


def _centred(panel: Panel, x: str) -> Panel:
    """Adds ``__e``: the value minus its series mean."""
    v = F.col(x).cast("double")
    if panel.block is None:
        return panel.on(panel.df.withColumn("__e", v - F.avg(v).over(panel.whole())))
    means = panel.df.groupBy(*panel.key).agg(F.avg(v).alias("__m"))
    df = panel.df.join(means, list(panel.key))
    return panel.on(df.withColumn("__e", v - F.col("__m")).drop("__m"))


def acf_wide(panel: Panel, x: str, lags: Sequence[int], prefix: str = "r") -> DataFrame:
    """One row per series: ``n`` and one autocorrelation column per lag.

    All lags share one window and one aggregation.  With missing values the lag
    sums are scaled by their number of pairs plus the lag.
    """
    p = _centred(panel, x)
    p = framed(p, {f"__l{k}": (lambda w, k=k: F.lag("__e", k).over(w)) for k in lags}, max(lags))
    e = F.col("__e")
    mean_sq = F.avg(e * e)

    def r(k: int) -> Column:
        prod = e * F.col(f"__l{k}")
        return F.try_divide(F.try_divide(F.sum(prod), F.count(prod) + k), mean_sq)

    return p.df.groupBy(*panel.key).agg(
        F.count(e).alias("n"), *[r(k).alias(f"{prefix}{k}") for k in lags]
    )


def acf(panel: Panel, x: str, lag_max: int) -> DataFrame:
    """Long autocorrelation table (key, lag, acf)."""
    lags = range(1, lag_max + 1)
    wide = acf_wide(panel, x, lags)
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"r{k}").alias("acf")) for k in lags])
    return wide.select(*panel.key, F.explode(cells).alias("c")).select(*panel.key, "c.lag", "c.acf")


@F.pandas_udf(ArrayType(DoubleType()))
def _partials(rs: pd.Series) -> pd.Series:
    """Durbin-Levinson recursion over arrays of autocorrelations."""
    out = []
    for r in rs:
        r = np.asarray(r, dtype=float)
        phi, res = np.zeros(0), []
        for k in range(len(r)):
            den = 1 - phi @ r[:k]
            a = (r[k] - phi @ r[:k][::-1]) / den if den != 0 else np.nan
            phi = np.append(phi - a * phi[::-1], a)
            res.append(a)
        out.append(res)
    return pd.Series(out)


def pacf_wide(panel: Panel, x: str, lag_max: int) -> DataFrame:
    lags = range(1, lag_max + 1)
    wide = acf_wide(panel, x, lags)
    return wide.select(*panel.key, _partials(F.array(*[f"r{k}" for k in lags])).alias("pacf"))


def ar_order(partials: Column, n: Column) -> Column:
    """Order of least AIC, from the partial autocorrelations: each takes its square off the residual variance."""
    empty = F.array().cast("array<struct<aic:double,k:bigint>>")
    start = F.struct(F.lit(0.0).alias("logs"), F.lit(0).cast("long").alias("k"), empty.alias("all"))

    def step(state: Column, f: Column) -> Column:
        logs, k = state["logs"] + F.log(F.greatest(1 - f * f, F.lit(1e-12))), state["k"] + 1
        return F.struct(logs.alias("logs"), k.alias("k"), F.concat(state["all"], F.array(F.struct((n * logs + 2 * k).alias("aic"), k.alias("k")))).alias("all"))

    orders = F.aggregate(F.transform(partials, lambda f: F.coalesce(F.nanvl(f, F.lit(0.0)), F.lit(0.0))), start, step, lambda s: s["all"])
    return F.coalesce(F.array_min(orders)["k"], F.lit(1)).cast("long")


def pacf(panel: Panel, x: str, lag_max: int) -> DataFrame:
    """Long partial autocorrelation table (key, lag, pacf)."""
    out = pacf_wide(panel, x, lag_max).select(*panel.key, F.posexplode("pacf").alias("lag", "pacf"))
    return out.select(*panel.key, (F.col("lag") + 1).cast("long").alias("lag"), F.nanvl("pacf", F.lit(None)).alias("pacf"))


def portmanteau(panel: Panel, x: str, lag: int = 1, dof: int = 0) -> DataFrame:
    """Ljung-Box and Box-Pierce statistics with their tail probabilities."""
    wide = acf_wide(panel, x, range(1, lag + 1))
    n = F.col("n")
    bp = n * sum((F.pow(f"r{k}", 2) for k in range(1, lag + 1)), F.lit(0.0))
    lb = n * (n + 2) * sum((F.pow(f"r{k}", 2) / (n - k) for k in range(1, lag + 1)), F.lit(0.0))
    out = wide.select(*panel.key, "n", lb.alias("lb_stat"), bp.alias("bp_stat"))
    return out.withColumn("lb_pvalue", chi2_tail(F.col("lb_stat"), lag - dof)).withColumn(
        "bp_pvalue", chi2_tail(F.col("bp_stat"), lag - dof)
    )


# Critical values of the level-stationarity statistic: fixed values (p, value).
KPSS_TABLE = [(0.1, 0.347), (0.05, 0.463), (0.025, 0.574), (0.01, 0.739)]


def _kpss_pvalue(stat: Column) -> Column:
    out = F.when(stat <= KPSS_TABLE[0][1], F.lit(KPSS_TABLE[0][0]))
    for (p0, c0), (p1, c1) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        out = out.when(stat <= c1, p0 + (stat - c0) * ((p1 - p0) / (c1 - c0)))
    return out.when(stat > KPSS_TABLE[-1][1], F.lit(KPSS_TABLE[-1][0]))


def _running_products(panel: Panel, e: str) -> DataFrame:
    """Per series: ``n``, sums of squares of the running sum and of ``e``, the lag product of the running sum, and the lag.

    With C the running sum of a column that sums to zero and L one more than the
    bandwidth 4(n/100)^(1/4), the Bartlett long-run variance times n equals
    2/L (sum C_i^2 - sum C_i C_(i-L)): one lag product replaces the whole set of
    autocovariances.  L differs between series, so the lag is a second ordering of
    the same rows by position, joined on (key, position - L); any length works.
    """
    w, whole, key = panel.window(), panel.whole(), list(panel.key)
    size = F.count(e).over(whole)
    df = panel.df.withColumns(
        {
            "__cum": F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "__at": F.row_number().over(w),
            "__width": (F.floor(4 * F.pow(size / 100, 0.25)) + 1).cast("int"),
        }
    ).select(*key, F.col(e).alias("__e"), "__cum", "__at", "__width")
    ahead = df.select(*key, (F.col("__at") + F.col("__width")).alias("__at"), F.col("__cum").alias("__back"))
    df = df.join(ahead, [*key, "__at"], "left")
    c = F.col("__cum")
    return df.groupBy(*panel.key).agg(
        F.count("__e").alias("n"),
        F.sum(c * c).alias("__s2"),
        F.coalesce(F.sum(c * F.col("__back")), F.lit(0.0)).alias("__sl"),
        F.sum(F.col("__e") * F.col("__e")).alias("__g0"),
        F.max("__width").alias("__l"),
    )


def kpss(panel: Panel, x: str) -> DataFrame:
    """KPSS level-stationarity statistic with the short Bartlett bandwidth."""
    sums = _running_products(_centred(panel.on(panel.df.where(F.col(x).isNotNull())), x), "__e")
    long_run = 2 * (F.col("__s2") - F.col("__sl")) / F.col("__l")
    stat = F.when(F.col("__g0") > 1e-12, F.try_divide(F.col("__s2"), F.col("n") * long_run))
    return sums.select(*panel.key, "n", stat.alias("kpss_stat")).withColumn(
        "kpss_pvalue", _kpss_pvalue(F.col("kpss_stat"))
    )


def long_run_variance(panel: Panel, e: str) -> DataFrame:
    """(key, n, short, long): variance of a column that sums to zero, alone and with its autocovariances under Bartlett weights."""
    sums, n = _running_products(panel, e), F.col("n")
    long_run = 2 * (F.col("__s2") - F.col("__sl")) / F.col("__l") / n
    return sums.select(*panel.key, "n", (F.col("__g0") / n).alias("short"), long_run.alias("long"))


# Critical values of the unit-root statistic with a constant: fixed values (p, limit, by 1/n, by 1/n^2).
UNIT_ROOT_TABLE = [(0.01, -3.4335, -5.999, -29.25), (0.05, -2.8621, -2.738, -8.36), (0.1, -2.5671, -1.438, -4.48)]


def phillips_perron(panel: Panel, x: str) -> DataFrame:
    """Phillips-Perron unit-root statistic with a constant, and its p-value between 0.01 and 0.1.

    One lag is the regressor, so the fit is one aggregation of sums; the residuals'
    long-run variance corrects its t value.  Series without spread get NULL.
    """
    key, v = list(panel.key), F.col(x).cast("double")
    p = panel.on(panel.df.where(F.col(x).isNotNull()).select(*key, panel.index, v.alias("__y")))
    p = framed(p, {"__x": lambda w: F.lag("__y").over(w)}, 1)
    p = p.on(p.df.where(F.col("__x").isNotNull()))
    sums = p.df.groupBy(*key).agg(
        F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("level"), F.regr_sxx("__y", "__x").alias("sxx"), F.var_pop("__y").alias("spread")
    )
    rows = p.df.join(sums.select(*key, "slope", "level"), key)
    rows = rows.withColumn("__u", F.col("__y") - F.col("level") - F.col("slope") * F.col("__x"))
    out = long_run_variance(p.on(rows.where(F.col("__u").isNotNull())), "__u").join(sums, key)
    n, short, long = F.col("n"), F.col("short"), F.col("long")
    t_value = F.try_divide(F.col("slope") - 1, F.sqrt(F.try_divide(short * n / (n - 2), F.col("sxx"))))
    shift = F.try_divide((long - short) / 2, F.sqrt(long) * F.sqrt(F.col("spread") / n))
    stat = F.when((n > 2) & (short > 1e-12) & (long > 0), F.sqrt(short / long) * t_value - shift)
    limits = [(q, a + b / n + c / (n * n)) for q, a, b, c in UNIT_ROOT_TABLE]
    value = F.when(F.col("pp_stat") <= limits[0][1], F.lit(limits[0][0]))
    for (q0, c0), (q1, c1) in zip(limits, limits[1:]):
        value = value.when(F.col("pp_stat") <= c1, q0 + (F.col("pp_stat") - c0) * (q1 - q0) / (c1 - c0))
    value = value.when(F.col("pp_stat").isNotNull(), F.lit(limits[-1][0]))
    return out.select(*key, "n", stat.alias("pp_stat")).withColumn("pp_pvalue", value).drop("n")


def ndiffs(panel: Panel, x: str, alpha: float = 0.05) -> DataFrame:
    """Differences (0..2) until the level-stationarity test no longer rejects."""
    one = difference(panel, x, [1], "__x1")
    p0 = kpss(panel, x).select(*panel.key, F.col("kpss_pvalue").alias("p0"))
    p1 = kpss(one, "__x1").select(*panel.key, F.col("kpss_pvalue").alias("p1"))
    out = p0.join(p1, list(panel.key), "left")
    d = F.when(F.coalesce("p0", F.lit(1.0)) >= alpha, 0).when(F.coalesce("p1", F.lit(1.0)) >= alpha, 1)
    return out.select(*panel.key, d.otherwise(2).cast("long").alias("ndiffs"))


def _strength(part: str, rest: str) -> Column:
    """Aggregate: share of the variance of part + rest that the rest leaves."""
    share = 1 - F.try_divide(F.var_samp(rest), F.var_samp(F.col(rest) + F.col(part)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def seasonal_strength(panel: Panel, seasonal: str, rest: str) -> DataFrame:
    """Only the seasonal strength of a decomposed panel: one aggregation."""
    df = panel.df.where(F.col(rest).isNotNull())
    return df.groupBy(*panel.key).agg(_strength(seasonal, rest).alias("seasonal_strength"))


def strengths(
    panel: Panel, trend: str, seasonal: str, rest: str, period: int | None = None
) -> DataFrame:
    """Feature row of a decomposed panel: strengths, peak, trough, spikiness, trend shape."""
    m = period or panel.period
    df = panel.df.where(F.col(rest).isNotNull()).select(
        *panel.key, panel.index, F.col(trend).alias("tr"), F.col(seasonal).alias("se"), F.col(rest).alias("re")
    )
    p = panel.on(df).with_position("t").with_season("s", m)
    whole = panel.whole()
    n = F.count(F.lit(1)).over(whole)
    centre = (n + 1) / 2
    p = p.on(
        p.df.withColumns(
            {
                "__n": n,
                "__m": F.avg("re").over(whole),
                "__v": F.var_samp("re").over(whole),
                "__u": F.col("t") - centre,
            }
        )
    )
    dev = F.pow(F.col("re") - F.col("__m"), 2)
    nn = F.col("__n")
    loo = (F.col("__v") * (nn - 1) - dev * nn / (nn - 1)) / (nn - 2)
    bent = F.pow("__u", 2) - (nn * nn - 1) / 12
    df = p.df.withColumns({"__loo": loo, "__bent": bent})

    shape = df.groupBy(*panel.key).agg(
        _strength("tr", "re").alias("trend_strength"),
        _strength("se", "re").alias("seasonal_strength"),
        F.var_samp("__loo").alias("spikiness"),
        F.try_divide(F.sum(F.col("tr") * F.col("__u")), F.sqrt(F.sum(F.pow("__u", 2)))).alias("linearity"),
        F.try_divide(F.sum(F.col("tr") * F.col("__bent")), F.sqrt(F.sum(F.pow("__bent", 2)))).alias("curvature"),
    )
    by_season = df.groupBy(*panel.key, "s").agg(F.avg("se").alias("f"))
    turn = by_season.groupBy(*panel.key).agg(
        F.pmod(F.max_by("s", "f") + 1, F.lit(m)).cast("long").alias("seasonal_peak"),
        F.pmod(F.min_by("s", "f") + 1, F.lit(m)).cast("long").alias("seasonal_trough"),
    )
    rest_acf = acf_wide(panel.on(df.select(*panel.key, panel.index, "re")), "re", range(1, 11))
    rest_acf = rest_acf.select(*panel.key, F.col("r1").alias("rest_acf1"), _sum_sq(10).alias("rest_acf10"))
    return shape.join(turn, list(panel.key)).join(rest_acf, list(panel.key))


def nsdiffs(strength_table: DataFrame, key: Sequence[str], limit: float = 0.64) -> DataFrame:
    """1 where the seasonal strength asks for a seasonal difference, else 0."""
    flag = F.when(F.col("seasonal_strength") > limit, 1).otherwise(0)
    return strength_table.select(*key, flag.cast("long").alias("nsdiffs"))


def _sum_sq(k: int, prefix: str = "r") -> Column:
    return sum((F.pow(f"{prefix}{i}", 2) for i in range(2, k + 1)), F.pow(f"{prefix}1", 2))


def feat_acf(panel: Panel, x: str, period: int | None = None) -> DataFrame:
    """Autocorrelation features of the series and its first two differences."""
    m = period or panel.period
    lags = sorted({*range(1, 11), m})
    base = acf_wide(panel, x, lags).select(
        *panel.key,
        F.col("r1").alias("acf1"),
        _sum_sq(10).alias("acf10"),
        F.col(f"r{m}").alias("season_acf1"),
    )
    one = difference(panel, x, [1], "__x1")
    two = difference(one, "__x1", [1], "__x2")

    def of(p: Panel, col: str, name: str) -> DataFrame:
        wide = acf_wide(p.on(p.df.where(F.col(col).isNotNull())), col, range(1, 11))
        return wide.select(*panel.key, F.col("r1").alias(f"{name}_acf1"), _sum_sq(10).alias(f"{name}_acf10"))

    out = base.join(of(one, "__x1", "diff1"), list(panel.key), "left")
    return out.join(of(two, "__x2", "diff2"), list(panel.key), "left")


def guerrero(
    panel: Panel, x: str, period: int | None = None, lower: float = -0.9, upper: float = 2.0, step: float = 0.01
) -> DataFrame:
    """Box-Cox lambda with the most stable relation of spread to level over blocks."""
    m = max(2, period or panel.period)
    p = panel.with_position("t")
    n = F.max("t").over(panel.whole())
    v = F.col(x).cast("double")
    back = F.floor((n - F.col("t")) / m)
    df = p.df.select(*panel.key, v.alias("v"), back.alias("__blk"), F.floor(n / m).alias("__nb"))
    df = df.where(F.col("__blk") < F.col("__nb"))
    blocks = df.groupBy(*panel.key, "__blk").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    # A series' blocks are n / m pairs of numbers; the grid is folded over them in the JVM.
    cells = F.sort_array(F.collect_list(F.when(F.col("sd").isNotNull(), F.struct("__blk", "mu", "sd"))))
    series = blocks.groupBy(*panel.key).agg(cells.alias("__c"))
    count = int(round((upper - lower) / step)) + 1

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def spread(ratios: Column) -> Column:
        mean = total(ratios) / F.size(ratios)
        around = F.transform(F.array(mean), lambda m: F.sqrt(F.try_divide(total(F.transform(ratios, lambda r: (r - m) * (r - m))), F.size(ratios) - 1)))
        return F.try_divide(F.get(around, F.lit(0)), mean)

    def tried(i: Column) -> Column:
        lam = F.lit(lower) + i * step
        ratios = F.transform("__c", lambda c: c["sd"] / F.pow(c["mu"], 1 - lam))
        return F.struct(F.get(F.transform(F.array(ratios), spread), F.lit(0)).alias("cv"), lam.alias("lam"))

    grid = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), tried)
    best = F.array_min(F.filter(grid, lambda g: g["cv"].isNotNull()))
    return series.select(*panel.key, best["lam"].alias("lambda_guerrero"))


def tiled(panel: Panel, x: str, width: int | None = None) -> DataFrame:
    """Variance of the means and variances of non-overlapping tiles of the scaled series."""
    k = width or max(panel.period, 10)
    p = panel.with_position("t")
    whole = panel.whole()
    v = F.col(x).cast("double")
    z = F.try_divide(v - F.avg(v).over(whole), F.stddev_samp(v).over(whole))
    df = p.df.select(*panel.key, z.alias("z"), F.floor((F.col("t") - 1) / k).alias("tile"))
    tiles = df.groupBy(*panel.key, "tile").agg(F.avg("z").alias("m"), F.var_samp("z").alias("v"))
    return tiles.groupBy(*panel.key).agg(
        F.var_samp("m").alias("var_tiled_mean"), F.var_samp("v").alias("var_tiled_var")
    )


def level_shifts(panel: Panel, x: str, width: int | None = None) -> DataFrame:
    """Largest change of mean and variance between two neighbouring windows, and the last row before it."""
    k = width or max(panel.period, 10)

    def shift_of(agg):
        def expr(w):
            left, right = w.rowsBetween(-k + 1, 0), w.rowsBetween(1, k)
            full = (F.count(x).over(left) == k) & (F.count(x).over(right) == k)
            return F.when(full, F.abs(agg(x).over(right) - agg(x).over(left)))

        return expr

    p = framed(panel.with_position("t"), {"__lm": shift_of(F.avg), "__lv": shift_of(F.var_samp)}, k, k)

    def largest(c: str) -> Column:
        # Of equal changes the first.
        return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("t")).alias("t"))))

    out = p.df.groupBy(*panel.key).agg(largest("__lm").alias("m"), largest("__lv").alias("v"))
    return out.select(
        *panel.key, F.col("m.v").alias("shift_level_max"), (-F.col("m.t")).alias("shift_level_index"), F.col("v.v").alias("shift_var_max"), (-F.col("v.t")).alias("shift_var_index")
    )


def kl_shift(panel: Panel, x: str, width: int | None = None, grid: int = 50) -> DataFrame:
    """Largest Kullback-Leibler divergence between the densities of two neighbouring windows, and the last row before it.

    Every value spreads as a normal kernel of the series' rule-of-thumb bandwidth over
    a grid from its smallest to its largest value; a window's density is the mean of
    its rows, so one pair of frames a grid point serves all windows.  Series of fewer
    than two windows get NULL.
    """
    k, v, key = width or max(panel.period, 10), F.col(x).cast("double"), list(panel.key)
    p = panel.on(panel.df.where(F.col(x).isNotNull()).select(*key, panel.index, v.alias("__v"))).with_position("t")
    quarter = F.percentile("__v", F.array(F.lit(0.25), F.lit(0.75)))
    stats = p.df.groupBy(*key).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.stddev_samp("__v").alias("sd"), quarter.alias("q"), F.count(F.lit(1)).alias("n"))
    narrow = F.nullif(F.least(F.col("sd"), (F.col("q")[1] - F.col("q")[0]) / 1.34), F.lit(0.0))
    band = 0.9 * F.coalesce(narrow, F.nullif("sd", F.lit(0.0)), F.lit(1.0)) * F.pow(F.col("n"), -0.2)
    stats = stats.select(*key, "lo", ((F.col("hi") - F.col("lo")) / (grid - 1)).alias("step"), band.alias("band"))
    rows = p.df.join(stats, key).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (F.col("lo") + F.col("g") * F.col("step") - F.col("__v")) / F.col("band")
    least = math.exp(-38 * 38 / 2) / math.sqrt(2 * math.pi)
    rows = rows.select(*key, "t", "g", "step", F.greatest(F.exp(-z * z / 2) / (F.col("band") * math.sqrt(2 * math.pi)), F.lit(least)).alias("d"))
    cell = Panel(rows, (*key, "g"), "t", block=panel.block, position="t")

    def mean(first: int, last: int):
        def expr(w):
            frame = w.rowsBetween(first, last)
            return F.when(F.count("d").over(frame) == k, F.avg("d").over(frame))

        return expr

    cell = framed(cell, {"left": mean(-k + 1, 0), "right": mean(1, k)}, k, k)
    part = F.col("left") * (F.ln("left") - F.ln("right")) * F.col("step")
    each = cell.df.groupBy(*key, "t").agg(F.sum(part).alias("kl"))
    top = F.max(F.when(F.col("kl").isNotNull(), F.struct("kl", (-F.col("t")).alias("t"))))
    out = each.groupBy(*key).agg(top.alias("top"))
    return out.select(*key, F.col("top.kl").alias("shift_kl_max"), (-F.col("top.t")).alias("shift_kl_index"))


def spectral_entropy(panel: Panel, x: str, lags: int = 12, points: int = 32) -> DataFrame:
    """Entropy of the normalised spectral density, between 0 (one frequency) and 1 (white noise).

    The density is the Fourier transform of the autocorrelations under Bartlett
    weights, at evenly spaced frequencies: sums of cosines over the ``lags`` numbers that
    one aggregation gives.
    """
    wide = acf_wide(panel, x, range(1, lags + 1))
    rs = F.array(*[F.coalesce(F.col(f"r{k}"), F.lit(0.0)) for k in range(1, lags + 1)])

    def density(j: Column) -> Column:
        def add(total: Column, k: Column) -> Column:
            return total + (1 - k / (lags + 1)) * F.get("rs", k - 1) * F.cos(j * k * (math.pi / points))

        return F.greatest(1 + 2 * F.aggregate(F.sequence(F.lit(1), F.lit(lags)), F.lit(0.0), add), F.lit(0.0))

    out = wide.select(*panel.key, "r1", rs.alias("rs")).withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(points)), density))
    total = F.aggregate("s", F.lit(0.0), lambda a, b: a + b)
    out = out.withColumn("total", total)

    def term(a: Column, s: Column) -> Column:
        share = s / F.col("total")
        return a - F.when(share > 0, share * F.ln(share)).otherwise(0.0)

    entropy = F.aggregate("s", F.lit(0.0), term) / math.log(points + 1)
    return out.select(*panel.key, F.when(F.col("r1").isNotNull(), entropy).alias("spectral_entropy"))


def hurst(panel: Panel, x: str, least: int = 3) -> DataFrame:
    """Hurst exponent by rescaled ranges: the slope of log range over log scale, scales 2**least, doubled up to the length.

    A window's range is that of the running sum of its centred values, over their
    standard deviation; windows without spread count for nothing, series with fewer
    than two scales get NULL.  Every scale cuts a series into windows, which are the
    groups, so no task sees more than the largest.
    """
    key, v = list(panel.key), F.col(x).cast("double")
    p = panel.on(panel.df.where(F.col(x).isNotNull()).select(*key, panel.index, v.alias("__v"))).with_position("t")
    sizes = p.df.groupBy(*key).agg(F.max("t").alias("n"))
    rows = p.df.join(sizes.where(F.col("n") >= 2 ** (least + 1)), key)
    rows = rows.withColumn("size", F.explode(F.sequence(F.lit(least), F.floor(F.log2("n")).cast("int"))))
    rows = rows.withColumn("size", F.pow(F.lit(2), F.col("size")).cast("long")).withColumn("tile", F.floor((F.col("t") - 1) / F.col("size")))
    rows = rows.where((F.col("tile") + 1) * F.col("size") <= F.col("n"))
    tile = Window.partitionBy(*key, "size", "tile")
    rows = rows.withColumn("__c", F.col("__v") - F.avg("__v").over(tile))
    rows = rows.withColumn("__sum", F.sum("__c").over(tile.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    spread = F.when(F.max("__v") > F.min("__v"), F.stddev_pop("__v"))
    tiles = rows.groupBy(*key, "size", "tile").agg(((F.max("__sum") - F.min("__sum")) / spread).alias("rs"))
    scales = tiles.groupBy(*key, "size").agg(F.avg("rs").alias("rs")).where(F.col("rs") > 0)
    slopes = scales.groupBy(*key).agg(F.regr_slope(F.ln("rs"), F.ln("size")).alias("coef_hurst"))
    return p.df.select(*key).distinct().join(slopes, key, "left")


def feat_pacf(panel: Panel, x: str, period: int | None = None) -> DataFrame:
    """Sums of the first five squared partial autocorrelations of the series and its differences, and the one at the season."""
    m, key = period or panel.period, list(panel.key)

    def five(p: Panel, c: str, name: str, more: int = 0) -> DataFrame:
        wide = pacf_wide(p, c, max(5, more))
        total = F.aggregate(F.slice("pacf", 1, 5), F.lit(0.0), lambda a, b: a + b * b)
        season = [F.get("pacf", F.lit(more - 1)).alias("season_pacf")] if more > 1 else []
        return wide.select(*key, F.nanvl(total, F.lit(None)).alias(name), *season)

    one, two = difference(panel, x, [1], "__x1"), difference(panel, x, [1, 1], "__x2")
    tables = [five(panel, x, "pacf5", m), five(one, "__x1", "diff1_pacf5"), five(two, "__x2", "diff2_pacf5")]
    return reduce(lambda a, b: a.join(b, key, "left"), tables)


def crossings(panel: Panel, x: str) -> DataFrame:
    """Crossings of the median, and the longest run inside one of ten value bands."""
    whole = panel.whole()
    v = F.col(x).cast("double")
    lo, hi = F.min(v).over(whole), F.max(v).over(whole)
    band = F.least(F.floor(F.try_divide(v - lo, hi - lo) * 10), F.lit(9))
    df = panel.df.withColumns(
        {"__up": v > F.median(v).over(whole), "__band": F.coalesce(band, F.lit(0))}
    )
    p = framed(
        panel.on(df),
        {
            "__cross": lambda w: F.col("__up") != F.lag("__up").over(w),
            "__new": lambda w: (F.col("__band") != F.coalesce(F.lag("__band").over(w), F.lit(-1))).cast("long"),
        },
        1,
    )
    rows = panel.window().rowsBetween(Window.unboundedPreceding, 0)
    runs = p.df.withColumn("__run", F.sum("__new").over(rows))
    runs = runs.groupBy(*panel.key, "__run").agg(
        F.count(F.lit(1)).alias("len"), F.count_if("__cross").alias("c")
    )
    return runs.groupBy(*panel.key).agg(
        F.sum("c").alias("n_crossing_points"), F.max("len").alias("longest_flat_spot")
    )


def intermittency(panel: Panel, x: str) -> DataFrame:
    """Zero runs and the spread of the non-zero values."""
    v = F.col(x).cast("double")
    df = panel.df.withColumn("__z", v == 0)
    p = framed(
        panel.on(df).with_position("t"),
        {"__start": lambda w: (F.col("__z") & ~F.coalesce(F.lag("__z").over(w), F.lit(False))).cast("long")},
        1,
    )
    nz = F.when(v != 0, v)
    t, n = F.col("t"), F.count(F.lit(1))
    first, last = F.min(F.when(v != 0, t)), F.max(F.when(v != 0, t))
    return p.df.groupBy(*panel.key).agg(
        F.coalesce(F.try_divide(F.count_if("__z"), F.sum("__start")), F.lit(0.0)).alias("zero_run_mean"),
        F.pow(F.try_divide(F.stddev_samp(nz), F.avg(nz)), 2).alias("nonzero_squared_cv"),
        (F.coalesce(first - 1, n) / n).alias("zero_start_prop"),
        (F.coalesce(n - last, n) / n).alias("zero_end_prop"),
    )


def arch_lm(panel: Panel, x: str, lags: int = 12) -> DataFrame:
    """R squared of the squared, centred series on its own lags."""
    p = _centred(panel, x)
    p = p.on(p.df.withColumn("__q", F.pow("__e", 2)))
    names = [f"__q{k}" for k in range(1, lags + 1)]
    p = framed(p, {f"__q{k}": (lambda w, k=k: F.lag("__q", k).over(w)) for k in range(1, lags + 1)}, lags)
    fit = fit_ols(p.df, panel.key, "__q", names)
    r2 = 1 - F.try_divide("rss", "tss")
    return fit.select(*panel.key, r2.alias("stat_arch_lm"))


def feature_table(panel: Panel, x: str, decomposed: Panel, rest: str = "random") -> DataFrame:
    """All features in one wide row per series; ``decomposed`` holds the components."""
    key = list(panel.key)
    unit = kpss(panel, x).select(*key, "kpss_stat", "kpss_pvalue")
    white = portmanteau(panel, x, 1).select(*key, "bp_stat", "bp_pvalue", "lb_stat", "lb_pvalue")
    strong = strengths(decomposed, "trend", "seasonal", rest)
    tables = [
        feat_acf(panel, x),
        feat_pacf(panel, x),
        strong,
        unit,
        phillips_perron(panel, x),
        spectral_entropy(panel, x),
        hurst(panel, x),
        ndiffs(panel, x),
        nsdiffs(strong, key),
        white,
        tiled(panel, x),
        level_shifts(panel, x),
        kl_shift(panel, x),
        crossings(panel, x),
        intermittency(panel, x),
        arch_lm(panel, x),
        guerrero(panel, x),
    ]
    return reduce(lambda a, b: a.join(b, key, "left"), tables)


def label_turns(features: DataFrame, columns: Sequence[str], period: int, letter: str = "Q") -> DataFrame:
    """Season positions with 0 read as the last one, as labels such as ``Q4``."""
    def label(c: str) -> Column:
        pos = F.when(F.col(c) == 0, F.lit(period)).otherwise(F.col(c))
        return F.concat(F.lit(letter), pos.cast("string"))

    return features.withColumns({c: label(c) for c in columns})


def principal_scores(features: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """Scores on the first ``k`` principal components of the standardised columns.

    Columns without spread are left out, and rows with a missing value.  One
    aggregation gives the correlations, a small matrix whose eigenvectors the driver
    finds; scores are sums over a row's columns.  Each component is turned so that its
    largest loading is positive.
    """
    spread = features.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    used = [c for c in columns if spread[c] and spread[c] > 0]
    df = features.na.drop(subset=used)
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i:]]
    stats = df.agg(
        F.array(*[F.avg(c) for c in used]).alias("mean"), F.array(*[F.stddev_samp(c) for c in used]).alias("sd"), F.array(*[F.covar_samp(a, b) for a, b in pairs]).alias("cov")
    ).first()
    mean, sd = np.array(stats.mean, float), np.array(stats.sd, float)
    both = np.zeros((len(used), len(used)))
    both[np.triu_indices(len(used))] = np.array(stats.cov, float)
    both = both + both.T - np.diag(np.diag(both))
    _, vectors = np.linalg.eigh(both / sd[:, None] / sd[None, :])
    load = vectors[:, ::-1][:, :k]
    load = load * np.sign(load[np.abs(load).argmax(0), range(load.shape[1])])

    def score(j: int) -> Column:
        parts = [(F.col(c) - float(mean[i])) * float(load[i, j] / sd[i]) for i, c in enumerate(used)]
        return reduce(lambda a, b: a + b, parts)

    return df.withColumns({f"pc{j + 1}": score(j) for j in range(load.shape[1])})
