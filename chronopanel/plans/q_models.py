"""Models, forecasts and simulations per series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronopanel.functions.transforms import Response
from chronopanel.operators import arima, baseline, joins, neural, regression as reg, shape, splits
from chronopanel.operators.windows import framed
from chronopanel.panel import Panel, future_rows
from chronopanel.plans.inputs import LM, MODEL, OD, OW, PM, daily, model_panel, monthly, parts_monthly, weekly
from chronopanel.plans.q_features import acf_ctes, pacf_ctes
from chronopanel.plans.q_windows import LMK
from chronopanel.sources.noise import draw_sql
from chronopanel.plans.projection import projected
from chronopanel.plans.registry import d, query, r, with_ctes

H = 60


def base_ctes(cte: str, src: str, key: str, idx: str, m: int, name: str = "fit", y: str = "y") -> list[str]:
    """CTEs: one row per key with what the benchmark models need."""
    by = f"PARTITION BY {key} ORDER BY {idx}"
    return [
        *([cte] if cte else []),
        f"""{name}_d AS (SELECT *, CAST({y} AS DOUBLE) AS yy, {y} - lag({y}) OVER ({by}) AS d1, {y} - lag({y}, {m}) OVER ({by}) AS dm FROM {src})""",
        f"""{name} AS (SELECT {key}, count(*) AS nn, max({idx}) AS last_at, avg(yy) AS mean, stddev_samp(yy) AS sd, arg_min(yy, {idx}) AS first,
  arg_max(yy, {idx}) AS last, stddev_samp(d1) AS sd1, stddev_samp(dm) AS sdm FROM {name}_d GROUP BY {key})""",
    ]


def base_forecast(model: str, key: str, m: int, name: str = "fit") -> str:
    """SQL text: mean and sd of one model at horizon h (alias f for the fit, g for h)."""
    last_season = f"(SELECT yy FROM {name}_d x WHERE {' AND '.join(f'x.{k} = f.{k}' for k in key.split(', '))} AND x.t = f.nn - {m} + 1 + (h - 1) % {m})"
    return {
        "mean": ("mean", "sd * sqrt(1 + 1.0 / nn)"),
        "naive": ("last", "sd1 * sqrt(h)"),
        "snaive": (last_season, f"sdm * sqrt((h - 1) // {m} + 1)"),
        "drift": ("last + h * (last - first) / (nn - 1)", "sd1 * sqrt(h * (1 + h / (nn - 1)))"),
    }[model]


def forecast_sql(model: str, key: str, m: int, h: int, step: str, cols: str = "") -> str:
    mean, sd = base_forecast(model, key, m)
    return f"""SELECT {key}, '{model}' AS model, CAST(h AS BIGINT) AS h, {d(f'last_at + INTERVAL (h * {step.split()[0]}) {step.split()[1]}')} AS week,
    {r(mean)} AS mean, {r(sd)} AS sd FROM fit f, range(1, {h + 1}) g(h)"""


def _model_query(model: str):
    def fn(t):
        return baseline.forecast_baselines(weekly(t), "y", H, models=(model,))

    return fn


for _id, _m in {"M1_mean": "mean", "M2_naive": "naive", "M3_snaive": "snaive", "M4_drift": "drift"}.items():
    query(
        _id, with_ctes(*base_ctes(OW, "ow", "o_orderpriority", "week", 52), select=forecast_sql(_m, "o_orderpriority", 52, H, "7 DAY"))
    )(_model_query(_m))


@query(
    "M5_basic_fit",
    with_ctes(
        *base_ctes(LM, "lm", LMK, "month", 12),
        select=" UNION ALL ".join(
            forecast_sql(m, LMK, 12, 24, "1 MONTH").replace("AS week", "AS month") for m in ("mean", "naive", "snaive", "drift")
        ),
    ),
)
def m5(t):
    """The four benchmark models of every monthly series in one long table."""
    return baseline.forecast_baselines(monthly(t), "y", 24)


@query(
    "M6_log_drift",
    with_ctes(
        LM, "lg AS (SELECT *, ln(y) AS ly FROM lm)",
        *base_ctes("", "lg", LMK, "month", 12, y="ly"),
        select=f"""SELECT {LMK}, CAST(h AS BIGINT) AS h, {d('last_at + INTERVAL (h) MONTH')} AS month, {r('exp(last + h * (last - first) / (nn - 1))')} AS median,
    {r('exp(last + h * (last - first) / (nn - 1)) * (1 + sd1 * sd1 * h * (1 + h / (nn - 1)) / 2)')} AS mean FROM fit, range(1, 25) g(h)""",
    ),
)
def m6(t):
    return baseline.log_drift(monthly(t), "y", 24)


def cramer(key: str, src: str, y: str, xs: list[str], name: str = "ls") -> list[str]:
    """CTEs: least squares on 2 or 3 centred columns by determinants, plus the intercept.

    The result ``<name>`` has b0..bk, n, rss, tss.
    """
    k = len(xs)
    cov = [f"covar_pop({xs[i]}, {xs[j]}) * count(*) AS s{i}{j}" for i in range(k) for j in range(i, k)]
    cy = [f"covar_pop({x}, {y}) * count(*) AS c{i}" for i, x in enumerate(xs)]
    means = [f"avg({x}) AS m{i}" for i, x in enumerate(xs)]

    def s(i, j):
        return f"s{min(i, j)}{max(i, j)}"

    def det(cols):
        if k == 2:
            (a, b), (c, e) = cols
            return f"({a} * {e} - {b} * {c})"
        (a, b, c), (p, q, u), (x, z, v) = cols
        return f"({a} * ({q} * {v} - {u} * {z}) - {b} * ({p} * {v} - {u} * {x}) + {c} * ({p} * {z} - {q} * {x}))"

    def mat(repl=None):
        return [[f"c{i}" if j == repl else s(i, j) for j in range(k)] for i in range(k)]

    betas = ", ".join(f"{det(mat(i))} / {det(mat())} AS b{i + 1}" for i in range(k))
    b0 = "my - " + " - ".join(f"b{i + 1} * m{i}" for i in range(k))
    rss = "tss - " + " - ".join(f"b{i + 1} * c{i}" for i in range(k))
    return [
        f"{name}_s AS (SELECT {key}, count(*) AS n, avg({y}) AS my, var_pop({y}) * count(*) AS tss, {', '.join(cov + cy + means)} FROM {src} GROUP BY {key})",
        f"{name}_b AS (SELECT *, {betas} FROM {name}_s)",
        f"{name} AS (SELECT *, {b0} AS b0, {rss} AS rss FROM {name}_b)",
    ]


def ols_ctes(key: str, src: str, y: str, xs: list[str], name: str = "ls", constant: bool = True) -> list[str]:
    """CTEs ending in ``name``: least squares on any number of columns as b0 (the constant), b1, ...; n and rss.

    The centred products are eliminated column by column and solved backwards;
    without a constant the products are plain.
    """
    cols, k = [*xs, y], len(xs)
    moment, mean = ("count(*) * covar_pop({}, {})", "avg({})") if constant else ("sum(({}) * ({}))", "0.0 * min({})")
    sums = ", ".join(f"{moment.format(cols[i], cols[j])} AS a{i}_{j}" for i in range(k + 1) for j in range(i, k + 1))
    out = [f"{name}e0 AS (SELECT {key}, count(*) AS n, {', '.join(f'{mean.format(c)} AS m{i}' for i, c in enumerate(cols))}, {sums} FROM {src} GROUP BY {key})"]
    for s in range(k):
        rest = ", ".join(f"a{i}_{j} - a{s}_{i} * a{s}_{j} / a{s}_{s} AS a{i}_{j}" for i in range(s + 1, k + 1) for j in range(i, k + 1))
        out.append(f"{name}e{s + 1} AS (SELECT * REPLACE ({rest}) FROM {name}e{s})")
    last = f"{name}e{k}"
    for i in reversed(range(k)):
        known = "".join(f" - a{i}_{j} * b{j + 1}" for j in range(i + 1, k))
        out.append(f"{name}b{i} AS (SELECT *, (a{i}_{k}{known}) / a{i}_{i} AS b{i + 1} FROM {last})")
        last = f"{name}b{i}"
    out.append(f"{name} AS (SELECT {key}, n, a{k}_{k} AS rss, m{k}{''.join(f' - b{i + 1} * m{i}' for i in range(k))} AS b0, {', '.join(f'b{i + 1}' for i in range(k))} FROM {last})")
    return out


def _tslm_sql(forward: str, median: str, bend: str) -> str:
    """Trend and one pair of waves on a transformed response, with the leverage by cofactors."""
    waves = "sin({0} * pi() / 6) AS x2, cos({0} * pi() / 6) AS x3"
    cof = {"00": "s11 * s22 - s12 * s12", "01": "s02 * s12 - s01 * s22", "02": "s01 * s12 - s02 * s11", "11": "s00 * s22 - s02 * s02", "12": "s01 * s02 - s00 * s12", "22": "s00 * s11 - s01 * s01"}
    det = f"(s00 * ({cof['00']}) + s01 * ({cof['01']}) + s02 * ({cof['02']}))"
    z = ["(x1 - m0)", "(x2 - m1)", "(x3 - m2)"]
    quad = " + ".join(f"{1 if a == b else 2} * ({c}) * {z[int(a)]} * {z[int(b)]}" for (a, b), c in cof.items())
    low, high = "mu - 1.959963984540054 * sd", "mu + 1.959963984540054 * sd"
    return with_ctes(
        LM,
        f"lx AS (SELECT {LMK}, {forward.format('y')} AS ly, CAST(t AS DOUBLE) AS x1, {waves.format('t')} FROM lm)", *cramer(LMK, "(SELECT * FROM lx WHERE ly IS NOT NULL)", "ly", ["x1", "x2", "x3"]),
        f"fu AS (SELECT {LMK}, h, last_at, CAST(tt + h AS DOUBLE) AS x1, {waves.format('(tt + h)')} FROM (SELECT {LMK}, max(t) AS tt, max(month) AS last_at FROM lm GROUP BY {LMK}), range(1, 13) g(h))",
        f"pr AS (SELECT {LMK}, h, last_at, b0 + b1 * x1 + b2 * x2 + b3 * x3 AS mu, sqrt(rss / (n - 4) * (1 + 1.0 / n + ({quad}) / {det})) AS sd FROM fu JOIN ls USING ({LMK}))",
        select=f"""SELECT {LMK}, CAST(h AS BIGINT) AS h, {d('last_at + INTERVAL (h) MONTH')} AS month, {r(median.format('mu'), 4)} AS median, {r('(' + median.format('mu') + ') * (1 + ' + bend + ')', 4)} AS mean,
    {r(median.format(f'({low})'), 4)} AS lower, {r(median.format(f'({high})'), 4)} AS upper FROM pr""",
    )


@query("M6_log_tslm", _tslm_sql("CASE WHEN {0} > 0 THEN ln({0}) END", "exp({0})", "sd * sd / 2"), digits=4)
def m6b(t):
    """Trend and season waves on the logarithm, transformed back with the bias taken out."""
    return reg.forecast_tslm(monthly(t), "y", 12, 1, Response(0.0))


@query("M6_root_tslm", _tslm_sql("CASE WHEN {0} >= 0 THEN (sqrt({0}) - 1) / 0.5 END", "CASE WHEN {0} * 0.5 + 1 > 0 THEN pow({0} * 0.5 + 1, 2) END", "sd * sd * 0.5 / (2 * pow(mu * 0.5 + 1, 2))"), digits=4)
def m6c(t):
    """The same on the square root."""
    return reg.forecast_tslm(monthly(t), "y", 12, 1, Response(0.5))


@query(
    "M7_multiple_regression",
    with_ctes("li AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS y, l_discount AS x1, l_tax AS x2, CAST(l_linenumber AS DOUBLE) AS x3 FROM lineitem)",
              *cramer("l_returnflag", "li", "y", ["x1", "x2", "x3"]),
              select=f"SELECT l_returnflag, n, {r('b0')} AS b0, {r('b1')} AS b1, {r('b2')} AS b2, {r('b3')} AS b3, {r('1 - rss / tss')} AS r2 FROM ls"),
)
def m7(t):
    """Three regressors on the raw rows; only Gram sums leave the tasks."""
    fit = reg.fit_ols(t("lineitem"), ["l_returnflag"], "l_quantity", ["l_discount", "l_tax", "l_linenumber"])
    return fit.select("l_returnflag", "n", *[F.col("coef")[i].alias(f"b{i}") for i in range(4)], (1 - F.col("rss") / F.col("tss")).alias("r2"))


@query(
    "M8_linear_trend",
    with_ctes(OW, select=f"SELECT o_orderpriority, {r('regr_slope(y, t)')} AS slope, {r('regr_intercept(y, t)')} AS intercept, {r('regr_r2(y, t)')} AS r2 FROM ow GROUP BY 1"),
)
def m8(t):
    from chronopanel.operators.aggregate import line_fit

    p = weekly(t).with_position("t")
    return line_fit(p.df, p.key, "y", "t")


MP_SEASON = "mps AS (SELECT *, (t - 1) % 52 AS season, CAST(y AS DOUBLE) AS yy FROM mp)"


def demeaned(cols: list[str], name: str = "dm", src: str = "mps", key: str = "o_orderpriority") -> str:
    parts = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {key}, season) AS z_{c}" for c in cols)
    return f"{name} AS (SELECT *, {parts} FROM {src})"


@query(
    "M9_trend_season_covariates",
    with_ctes(MODEL, MP_SEASON, demeaned(["yy", "t", "covid", "ice_present"]),
              *cramer("o_orderpriority", "dm", "z_yy", ["z_t", "z_covid", "z_ice_present"]),
              "sm AS (SELECT o_orderpriority, season, avg(yy) AS a, avg(t) AS mt, avg(covid) AS mc, avg(ice_present) AS mi FROM mps GROUP BY 1, 2)",
              select=f"""SELECT o_orderpriority, season, {r('a - b1 * mt - b2 * mc - b3 * mi')} AS alpha, {r('b1')} AS trend, {r('b2')} AS covid, {r('b3')} AS ice,
    {r('rss', 4)} AS rss FROM sm JOIN ls USING (o_orderpriority)"""),
)
def m9(t):
    """Season levels, trend and two flags without building 52 dummies."""
    p = model_panel(t).with_position("t").with_season("season")
    fit = reg.fit_seasonal(p.df, p.key, "y", ["t", "covid", "ice_present"])
    c = F.col("coef")
    return fit.select(*p.key, "season", "alpha", c[0].alias("trend"), c[1].alias("covid"), c[2].alias("ice"), F.round("rss", 4).alias("rss"))


@query(
    "M10_season_slopes",
    with_ctes(OW, "s AS (SELECT *, (t - 1) % 52 AS season FROM ow)",
              select=f"SELECT o_orderpriority, season, {r('regr_slope(y, t)')} AS slope, {r('regr_intercept(y, t)')} AS alpha FROM s GROUP BY 1, 2"),
)
def m10(t):
    """Trend by season: every week of the year has its own slope."""
    p = weekly(t).with_position("t").with_season("season")
    return reg.fit_seasonal(p.df, p.key, "y", [], slope_on="t").select(*p.key, "season", "slope", "alpha")


@query(
    "M10_season_slopes_flag",
    with_ctes(
        MODEL, MP_SEASON,
        """g AS (SELECT o_orderpriority, season, count(*) AS c, avg(yy) AS my, avg(t) AS mt, avg(covid) AS mx,
  covar_pop(t, t) AS tt, covar_pop(t, yy) AS ty, covar_pop(t, covid) AS tx, covar_pop(covid, covid) AS xx, covar_pop(covid, yy) AS xy FROM mps GROUP BY 1, 2)""",
        "b AS (SELECT o_orderpriority, sum(c * (xy - tx * ty / tt)) / sum(c * (xx - tx * tx / tt)) AS b FROM g GROUP BY 1)",
        select=f"""SELECT o_orderpriority, season, {r('b')} AS covid, {r('(ty - b * tx) / tt')} AS slope,
    {r('my - b * mx - (ty - b * tx) / tt * mt')} AS alpha FROM g JOIN b USING (o_orderpriority)""",
    ),
)
def m10c(t):
    """Season-specific slopes next to one shared flag."""
    p = model_panel(t).with_position("t").with_season("season")
    fit = reg.fit_seasonal(p.df, p.key, "y", ["covid"], slope_on="t")
    return fit.select(*p.key, "season", F.col("coef")[0].alias("covid"), "slope", "alpha")


def _season_free(c: str) -> str:
    """A column without its season means and season slopes on t."""
    p = "OVER (PARTITION BY o_orderpriority, season)"
    return f"({c} - avg({c}) {p} - coalesce((t - avg(t) {p}) * covar_pop({c}, t) {p} / nullif(var_pop(t) {p}, 0), 0))"


@query(
    "M10_season_slopes_covariates",
    with_ctes(
        MODEL, MP_SEASON,
        "z AS (SELECT o_orderpriority, " + ", ".join(f"{_season_free(c)} AS {n}" for c, n in (("CAST(yy AS DOUBLE)", "y"), ("home", "x1"), ("covid", "x2"), ("ice_present", "x3"))) + " FROM mps)",
        *projected("z", "o_orderpriority", "y", ["x1", "x2", "x3"]),
        "cells AS (SELECT o_orderpriority, sum(1 + CASE WHEN v > 0 THEN 1 ELSE 0 END) + 3 AS rank FROM (SELECT o_orderpriority, season, var_pop(t) AS v FROM mps GROUP BY 1, 2) GROUP BY 1)",
        "f AS (SELECT o_orderpriority, sum(y * y) AS rss FROM gs3 GROUP BY 1)",
        "q AS (SELECT f.*, rank, n, tss, n * ln(rss / n) AS logs FROM f JOIN cells USING (o_orderpriority) JOIN (SELECT o_orderpriority, count(*) AS n, var_pop(yy) * count(*) AS tss FROM mps GROUP BY 1) USING (o_orderpriority))",
        select=f"""SELECT o_orderpriority, n, CAST(rank AS BIGINT) AS rank, {r('1 - rss / tss')} AS r2, {r('1 - rss / tss * (n - 1) / (n - rank)')} AS adj_r2, {r('rss / (n - rank)')} AS sigma2,
    {r('-(n * (ln(2 * pi()) + 1) + logs) / 2')} AS log_lik, {r('logs + 2 * (rank + 1)')} AS aic, {r('logs + 2 * (rank + 1) + 2.0 * (rank + 1) * (rank + 2) / (n - rank - 2)')} AS aicc,
    {r('logs + (rank + 1) * ln(n)')} AS bic FROM q""",
    ),
)
def m10b(t):
    """The interaction model with covariates."""
    p = model_panel(t).with_position("t").with_season("season")
    fit = reg.fit_seasonal(p.df, p.key, "y", ["home", "covid", "ice_present"], slope_on="t")
    return reg.glance(reg.season_summary(fit, p.key), p.key)


@query(
    "M11_fourier",
    with_ctes(LM, f"w AS (SELECT {LMK}, y, CAST(t AS DOUBLE) AS t, sin(2 * pi() * t / 12) AS s1, cos(2 * pi() * t / 12) AS c1 FROM lm)",
              *cramer(LMK, "w", "y", ["t", "s1", "c1"]),
              select=f"SELECT {LMK}, n, {r('b0', 4)} AS b0, {r('b1', 4)} AS b1, {r('b2', 4)} AS s1, {r('b3', 4)} AS c1, {r('1 - rss / tss', 4)} AS r2 FROM ls"),
    digits=4,
)
def m11(t):
    """Trend plus one harmonic; the larger models come from the same sums."""
    fits = reg.fourier_fits(monthly(t), "y", 6).where("k = 1")
    c = F.col("coef")
    return fits.select(
        "l_returnflag", "l_linestatus", "n", c[0].alias("b0"), c[1].alias("b1"), c[2].alias("s1"), c[3].alias("c1"),
        (1 - F.col("rss") / F.col("tss")).alias("r2"),
    )


_WAVES = [c for j in range(1, 7) for c in ([f"s{j}", f"c{j}"] if j < 6 else ["c6"])]
_WAVE_COLS = ", ".join(f"{'sin' if c[0] == 's' else 'cos'}(2 * pi() * {c[1:]} * t / 12) AS {c}" for c in _WAVES)


@query(
    "M11_fourier_choice",
    with_ctes(
        LM, f"w AS (SELECT {LMK}, CAST(y AS DOUBLE) AS y, CAST(t AS DOUBLE) AS t, {_WAVE_COLS} FROM lm)", *projected("w", LMK, "y", ["t", *_WAVES]),
        "f AS (" + " UNION ALL ".join(f"SELECT {LMK}, {k}::BIGINT AS k, {2 + len([c for c in _WAVES if int(c[1:]) <= k])}::BIGINT AS rank, sum(y * y) AS rss FROM gs{1 + len([c for c in _WAVES if int(c[1:]) <= k])} GROUP BY {LMK}" for k in range(1, 7)) + ")",
        f"q AS (SELECT f.*, n, tss, n * ln(rss / n) AS logs FROM f JOIN (SELECT {LMK}, count(*) AS n, sum(y * y) AS tss FROM gs0 GROUP BY {LMK}) USING ({LMK}))",
        select=f"""SELECT {LMK}, k, n, rank, {r('1 - rss / tss')} AS r2, {r('1 - rss / tss * (n - 1) / (n - rank)')} AS adj_r2, {r('rss / (n - rank)')} AS sigma2,
    {r('-(n * (ln(2 * pi()) + 1) + logs) / 2')} AS log_lik, {r('logs + 2 * (rank + 1)')} AS aic, {r('logs + 2 * (rank + 1) + 2.0 * (rank + 1) * (rank + 2) / (n - rank - 2)')} AS aicc,
    {r('logs + (rank + 1) * ln(n)')} AS bic FROM q""",
    ),
)
def m11b(t):
    """Six harmonic models per series, ranked by AICc."""
    fits = reg.glance(reg.fourier_fits(monthly(t), "y", 6), ["l_returnflag", "l_linestatus", "k"])
    return fits.orderBy("l_returnflag", "l_linestatus", "aicc")


@query(
    "M12_trend_knots",
    with_ctes(OW, "w AS (SELECT o_orderpriority, CAST(y AS DOUBLE) AS y, CAST(t AS DOUBLE) AS t, greatest(t - 100.0, 0) AS k1, greatest(t - 220.0, 0) AS k2 FROM ow)",
              *cramer("o_orderpriority", "w", "y", ["t", "k1", "k2"]),
              select=f"SELECT o_orderpriority, {r('b0')} AS b0, {r('b1')} AS b1, {r('b2')} AS k1, {r('b3')} AS k2 FROM ls"),
)
def m12(t):
    p = weekly(t).with_position("t")
    knots = reg.knot_columns("t", [100, 220])
    fit = reg.fit_ols(p.df.withColumns(knots), p.key, "y", ["t", *knots])
    c = F.col("coef")
    return fit.select(*p.key, c[0].alias("b0"), c[1].alias("b1"), c[2].alias("k1"), c[3].alias("k2"))


@query(
    "M13_covariates_only",
    with_ctes(MODEL, "w AS (SELECT o_orderpriority, CAST(y AS DOUBLE) AS y, home, covid, holiday FROM mp)",
              *cramer("o_orderpriority", "w", "y", ["home", "covid", "holiday"]),
              select=f"SELECT o_orderpriority, {r('b0')} AS b0, {r('b1')} AS home, {r('b2')} AS covid, {r('b3')} AS holiday FROM ls"),
)
def m13(t):
    p = model_panel(t)
    fit = reg.fit_ols(p.df, p.key, "y", ["home", "covid", "holiday"])
    c = F.col("coef")
    return fit.select(*p.key, c[0].alias("b0"), c[1].alias("home"), c[2].alias("covid"), c[3].alias("holiday"))


@query("M14_auto_arima")
def m14(t):
    """Order search by AICc for every monthly series, forecast a year ahead."""
    orders = arima.Orders(p=3, q=2)
    p = monthly(t)
    models, designed = arima.fit_arima(p, "y", orders)
    fc = arima.forecast_arima(models, designed, "y", 12, orders)
    return fc.join(models.select(*p.key, "order_p", "order_d", "order_q", "order_ps", "order_ds", "order_qs", "aicc"), list(p.key))


_AR2 = "a AS (SELECT o_orderstatus, day, CAST(y AS DOUBLE) AS y, lag(y, 1) OVER w AS x1, lag(y, 2) OVER w AS x2, t FROM od WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day))"


@query(
    "M15_fixed_ar2",
    with_ctes(OD, _AR2, "b AS (SELECT * FROM a WHERE t > 2)", *cramer("o_orderstatus", "b", "y", ["x1", "x2"]),
              select=f"SELECT o_orderstatus, n, {r('b0')} AS constant, {r('b1')} AS phi1, {r('b2')} AS phi2, {r('rss / (n - 3)')} AS sigma2 FROM ls"),
)
def m15(t):
    """A pure AR(2) with constant: least squares on two lags."""
    orders = arima.fixed_order((2, 0, 0), constant=True)
    models, _ = arima.fit_arima(daily(t), "y", orders)
    c = F.col("coef")
    return models.select("o_orderstatus", "n", c[0].alias("constant"), c[1].alias("phi1"), c[2].alias("phi2"), "sigma2")


@query(
    "M15_ar2_forecast",
    with_ctes(OD, _AR2, "b AS (SELECT * FROM a WHERE t > 2)", *cramer("o_orderstatus", "b", "y", ["x1", "x2"]),
              "e AS (SELECT o_orderstatus, arg_max(y, t) AS y1, arg_max(x1, t) AS y2, max(day) AS last_at FROM a GROUP BY 1)",
              """st AS (SELECT o_orderstatus, last_at, b0, b1, b2, y1, y2, b0 + b1 * y1 + b2 * y2 AS f1 FROM ls JOIN e USING (o_orderstatus)),
s2 AS (SELECT *, b0 + b1 * f1 + b2 * y1 AS f2 FROM st), s3 AS (SELECT *, b0 + b1 * f2 + b2 * f1 AS f3 FROM s2), s4 AS (SELECT *, b0 + b1 * f3 + b2 * f2 AS f4 FROM s3)""",
              select=" UNION ALL ".join(f"SELECT o_orderstatus, {h}::BIGINT AS h, {d(f'last_at + {h}')} AS day, {r(f'f{h}')} AS mean FROM s4" for h in (1, 2, 3, 4))),
)
def m15c(t):
    """Recursive forecast of the same model."""
    orders = arima.fixed_order((2, 0, 0), constant=True)
    models, designed = arima.fit_arima(daily(t), "y", orders)
    return arima.forecast_arima(models, designed, "y", 4, orders).drop("sd")


@query(
    "M15_seasonal_walk",
    with_ctes(LM, select=f"""SELECT a.l_returnflag, a.l_linestatus, CAST(a.t - a.n + 12 AS BIGINT) AS h,
    {d("CAST(e.month AS DATE) + to_months(CAST(a.t - a.n + 12 AS INTEGER))")} AS month, {r('e.y + a.y - s.y')} AS mean
    FROM lm a JOIN lm e ON a.l_returnflag = e.l_returnflag AND a.l_linestatus = e.l_linestatus AND e.t = e.n
    JOIN lm s ON a.l_returnflag = s.l_returnflag AND a.l_linestatus = s.l_linestatus AND s.t = s.n - 12
    WHERE a.t > a.n - 12"""),
)
def m15d(t):
    """Twelve months of (0,1,0)(0,1,0): the last value moves as it did a year before."""
    orders = arima.fixed_order((0, 1, 0), (0, 1, 0), constant=False)
    models, designed = arima.fit_arima(monthly(t), "y", orders)
    return arima.forecast_arima(models, designed, "y", 12, orders).drop("sd")


_OVER_T = "OVER (PARTITION BY o_orderstatus ORDER BY t)"


def _two_regressions() -> list[str]:
    """CTEs: a long autoregression gives innovations, a second one on four lags and the last innovation gives the model."""
    lags = [f"x{k}" for k in range(1, 11)]
    rows = "OVER (PARTITION BY o_orderstatus ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    fitted = " + ".join(["b0", *(f"b{k} * x{k}" for k in range(1, 11))])
    return [
        OD,
        f"sm AS (SELECT o_orderstatus, day, w, row_number() OVER (PARTITION BY o_orderstatus ORDER BY day) AS t FROM (SELECT o_orderstatus, day, CASE WHEN count(y) {rows} = 7 THEN avg(y) {rows} END AS w FROM od) WHERE w IS NOT NULL)",
        f"lg AS (SELECT *, {', '.join(f'lag(w, {k}) {_OVER_T} AS x{k}' for k in range(1, 11))} FROM sm)",
        *ols_ctes("o_orderstatus", "(SELECT * FROM lg WHERE x10 IS NOT NULL)", "w", lags, "la"),
        f"iv AS (SELECT lg.*, w - ({fitted}) AS e FROM lg JOIN la USING (o_orderstatus))",
        f"el AS (SELECT *, lag(e) {_OVER_T} AS e1 FROM iv)",
        *ols_ctes("o_orderstatus", "(SELECT * FROM el WHERE e1 IS NOT NULL)", "w", ["x1", "x2", "x3", "x4", "e1"], "hr"),
        """en AS (SELECT o_orderstatus, max(el.day) AS last_at, arg_max(w, t) AS y1, arg_max(x1, t) AS y2, arg_max(x2, t) AS y3, arg_max(x3, t) AS y4,
    arg_max(w - (b0 + b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4 + b5 * e1), t) AS u FROM el JOIN hr USING (o_orderstatus) GROUP BY o_orderstatus)""",
        """fc AS (SELECT o_orderstatus, last_at, 1 AS h, b0 + b1 * y1 + b2 * y2 + b3 * y3 + b4 * y4 + b5 * u AS f, y1 AS f1, y2 AS f2, y3 AS f3, 1.0::DOUBLE AS psi, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS p3, 1.0::DOUBLE AS acc
    FROM en JOIN hr USING (o_orderstatus)
  UNION ALL SELECT o_orderstatus, last_at, h + 1, b0 + b1 * f + b2 * f1 + b3 * f2 + b4 * f3, f, f1, f2, nx, psi, p1, p2, acc + nx * nx
    FROM (SELECT fc.*, hr.* EXCLUDE (o_orderstatus), CASE WHEN h = 1 THEN b5 ELSE 0 END + b1 * psi + b2 * p1 + b3 * p2 + b4 * p3 AS nx FROM fc JOIN hr USING (o_orderstatus) WHERE h < 30))""",
    ]


@query(
    "M15_arima_401",
    with_ctes(*_two_regressions(), select=f"""SELECT o_orderstatus, CAST(h AS BIGINT) AS h, {d('last_at + h')} AS day, {r('f')} AS mean,
    {r('sqrt(rss / (n - 6) * acc)')} AS sd FROM fc JOIN hr USING (o_orderstatus)""").replace("WITH", "WITH RECURSIVE", 1),
)
def m15b(t):
    """The fixed (4,0,1) model on the smoothed daily series."""
    from chronopanel.operators.windows import centred_ma

    p = centred_ma(daily(t), "y", 7, "ma")
    p = p.on(p.df.where("ma is not null").select("o_orderstatus", "day", "ma"))
    orders = arima.fixed_order((4, 0, 1), constant=True)
    models, designed = arima.fit_arima(p, "ma", orders)
    return arima.forecast_arima(models, designed, "ma", 30, orders)


@query("M16_regression_arima_errors")
def m16(t):
    """Seasonal regression with covariates and ARMA errors, forecast on the test rows."""
    s = splits.split_by_share(model_panel(t), 0.2).with_season("season").written("split")
    return arima.arima_regression(s, "y", ["t", "covid", "holiday", "ice_present"], arima.Orders(2, 2, 0, 0))


def _regression_ar1(xs: list[str]) -> list[str]:
    """CTEs: season means out, least squares, AR(1) of the residuals, slopes again on filtered columns, errors ahead."""
    cols = ["yy", *xs]
    z = [f"z_{c}" for c in cols]
    by_t = "OVER (PARTITION BY o_orderpriority ORDER BY t)"

    def rest(name: str) -> str:
        return "z_yy" + "".join(f" - {name}.b{i + 1} * z_{c}" for i, c in enumerate(xs))

    ar = "sum({0} * {0}1) / sum({0}1 * {0}1) AS phi"
    return [
        MODEL, MP_SEASON,
        "sp AS (SELECT *, CAST(floor(0.8 * n) AS BIGINT) AS k FROM mps)",
        demeaned(cols, "dm", "(SELECT * FROM sp WHERE t <= k)"),
        *ols_ctes("o_orderpriority", "dm", "z_yy", z[1:], "l1", constant=False),
        f"u1 AS (SELECT dm.*, {rest('l1')} AS u FROM dm JOIN l1 USING (o_orderpriority))",
        f"u2 AS (SELECT *, lag(u) {by_t} AS u1 FROM u1)",
        f"a1 AS (SELECT o_orderpriority, {ar.format('u')} FROM u2 GROUP BY 1)",
        f"qf AS (SELECT o_orderpriority, t, {', '.join(f'{c} - phi * lag({c}) {by_t} AS q{i}' for i, c in enumerate(z))} FROM dm JOIN a1 USING (o_orderpriority))",
        *ols_ctes("o_orderpriority", "(SELECT * FROM qf WHERE q0 IS NOT NULL)", "q0", [f"q{i + 1}" for i in range(len(xs))], "l2", constant=False),
        f"v1 AS (SELECT dm.o_orderpriority, t, {rest('l2')} AS v FROM dm JOIN l2 USING (o_orderpriority))",
        f"v2 AS (SELECT *, lag(v) {by_t} AS v1 FROM v1)",
        f"a2 AS (SELECT o_orderpriority, {ar.format('v')}, arg_max(v, t) AS last_v, sum(v * v) - pow(sum(v * v1), 2) / sum(v1 * v1) AS raw, count(v1) AS m FROM v2 WHERE v1 IS NOT NULL GROUP BY 1)",
        f"me AS (SELECT o_orderpriority, season, {', '.join(f'avg({c}) AS m_{c}' for c in cols)} FROM dm GROUP BY 1, 2)",
    ]


_AR1_XS = ["t", "covid"]


@query(
    "M16_regression_ar1_errors",
    with_ctes(*_regression_ar1(_AR1_XS), select=f"""SELECT o_orderpriority, t - k AS h, {d('week')} AS week, CAST(yy AS DOUBLE) AS actual,
    {r('m_yy' + ''.join(f' + b{i + 1} * ({c} - m_{c})' for i, c in enumerate(_AR1_XS)) + ' + pow(phi, t - k) * last_v', 5)} AS mean,
    {r('sqrt(raw / (m - 1) * (1 - pow(phi, 2 * (t - k))) / (1 - phi * phi))', 5)} AS sd
    FROM sp JOIN a2 USING (o_orderpriority) JOIN l2 USING (o_orderpriority) JOIN me USING (o_orderpriority, season) WHERE t > k"""),
    digits=5,
)
def m16b(t):
    """Trend, season and one covariate with AR(1) errors: the order is fixed, so every step has a closed form."""
    s = splits.split_by_share(model_panel(t), 0.2).with_season("season").written("split")
    return arima.arima_regression(s, "y", _AR1_XS, arima.fixed_order((1, 0, 0), constant=False))


@query("M17_neural_net")
def m17(t):
    """Ten averaged networks on lags and covariates per series."""
    s = splits.split_by_share(model_panel(t), 0.1)
    return neural.forecast_nnet(s, "y", ["home", "covid", "holiday", "ice_present"], lags=4, rounds=150)


@query("M17_neural_net_ahead")
def m17b(t):
    """Networks on lags only, thirty days past the end."""
    return neural.forecast_nnet_ahead(daily(t), "y", 30, lags=7, rounds=100, networks=5)


@query("M17_neural_net_auto")
def m17c(t):
    """Automatic order and Box-Cox parameter, ten units, twenty repeats."""
    return neural.forecast_nnet_ahead(daily(t), "y", 30, lags=None, lam="auto", hidden=10, networks=20, rounds=100)


def _ar_order_sql(lag_max: int) -> str:
    """AIC of every order as columns, the least one's number."""
    aic = [f"n * ({' + '.join(f'ln(1 - f{j}_{j} * f{j}_{j})' for j in range(1, k + 1))}) + {2 * k}" for k in range(1, lag_max + 1)]
    return f"list_position([{', '.join(aic)}], least({', '.join(aic)}))"


@query(
    "M17_automatic_lags",
    with_ctes(
        OW, "ad AS (SELECT o_orderpriority, week, y - avg(y) OVER (PARTITION BY o_orderpriority, (t - 1) % 52) AS a FROM ow)",
        *acf_ctes("ad", "o_orderpriority", "week", "a", list(range(1, 11))), *pacf_ctes(10, "ac", "u"),
        select=f"SELECT o_orderpriority, CAST({_ar_order_sql(10)} AS BIGINT) AS lags FROM up10",
    ),
)
def m17d(t):
    """The autoregressive order that a network takes when none is given."""
    return neural.automatic_lags(weekly(t), "y")


@query(
    "M18_model_table",
    with_ctes(
        *base_ctes(PM, "pm", "l_partkey", "month", 12),
        select=f"""SELECT l_partkey, 'mean' AS model, {r('mean')} AS level, {r('sd')} AS sigma FROM fit
    UNION ALL SELECT l_partkey, 'naive', {r('last')}, {r('sd1')} FROM fit
    UNION ALL SELECT l_partkey, 'drift', {r('last')}, {r('sd1')} FROM fit""",
    ),
)
def m18(t):
    """Several models for every part: one long table, one pass."""
    p = parts_monthly(t)
    fit = baseline.fit_baselines(p, "y")
    cells = F.array(
        F.struct(F.lit("mean").alias("model"), F.col("mean").alias("level"), F.col("sd").alias("sigma")),
        F.struct(F.lit("naive").alias("model"), F.col("last").alias("level"), F.col("sd1").alias("sigma")),
        F.struct(F.lit("drift").alias("model"), F.col("last").alias("level"), F.col("sd1").alias("sigma")),
    )
    return fit.select("l_partkey", F.explode(cells).alias("c")).select("l_partkey", "c.*")


@query(
    "M19_forecast_given_rows",
    with_ctes(OW, "tr AS (SELECT * FROM ow WHERE t <= floor((1 - 0.2::DOUBLE) * n))", *base_ctes("", "tr", "o_orderpriority", "week", 52),
              select=f"""SELECT o_orderpriority, CAST(f.h AS BIGINT) AS h, {r('last + f.h * (last - first) / (nn - 1)')} AS mean
    FROM fit JOIN (SELECT o_orderpriority, t - CAST(floor((1 - 0.2::DOUBLE) * n) AS BIGINT) AS h FROM ow WHERE t > floor((1 - 0.2::DOUBLE) * n)) f USING (o_orderpriority)"""),
)
def m19(t):
    """Drift forecasts for exactly the rows of the test part."""
    s = splits.split_by_share(weekly(t), 0.2)
    fc = baseline.forecast_for(splits.train(s), "y", splits.test(s).df.select("o_orderpriority", "h"), models=("drift",))
    return fc.select("o_orderpriority", "h", "mean")


@query(
    "M20_new_data",
    with_ctes(OW, select=f"SELECT o_orderpriority, CAST(h AS BIGINT) AS h, {d('max(week) + CAST(7 * h AS INTEGER)')} AS week FROM ow, range(1, 9) g(h) GROUP BY o_orderpriority, h"),
)
def m20(t):
    return future_rows(weekly(t), 8)


@query(
    "M21_augment",
    with_ctes(
        OW, "q AS (SELECT *, lag(y) OVER w AS l1, lag(y, 52) OVER w AS l52, avg(y) OVER (PARTITION BY o_orderpriority) AS mn, (arg_max(y, week) OVER k - arg_min(y, week) OVER k) / (n - 1) AS sl FROM ow WINDOW w AS (PARTITION BY o_orderpriority ORDER BY week), k AS (PARTITION BY o_orderpriority))",
        select=" UNION ALL ".join(
            f"SELECT o_orderpriority, '{m}' AS model, {d('week')} AS week, t, CAST(y AS DOUBLE) AS y, {r(f)} AS fitted, {r(f'y - ({f})')} AS resid FROM q"
            for m, f in {"mean": "mn", "naive": "l1", "snaive": "l52", "drift": "l1 + sl"}.items()
        ),
    ),
)
def m21(t):
    return baseline.fitted_baselines(weekly(t), "y")


_TWO = cramer("o_orderpriority", "w", "y", ["covid", "ice"])


@query(
    "M22_glance",
    with_ctes(MODEL, "w AS (SELECT o_orderpriority, CAST(y AS DOUBLE) AS y, covid, ice_present AS ice FROM mp)", *_TWO,
              select=f"""SELECT o_orderpriority, n, 3::BIGINT AS rank, {r('1 - rss / tss')} AS r2, {r('1 - rss / tss * (n - 1) / (n - 3)')} AS adj_r2, {r('rss / (n - 3)')} AS sigma2,
    {r('-(n * (ln(2 * pi()) + 1) + n * ln(rss / n)) / 2')} AS log_lik, {r('n * ln(rss / n) + 8')} AS aic, {r('n * ln(rss / n) + 8 + 40.0 / (n - 5)')} AS aicc, {r('n * ln(rss / n) + 4 * ln(n)')} AS bic FROM ls"""),
)
def m22(t):
    p = model_panel(t)
    return reg.glance(reg.fit_ols(p.df, p.key, "y", ["covid", "ice_present"]), p.key)


@query(
    "M22_glance_cv",
    with_ctes(OW, "w AS (SELECT o_orderpriority, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, avg(t) AS mt, count(*) AS nn FROM ow GROUP BY 1)",
              "e AS (SELECT o_orderpriority, nn, syy, y - a - b * t AS e, 1.0 / nn + (t - mt) * (t - mt) / sxx AS lev FROM ow JOIN w USING (o_orderpriority))",
              select=f"SELECT o_orderpriority, nn AS n, {r('1 - sum(e * e) / syy')} AS r2, {r('nn * ln(sum(e * e) / nn) + 6')} AS aic, {r('avg(pow(e / (1 - lev), 2))')} AS cv FROM e GROUP BY o_orderpriority, nn, syy"),
)
def m22d(t):
    """The summary row of a regression with its leave-one-out error."""
    p = weekly(t).with_position("t")
    fit = reg.fit_ols(p.df, p.key, "y", ["t"])
    return reg.glance_with_cv(p.df, fit, p.key, "y", ["t"]).select(*p.key, "n", "r2", "aic", "cv")


_AR2_LS = [OD, _AR2, "b AS (SELECT * FROM a WHERE t > 2)", *cramer("o_orderstatus", "b", "y", ["x1", "x2"]), "v AS (SELECT *, rss / (n - 3) AS s2, s00 * s11 - s01 * s01 AS det FROM ls)"]
_AR2_TERMS = {"constant": ("b0", "1.0 / n + (m0 * m0 * s11 - 2 * m0 * m1 * s01 + m1 * m1 * s00) / det"), "ar1": ("b1", "s11 / det"), "ar2": ("b2", "s00 / det")}


@query("M22_tidy_arima", with_ctes(*_AR2_LS, select=" UNION ALL ".join(
    f"SELECT o_orderstatus, '{term}' AS term, {r(b, 5)} AS estimate, {r(f'sqrt(s2 * ({u}))', 5)} AS std_error, {r(f'{b} / sqrt(s2 * ({u}))', 5)} AS statistic FROM v" for term, (b, u) in _AR2_TERMS.items())), digits=5)
def m22e(t):
    """Coefficients of an AR(2) with their standard errors."""
    orders = arima.fixed_order((2, 0, 0), constant=True)
    models, _ = arima.fit_arima(daily(t), "y", orders)
    return arima.tidy_arima(models, ["o_orderstatus"], orders)


@query("M22_glance_arima", with_ctes(*_AR2_LS, select=f"""SELECT o_orderstatus, n, 2::BIGINT AS order_p, {r('s2', 5)} AS sigma2, {r('-(n * (ln(2 * pi()) + 1) + n * ln(rss / n)) / 2', 5)} AS log_lik,
    {r('n * ln(rss / n) + 8', 5)} AS aic, {r('n * ln(rss / n) + 8 + 40.0 / (n - 5)', 5)} AS aicc, {r('n * ln(rss / n) + 4 * ln(n)', 5)} AS bic FROM v"""), digits=5)
def m22f(t):
    """The summary row of the same model."""
    models, _ = arima.fit_arima(daily(t), "y", arima.fixed_order((2, 0, 0), constant=True))
    return arima.glance_arima(models, ["o_orderstatus"]).select("o_orderstatus", "n", "order_p", "sigma2", "log_lik", "aic", "aicc", "bic")


@query(
    "M22_tidy",
    with_ctes(OW, "w AS (SELECT o_orderpriority, count(*) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t) AS rss, regr_sxx(y, t) AS sxx, avg(t) AS mt FROM ow GROUP BY 1)",
              select=f"""SELECT o_orderpriority, 'const' AS term, {r('a')} AS estimate, {r('sqrt(rss / (n - 2) * (1.0 / n + mt * mt / sxx))')} AS std_error,
    {r('a / sqrt(rss / (n - 2) * (1.0 / n + mt * mt / sxx))', 5)} AS statistic FROM w
    UNION ALL SELECT o_orderpriority, 't', {r('b')}, {r('sqrt(rss / (n - 2) / sxx)')}, {r('b / sqrt(rss / (n - 2) / sxx)', 5)} FROM w"""),
)
def m22b(t):
    p = weekly(t).with_position("t")
    out = reg.tidy(reg.fit_ols(p.df, p.key, "y", ["t"]), p.key, ["const", "t"])
    return out.withColumn("statistic", F.round("statistic", 5))


@query(
    "M22_leave_one_out",
    with_ctes(OW, "w AS (SELECT o_orderpriority, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_sxx(y, t) AS sxx, avg(t) AS mt, count(*) AS nn FROM ow GROUP BY 1)",
              select=f"SELECT o_orderpriority, {r('avg(pow((y - a - b * t) / (1 - 1.0 / nn - (t - mt) * (t - mt) / sxx), 2))')} AS cv FROM ow JOIN w USING (o_orderpriority) GROUP BY 1"),
)
def m22c(t):
    p = weekly(t).with_position("t")
    fit = reg.fit_ols(p.df, p.key, "y", ["t"])
    return reg.leave_one_out(p.df, fit, p.key, "y", ["t"])


@query(
    "M23_hilo",
    with_ctes(
        *base_ctes(LM, "lm", LMK, "month", 12),
        select=f"""SELECT {LMK}, CAST(h AS BIGINT) AS h, {r('last - 1.2815515655446004 * sd1 * sqrt(h)')} AS lower80, {r('last + 1.2815515655446004 * sd1 * sqrt(h)')} AS upper80,
    {r('last - 1.959963984540054 * sd1 * sqrt(h)')} AS lower95, {r('last + 1.959963984540054 * sd1 * sqrt(h)')} AS upper95 FROM fit, range(1, 13) g(h)""",
    ),
)
def m23(t):
    p = monthly(t)
    fc = baseline.hilo(baseline.forecast_baselines(p, "y", 12, models=("naive",)))
    return fc.select(
        *p.key, "h", F.col("hilo_80.lower").alias("lower80"), F.col("hilo_80.upper").alias("upper80"),
        F.col("hilo_95.lower").alias("lower95"), F.col("hilo_95.upper").alias("upper95"),
    )


def _paths(src: str, key: str, reps: int, steps: int) -> list[str]:
    """Resampled residuals by number, summed along each path."""
    parts = ["'1'", *[k.strip() for k in key.split(",")], "rep", "h"]
    return [
        f"bs_e AS (SELECT {key}, t, y, y - lag(y) OVER (PARTITION BY {key} ORDER BY t) AS e FROM {src})",
        f"bs_r AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY t) - 1 AS pos, e FROM bs_e WHERE e IS NOT NULL)",
        f"bs_f AS (SELECT {key}, arg_max(y, t) AS last, count(e) AS n, avg(e) AS m FROM bs_e GROUP BY {key})",
        f"bs_d AS (SELECT *, {draw_sql(*parts)} % n AS pos FROM bs_f, range(1, {reps + 1}) AS a(rep), range(1, {steps + 1}) AS b(h) WHERE n > 0)",
        f"bs AS (SELECT {key}, rep, h, last + sum(e - m) OVER (PARTITION BY {key}, rep ORDER BY h) AS sim FROM bs_d JOIN bs_r USING ({key}, pos))",
    ]


@query(
    "M24_simulated_paths",
    with_ctes(OW, *_paths("ow", "o_orderpriority", 5, 30), select=f"SELECT o_orderpriority, CAST(rep AS BIGINT) AS rep, CAST(h AS BIGINT) AS h, {r('sim')} AS sim FROM bs"),
)
def m24(t):
    """Five bootstrapped paths of thirty steps per series."""
    return baseline.bootstrap_paths(weekly(t), "y", 30, 5)


@query(
    "M25_bootstrap_forecast",
    with_ctes(LM, *_paths("lm", "l_returnflag, l_linestatus", 1000, 10),
              select=f"SELECT l_returnflag, l_linestatus, CAST(h AS BIGINT) AS h, {r('avg(sim)')} AS mean, {r('quantile_cont(sim, 0.1)')} AS lower, {r('quantile_cont(sim, 0.9)')} AS upper FROM bs GROUP BY l_returnflag, l_linestatus, h"),
)
def m25(t):
    """Interval from a thousand bootstrapped paths."""
    return baseline.bootstrap_forecast(monthly(t), "y", 10, 1000)


@query(
    "M26_ensembles",
    with_ctes(
        *base_ctes(OW, "ow", "o_orderpriority", "week", 52),
        f"z AS (SELECT o_orderpriority, h, mean AS a, last AS b, {base_forecast('snaive', 'o_orderpriority', 52)[0]} AS c, last + h * (last - first) / (nn - 1) AS e FROM fit f, range(1, 21) g(h))",
        select=f"SELECT o_orderpriority, CAST(h AS BIGINT) AS h, {r('(a + c) / 2')} AS pair, {r('(a + b + c + e) / 4')} AS four FROM z",
    ),
)
def m26(t):
    """Means of two and of four models, row by row."""
    fc = baseline.forecast_baselines(weekly(t), "y", 20)
    wide = shape.wider(fc, ["o_orderpriority", "h"], "model", baseline.MODELS, F.first("mean"))
    pair = (F.col("mean") + F.col("snaive")) / 2
    four = (F.col("mean") + F.col("naive") + F.col("snaive") + F.col("drift")) / 4
    return wide.select("o_orderpriority", "h", pair.alias("pair"), four.alias("four"))


@query(
    "J6_forecast_join_actuals",
    with_ctes(OW, "tr AS (SELECT * FROM ow WHERE t <= floor((1 - 0.1::DOUBLE) * n))", *base_ctes("", "tr", "o_orderpriority", "week", 52),
              select=f"""SELECT o_orderpriority, {d('week')} AS week, y AS actual, {r('last')} AS mean FROM ow JOIN fit USING (o_orderpriority) WHERE t > floor((1 - 0.1::DOUBLE) * n)"""),
)
def j6(t):
    """Naive forecasts matched with the actual weeks by key and index."""
    s = splits.split_by_share(weekly(t), 0.1)
    rows = splits.test(s).df
    fc = baseline.forecast_for(splits.train(s), "y", rows.select("o_orderpriority", "h"), models=("naive",))
    actual = rows.select("o_orderpriority", "week", F.col("y").alias("actual"))
    out = joins.pair_forecasts(fc, actual, ["o_orderpriority", "week"])
    return out.select("o_orderpriority", "week", "actual", "mean")
