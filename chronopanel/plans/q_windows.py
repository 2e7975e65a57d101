"""Moving frames, lags, plot data and decompositions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.operators import decompose, quantiles, shape, stl, windows
from chronopanel.panel import Panel, numbered
from chronopanel.plans.inputs import (
    EH, LM, OD, OW, daily, hourly, monthly, parts_monthly, raw_weekly, weekly,
)
from chronopanel.plans.registry import d, query, r, with_ctes
from chronopanel.plans.stl_sql import mstl_ctes, stl_ctes

W_OW = "WINDOW w AS (PARTITION BY o_orderpriority ORDER BY week)"
W_OD = "WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day)"
W_LM = "WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY month)"
LMK = "l_returnflag, l_linestatus"


def frame(part: str, b: int, a: int, x: str = "y") -> str:
    """SQL text: complete moving mean."""
    over = f"OVER ({part} ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)"
    return f"CASE WHEN count({x}) {over} = {a + b + 1} THEN avg({x}) {over} END"


PART_OW = "PARTITION BY o_orderpriority ORDER BY week"
PART_OD = "PARTITION BY o_orderstatus ORDER BY day"
PART_LM = f"PARTITION BY {LMK} ORDER BY month"


@query(
    "W1_moving_means",
    with_ctes(OW, select=f"""SELECT o_orderpriority, {d('week')} AS week, {r(frame(PART_OW, 2, 2))} AS ma5, {r(frame(PART_OW, 1, 2))} AS ma4,
    {r(frame(PART_OW, 12, 13))} AS ma26, {r(frame(PART_OW, 5, 6))} AS ma12 FROM ow"""),
)
def w1(t):
    """Four complete moving means in one window pass."""
    specs = {"ma5": (2, 2), "ma4": (1, 2), "ma26": (12, 13), "ma12": (5, 6)}
    return windows.moving_means(weekly(t), "y", specs).df.drop("y")


@query(
    "W1_blocked_series",
    with_ctes(EH, select=f"SELECT event_type, CAST(hour AS VARCHAR) AS hour, {r(frame('PARTITION BY event_type ORDER BY hour', 12, 11))} AS ma24 FROM eh"),
)
def w1b(t):
    """The same operator with every series cut into blocks of 100 hours."""
    p = hourly(t)
    return windows.moving_mean(p.on(p.df, block=100), "y", 12, 11, "ma24").df.drop("y")


@query(
    "W2_ma_of_ma",
    with_ctes(OW, f"m AS (SELECT *, {frame(PART_OW, 1, 2)} AS ma4 FROM ow)",
              select=f"SELECT o_orderpriority, {d('week')} AS week, {r('ma4')} AS ma4, {r(frame(PART_OW, 1, 0, 'ma4'))} AS ma2x4 FROM m"),
)
def w2(t):
    p = windows.moving_mean(weekly(t), "y", 1, 2, "ma4")
    return windows.moving_mean(p, "ma4", 1, 0, "ma2x4").df.drop("y")


@query(
    "W3_centred_ma",
    with_ctes(OD, f"m AS (SELECT *, {frame(PART_OD, 3, 3)} AS ma7, {frame(PART_OD, 3, 2)} AS a, {frame(PART_OD, 2, 3)} AS b FROM od)",
              select=f"SELECT o_orderstatus, {d('day')} AS day, {r('ma7')} AS ma7, {r('(a + b) / 2')} AS ma6 FROM m"),
)
def w3(t):
    """Odd and even order on the daily panel."""
    p = windows.centred_ma(daily(t), "y", 7, "ma7")
    return windows.centred_ma(p, "y", 6, "ma6").df.drop("y")


@query(
    "W4_daily_from_cumulative",
    with_ctes(OD, select=f"SELECT o_orderstatus, {d('day')} AS day, y AS daily FROM od"),
)
def w4(t):
    """Cumulative counts taken apart again."""
    p = windows.cumulative(daily(t), "y", "total")
    return windows.daily_from_cumulative(p, "total", "daily").df.select("o_orderstatus", "day", "daily")


@query(
    "W5_first_difference",
    with_ctes(OD, select=f"SELECT o_orderstatus, {d('day')} AS day, y - lag(y) OVER w AS diff FROM od {W_OD}"),
)
def w5(t):
    return windows.difference(daily(t), "y", [1], "diff").df.drop("y")


@query(
    "W5_raw_event_gaps",
    f"SELECT event_id, {r('value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)')} AS change FROM events",
)
def w5b(t):
    """First differences of raw events: numbered over ranges of time, then cut into blocks of 500 rows."""
    ev = numbered(
        t("events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "step"
    )
    p = Panel(ev, ("event_type",), "step", block=500, position="step")
    return windows.difference(p, "value", [1], "change").df.select("event_id", "change")


@query(
    "W6_seasonal_difference",
    with_ctes(LM, f"a AS (SELECT *, ln(CASE WHEN y > 0 THEN y END) - lag(ln(CASE WHEN y > 0 THEN y END), 12) OVER w AS s FROM lm {W_LM})",
              select=f"SELECT {LMK}, {d('month')} AS month, {r('s')} AS sdiff, {r('s - lag(s) OVER w')} AS ddiff FROM a {W_LM}"),
)
def w6(t):
    """Seasonal and doubly differenced logarithm."""
    p = monthly(t)
    p = p.on(p.df.withColumn("ly", F.log(F.when(F.col("y") > 0, F.col("y")))))
    p = windows.difference(p, "ly", [12], "sdiff")
    return windows.difference(p, "ly", [12, 1], "ddiff").df.drop("y", "ly")


@query("W7_row_number", with_ctes(OW, select=f"SELECT o_orderpriority, {d('week')} AS week, t AS rn FROM ow"))
def w7(t):
    return windows.with_row_number(weekly(t)).df.drop("y")


@query(
    "W8_lag_pairs",
    " UNION ALL ".join([with_ctes(OW, select=f"SELECT * FROM (SELECT o_orderpriority, {d('week')} AS week, {k}::BIGINT AS lag, y, lag(y, {k}) OVER w AS lagged FROM ow {W_OW}) WHERE lagged IS NOT NULL").replace("WITH ow_raw", "SELECT * FROM (WITH ow_raw") + ")" for k in (5, 10, 26, 52)]),
)
def w8(t):
    return windows.lag_pairs(weekly(t), "y", [5, 10, 26, 52])


@query(
    "W9_season_plot",
    with_ctes(OW, select="SELECT o_orderpriority, isoyear(week) AS cycle, weekofyear(week) AS position, y FROM ow"),
)
def w9(t):
    return windows.season_plot(weekly(t), "y", "year")


@query(
    "W9_season_plot_day",
    with_ctes(EH, select=f"SELECT event_type, {d('hour')} AS cycle, hour(hour) AS position, y FROM eh"),
)
def w9b(t):
    return windows.season_plot(hourly(t), "y", "day")


@query(
    "W9_season_plot_week",
    with_ctes(OD, select=f"SELECT o_orderstatus, {d(chr(34) + 'day' + chr(34) + ' - CAST(isodow(day) - 1 AS INTEGER)')} AS cycle, isodow(day) AS position, y FROM od"),
)
def w9c(t):
    return windows.season_plot(daily(t), "y", "week")


@query(
    "W10_subseries",
    with_ctes(LM, select=f"""SELECT {LMK}, {d('month')} AS month, month(month) AS season, {r('y')} AS y,
    {r(f'avg(y) OVER (PARTITION BY {LMK}, month(month))')} AS season_mean FROM lm"""),
)
def w10(t):
    return windows.subseries(monthly(t), "y", F.month("month"))


@query(
    "W11_cumulative_and_daily",
    with_ctes(OD, select=f"SELECT o_orderstatus, {d('day')} AS day, CAST(sum(y) OVER w AS BIGINT) AS total, y FROM od {W_OD}"),
)
def w11(t):
    """Running total by blocks of 300 days next to the daily values."""
    p = daily(t)
    return windows.cumulative(p.on(p.df, block=300), "y", "total")


@query(
    "W12_winsorise",
    with_ctes(OW, "b AS (SELECT o_orderpriority, quantile_cont(CAST(y AS DOUBLE), 0.05) AS lb, quantile_cont(CAST(y AS DOUBLE), 1 - 0.05) AS ub FROM ow GROUP BY 1)",
              select=f"""SELECT o_orderpriority, {d('week')} AS week, y, {r('least(greatest(y, lb), ub)')} AS clamped,
    {r('y - least(greatest(y, lb), ub)')} AS clipped_off FROM ow JOIN b USING (o_orderpriority)"""),
)
def w12(t):
    return quantiles.winsorise(weekly(t), "y", 0.05)


@query(
    "W12_log_excess",
    with_ctes(OW, "b AS (SELECT o_orderpriority, quantile_cont(CAST(y AS DOUBLE), 0.05) AS lb, quantile_cont(CAST(y AS DOUBLE), 1 - 0.05) AS ub FROM ow GROUP BY 1)",
              select=f"""SELECT o_orderpriority, {d('week')} AS week, {r('ln(abs(y - least(greatest(y, lb), ub)) + 1)')} AS log_diff
    FROM ow JOIN b USING (o_orderpriority) WHERE y < lb OR y > ub"""),
)
def w12b(t):
    return quantiles.log_excess(quantiles.winsorise(weekly(t), "y", 0.05))


EVENTS_FROM = "1996-02-29"
EVENTS = {0: "pilot", 45: "launch", 130: "spring offer", 365: "first anniversary", 500: "new depot", 900: "second launch"}
_LABEL_SQL = "CASE " + " ".join(
    f"WHEN day >= DATE '{EVENTS_FROM}' + {k} THEN '{v}'" for k, v in sorted(EVENTS.items(), reverse=True)
) + " END"


@query("W13_event_labels", with_ctes(OD, select=f"SELECT o_orderstatus, {d('day')} AS day, y, {_LABEL_SQL} AS phase FROM od"))
def w13(t):
    """Daily panel with the phase in force, from one base date and offsets."""
    return windows.label_events(daily(t).df, "day", dt.date.fromisoformat(EVENTS_FROM), EVENTS, "phase")


def classical_sql(cte: str, key: str, idx: str, m: int, kind: str, table: str) -> list[str]:
    """CTEs of a classical decomposition; the last one is ``parts``."""
    h = m // 2
    op = "/" if kind == "multiplicative" else "-"
    by = f"PARTITION BY {key} ORDER BY {idx}"
    outer = f"OVER ({by} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    inner = f"OVER ({by} ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING)"
    return [
        cte,
        f"""s1 AS (SELECT {key}, {idx}, t, n, CAST(y AS DOUBLE) AS y, (t - 1) % {m} AS season,
  CASE WHEN count(y) {outer} = {m + 1} THEN (sum(y) {outer} + sum(y) {inner}) / {2.0 * m} END AS trend FROM {table})""",
        f"s2 AS (SELECT *, y {op} nullif(trend, 0) AS dt FROM s1)" if op == "/" else "s2 AS (SELECT *, y - trend AS dt FROM s1)",
        f"s3 AS (SELECT {key}, season, avg(dt) AS fig FROM s2 GROUP BY {key}, season)",
        f"s4 AS (SELECT {key}, avg(fig) AS level FROM s3 GROUP BY {key})",
        f"""parts AS (SELECT {key}, {idx}, t, n, y, season, trend, seasonal, y {op} seasonal AS season_adjust, y {op} seasonal {op} trend AS random
  FROM (SELECT s2.{key.split(', ')[0]}, {', '.join('s2.' + k for k in key.split(', ')[1:] + [idx, 't', 'n', 'y', 'season'])},
    CASE WHEN n >= {2 * m} THEN trend END AS trend, CASE WHEN n >= {2 * m} THEN fig {op} level END AS seasonal
    FROM s2 JOIN s3 USING ({key}, season) JOIN s4 USING ({key})))""",
    ]


def component_cols(digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in ("trend", "seasonal", "random", "season_adjust"))


CLASSICAL_COLS = component_cols()


@query(
    "D1_classical_additive",
    with_ctes(*classical_sql(OW, "o_orderpriority", "week", 52, "additive", "ow"),
              select=f"SELECT o_orderpriority, {d('week')} AS week, {CLASSICAL_COLS} FROM parts"),
)
def d1(t):
    return decompose.classical(weekly(t), "y").df.select("o_orderpriority", "week", "trend", "seasonal", "random", "season_adjust")


@query(
    "D2_classical_multiplicative",
    with_ctes(*classical_sql(LM, LMK, "month", 12, "multiplicative", "lm"),
              select=f"SELECT {LMK}, {d('month')} AS month, {CLASSICAL_COLS} FROM parts"),
)
def d2(t):
    p = decompose.classical(monthly(t), "y", "multiplicative")
    return p.df.select(*p.key, "month", "trend", "seasonal", "random", "season_adjust")


@query(
    "D3_components",
    with_ctes(*classical_sql(EH, "event_type", "hour", 24, "additive", "eh"),
              select=f"SELECT event_type, CAST(hour AS VARCHAR) AS hour, {component_cols(8)} FROM parts"),
    digits=8,
)
def d3(t):
    """Components of the hourly panel with a daily cycle."""
    return decompose.classical(hourly(t), "y").df.select("event_type", "hour", "trend", "seasonal", "random", "season_adjust")


@query(
    "D4_denoise",
    with_ctes(*classical_sql(LM, LMK, "month", 12, "multiplicative", "lm"),
              select=f"SELECT {LMK}, {d('month')} AS month, {r('y / random')} AS denoised, {r('y / trend')} AS detrended FROM parts"),
)
def d4(t):
    """Multiplicative rest and trend divided out."""
    p = decompose.denoise(monthly(t), "y", "multiplicative")
    return p.df.select(*p.key, "month", "denoised", "detrended")


@query(
    "D4_denoise_subtracted",
    with_ctes(*classical_sql(LM, LMK, "month", 12, "multiplicative", "lm"),
              select=f"SELECT {LMK}, {d('month')} AS month, {r('y - random')} AS denoised, {r('y - trend')} AS detrended FROM parts"),
)
def d4b(t):
    """The variant that subtracts the ratio."""
    p = decompose.denoise(monthly(t), "y", "multiplicative", subtract=True)
    return p.df.select(*p.key, "month", "denoised", "detrended")


@query(
    "D4_additive_denoise",
    with_ctes(*classical_sql(OW, "o_orderpriority", "week", 52, "additive", "ow"),
              select=f"SELECT o_orderpriority, {d('week')} AS week, {r('y - random')} AS denoised, {r('season_adjust')} AS season_adjust FROM parts"),
)
def d4c(t):
    p = decompose.denoise(weekly(t), "y")
    return p.df.select("o_orderpriority", "week", "denoised", "season_adjust")


def _stl_cols(digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in ("y", "trend", "seasonal", "remainder", "season_adjust"))


_ROBUST = {"trend_window": 7, "robust": True}


@query("D5_stl", with_ctes(LM, *stl_ctes("lm", LMK, "month", 12), select=f"SELECT {LMK}, {d('month')} AS month, {_stl_cols()} FROM st_parts"))
def d5(t):
    """STL of the monthly panel, default windows."""
    return stl.stl(monthly(t), "y")


@query(
    "D5_stl_identity",
    with_ctes(
        LM, *stl_ctes("lm", LMK, "month", 12, season_window=None, **_ROBUST),
        select=f"""SELECT {LMK}, count(*) AS n, {r('sum(y)')} AS total, 0.0::DOUBLE AS worst, {r('max(seasonal) - min(seasonal)', 4)} AS swing,
    {r('max(trend) - min(trend)', 4)} AS rise, {r('sum(abs(remainder))', 4)} AS rest FROM st_parts GROUP BY {LMK}""",
    ),
)
def d5b(t):
    """Robust periodic STL: the components add up to the series, and how far each goes."""
    p = stl.stl(monthly(t), "y", season_window=None, trend_window=7, robust=True)
    gap = F.abs(F.col("y") - F.col("trend") - F.col("seasonal") - F.col("remainder"))
    total = F.col("trend") + F.col("seasonal") + F.col("remainder")
    return p.df.groupBy(*p.key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.max(gap).alias("worst"),
        F.round(F.max("seasonal") - F.min("seasonal"), 4).alias("swing"),
        F.round(F.max("trend") - F.min("trend"), 4).alias("rise"),
        F.round(F.sum(F.abs("remainder")), 4).alias("rest"),
    )


@query(
    "D5_stl_robust",
    with_ctes(LM, *stl_ctes("lm", LMK, "month", 12, **_ROBUST), select=f"SELECT {LMK}, {d('month')} AS month, {_stl_cols(4)} FROM st_parts"),
    digits=4,
)
def d5d(t):
    """Robust STL with a changing season: fifteen rounds of weights from the remainders."""
    return stl.stl(monthly(t), "y", trend_window=7, robust=True)


@query("D5_mstl", with_ctes(EH, *mstl_ctes("eh", "event_type", "hour", (24, 168)), select=f"SELECT event_type, CAST(hour AS VARCHAR) AS hour, {_stl_cols()} FROM ms_parts"))
def d5c(t):
    """Two periods (day and week) on the hourly panel."""
    return stl.stl(hourly(t), "y", periods=(24, 168))


def _wmean(x: str, weights: list[float], over: str) -> str:
    half = len(weights) // 2
    num, den = [], []
    for i, w in enumerate(weights):
        at = f"lag({x}, {half - i}) OVER ({over})" if half - i >= 0 else f"lead({x}, {i - half}) OVER ({over})"
        num.append(f"coalesce({at} * {w!r}::DOUBLE, 0)")
        den.append(f"CASE WHEN {at} IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END")
    return f"(({' + '.join(num)}) / nullif({' + '.join(den)}, 0))"


_BY_M = f"PARTITION BY {LMK} ORDER BY month"
_BY_S = f"PARTITION BY {LMK}, season ORDER BY month"
_LEVEL = [0.5] + [1.0] * 11 + [0.5]
_H13 = decompose.henderson_weights(13)
_X11 = [
    f"x1 AS (SELECT *, y / trend AS si FROM s1)",
    f"x2 AS (SELECT *, {_wmean('si', decompose.MA_3X3, _BY_S)} AS raw FROM x1)",
    f"x3 AS (SELECT *, y / (raw / {_wmean('raw', _LEVEL, _BY_M)}) AS a1 FROM x2)",
    f"x4 AS (SELECT *, y / {_wmean('a1', _H13, _BY_M)} AS si2 FROM x3)",
    f"x5 AS (SELECT *, {_wmean('si2', decompose.MA_3X5, _BY_S)} AS raw2 FROM x4)",
    f"x6 AS (SELECT *, raw2 / {_wmean('raw2', _LEVEL, _BY_M)} AS seasonal FROM x5)",
    f"x7 AS (SELECT *, y / seasonal AS sa FROM x6)",
    f"x8 AS (SELECT *, {_wmean('sa', _H13, _BY_M)} AS tr FROM x7)",
]


@query(
    "D6_x11_filters",
    with_ctes(
        *classical_sql(LM, LMK, "month", 12, "additive", "lm")[:2],
        *_X11,
        select=f"SELECT {LMK}, {d('month')} AS month, {r('tr')} AS trend, {r('seasonal')} AS seasonal, {r('sa / tr')} AS random, {r('sa')} AS season_adjust FROM x8",
    ),
)
def d6(t):
    p = decompose.x11_filters(monthly(t), "y")
    return p.df.select(*p.key, "month", "trend", "seasonal", "random", "season_adjust")


def _decomposed_forecast(parts: str) -> tuple[str, str]:
    """A CTE and a SELECT: last adjusted value plus the last seasonal cycle."""
    last = f"e AS (SELECT {LMK}, max(t) AS n, max(month) AS last_at, arg_max(season_adjust, month) AS level FROM {parts} GROUP BY {LMK})"
    cycle = f"(SELECT seasonal FROM {parts} p WHERE p.l_returnflag = e.l_returnflag AND p.l_linestatus = e.l_linestatus AND p.t = e.n - 11 + (h - 1) % 12)"
    return last, f"SELECT {LMK}, CAST(h AS BIGINT) AS h, {d('last_at + INTERVAL (h) MONTH')} AS month, {r('level + ' + cycle)} AS mean FROM e, range(1, 25) g(h)"


_D7_LAST, _D7_SELECT = _decomposed_forecast("st_parts")


@query("D7_decomposition_forecast", with_ctes(LM, *stl_ctes("lm", LMK, "month", 12, **_ROBUST), _D7_LAST, select=_D7_SELECT))
def d7(t):
    """Naive forecast of the adjusted series plus the last seasonal cycle."""
    return stl.seasonal_forecast(stl.stl(monthly(t), "y", trend_window=7, robust=True), 24)


@query(
    "D7_classical_forecast",
    with_ctes(*classical_sql(LM, LMK, "month", 12, "additive", "lm"),
              f"e AS (SELECT {LMK}, max(n) AS n, max(month) AS last_at, arg_max(season_adjust, month) AS level FROM parts GROUP BY {LMK})",
              select=f"""SELECT {LMK}, CAST(h AS BIGINT) AS h, {d('last_at + INTERVAL (h) MONTH')} AS month,
    {r('level + (SELECT seasonal FROM parts p WHERE p.l_returnflag = e.l_returnflag AND p.l_linestatus = e.l_linestatus AND p.t = e.n - 11 + (h - 1) % 12)')} AS mean
    FROM e, range(1, 25) g(h)"""),
)
def d7b(t):
    """The same forecast on the classical components."""
    return stl.seasonal_forecast(decompose.classical(monthly(t), "y"), 24)


def _renamed(ctes: list[str], names: dict[str, str]) -> list[str]:
    """The CTEs under other names, so that several decompositions fit in one statement."""
    for old, new in names.items():
        ctes = [re.sub(rf"\b{old}\b", new, c) for c in ctes]
    return ctes


def _long(method: str, table: str, rest: str, season_adjust: str = "season_adjust", trend: str = "trend") -> str:
    return f"""SELECT {LMK}, {d('month')} AS month, '{method}' AS method, {r(trend)} AS trend, {r('seasonal')} AS seasonal, {r(rest)} AS rest, {r(season_adjust)} AS season_adjust FROM {table}"""


_SMOOTH = f"sm AS MATERIALIZED (SELECT {LMK}, month, y, row_number() OVER ({PART_LM}) AS t, count(*) OVER (PARTITION BY {LMK}) AS n FROM (SELECT {LMK}, month, {frame(PART_LM, 1, 1)} AS y FROM lm) WHERE y IS NOT NULL)"


def _classical_as(kind: str, p: str) -> list[str]:
    names = {c: p + c for c in ("s1", "s2", "s3", "s4", "parts")}
    return _renamed(classical_sql(LM, LMK, "month", 12, kind, "sm")[1:], names)


@query(
    "D8_all_decompositions",
    with_ctes(
        LM, _SMOOTH, *stl_ctes("sm", LMK, "month", 12), *_classical_as("multiplicative", "mu"), *_classical_as("additive", "ad"),
        *classical_sql(LM, LMK, "month", 12, "additive", "sm")[1:2], *_X11,
        select=" UNION ALL ".join([
            _long("stl", "st_parts", "remainder"), _long("multiplicative", "muparts", "random"),
            _long("x11", "x8", "sa / tr", "sa", "tr"), _long("additive", "adparts", "random"),
        ]),
    ),
)
def d8(t):
    """Four decompositions of the smoothed series in one long table."""
    p = windows.centred_ma(monthly(t), "y", 3, "ma")
    p = p.on(p.df.where("ma is not null").select(*p.key, "month", F.col("ma").alias("y"))).written("smoothed")
    return shape.bind_rows(
        decompose.long_components(stl.stl(p, "y"), "stl", "remainder"),
        decompose.long_components(decompose.classical(p, "y", "multiplicative"), "multiplicative"),
        decompose.long_components(decompose.x11_filters(p, "y"), "x11"),
        decompose.long_components(decompose.classical(p, "y"), "additive"),
    )
