"""Splits, accuracy, distribution scores, validation and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions.dates import in_month, in_span
from chronopanel.operators import aggregate, baseline, decompose, evaluate, features, regression as reg, shape, splits, stl, windows
from chronopanel.panel import Panel
from chronopanel.plans import battery
from chronopanel.plans.inputs import LM, MODEL, OD, OW, PM, daily, model_panel, monthly, parts_monthly, weekly
from chronopanel.plans.q_features import acf_ctes, acf_long
from chronopanel.plans.q_models import MP_SEASON, base_ctes, base_forecast, cramer, demeaned
from chronopanel.plans.q_windows import LMK, classical_sql, frame
from chronopanel.plans.projection import projected
from chronopanel.plans.registry import d, query, r, with_ctes

K = "o_orderpriority"


def split_ctes(p: float, src: str = "ow") -> list[str]:
    k = f"CAST(floor((1 - {p}::DOUBLE) * n) AS BIGINT)"
    return [
        f"tr AS (SELECT * FROM {src} WHERE t <= {k})",
        f"te AS (SELECT *, t - {k} AS h FROM {src} WHERE t > {k})",
    ]


def pair_cte(models: list[str], key: str = K, m: int = 52) -> str:
    """CTE ``pairs``: (key, model, h, actual, mean, sd) on the test rows."""
    same = " AND ".join(f"f.{k} = te.{k}" for k in key.split(", "))
    parts = []
    for mod in models:
        mean, sd = base_forecast(mod, key, m)
        cols = ", ".join(f"te.{k}" for k in key.split(", "))
        parts.append(f"SELECT {cols}, '{mod}' AS model, h, CAST(te.y AS DOUBLE) AS actual, CAST({mean} AS DOUBLE) AS mean, {sd} AS sd FROM fit f JOIN te ON {same}")
    return "pairs AS (" + " UNION ALL ".join(parts) + ")"


def accuracy_ctes(by: str, src: str = "pairs") -> list[str]:
    return [
        f"er AS (SELECT *, actual - mean AS e FROM {src} WHERE actual - mean IS NOT NULL)",
        f"ec AS (SELECT *, e - avg(e) OVER (PARTITION BY {by}) AS c FROM er)",
        f"el AS (SELECT *, lag(c) OVER (PARTITION BY {by} ORDER BY h) AS cl FROM ec)",
        f"""acc AS (SELECT {by}, avg(e) AS me, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(e * 100 / nullif(actual, 0)) AS mpe,
  avg(abs(e * 100 / nullif(actual, 0))) AS mape, sum(c * cl) / nullif(sum(c * c), 0) AS acf1 FROM el GROUP BY {by})""",
    ]


ACC = ", ".join(f"{r(c)} AS {c}" for c in ("me", "rmse", "mae", "mpe", "mape", "acf1"))
FOUR = ["mean", "naive", "snaive", "drift"]
SPLIT20 = [OW, *split_ctes(0.2), *base_ctes("", "tr", K, "week", 52)]


@query("EV1_split_by_share", with_ctes(OW, *split_ctes(0.2), select=f"SELECT {K}, {d('week')} AS week, t, y, 'train' AS part, CAST(NULL AS BIGINT) AS h FROM tr UNION ALL SELECT {K}, {d('week')}, t, y, 'test', h FROM te"))
def ev1(t):
    return splits.split_by_share(weekly(t), 0.2)


@query(
    "EV1_split_raw_rows",
    """WITH x AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_id, event_type, t, CASE WHEN t > CAST(floor((1 - 0.3::DOUBLE) * n) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM x""",
)
def ev1b(t):
    """Ordered split of raw events in blocks, without gathering a type in one task."""
    from chronopanel.panel import numbered

    ev = numbered(t("events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], "step")
    p = Panel(ev, ("event_type",), "step", block=500, position="step")
    return splits.split_by_share(p, 0.3).df.select("event_id", "event_type", "t", "part")


@query(
    "EV2_split_last_rows",
    with_ctes(OD, select=f"""SELECT o_orderstatus, {d('day')} AS day, y, CASE WHEN t > n - CAST(round_even(n * 0.05::DOUBLE, 0) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM od"""),
)
def ev2(t):
    """The last round(n d) rows, halves to even."""
    return splits.split_last(daily(t), 0.05).df.select("o_orderstatus", "day", "y", "part")


@query(
    "EV3_share_sweep",
    with_ctes(
        OW,
        "ps AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS p)",
        "sw AS (SELECT *, CAST(floor((1 - p) * n) AS BIGINT) AS k FROM ow, ps)",
        "tr AS (SELECT * FROM sw WHERE t <= k)",
        "te AS (SELECT *, t - k AS h FROM sw WHERE t > k)",
        *base_ctes("", "tr", f"p, {K}", "week", 52),
        pair_cte(["naive", "snaive", "drift"], f"p, {K}"),
        *accuracy_ctes(f"p, {K}, model"),
        select=f"SELECT p, {K}, model, {ACC} FROM acc",
    ),
)
def ev3(t):
    """All benchmark models over six splits in one plan; nothing loops."""
    s = battery.prepared(weekly(t))
    return evaluate.accuracy(battery.baseline_pairs(s, "y"), ["p", K, "model"])


@query(
    "EV3_sweep_tslm_base",
    with_ctes(
        OW,
        "ps AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS p)",
        "sw AS (SELECT *, CAST(floor((1 - p) * n) AS BIGINT) AS k, (t - 1) % 52 AS season FROM ow, ps)",
        "tr AS (SELECT *, y - avg(y) OVER s AS zy, t - avg(t) OVER s AS zt FROM sw WHERE t <= k WINDOW s AS (PARTITION BY p, o_orderpriority, season))",
        f"b AS (SELECT p, {K}, sum(zy * zt) / sum(zt * zt) AS b FROM tr GROUP BY ALL)",
        f"sm AS (SELECT p, {K}, season, avg(y) AS my, avg(t) AS mt FROM tr GROUP BY ALL)",
        f"pairs AS (SELECT p, {K}, t - k AS h, CAST(y AS DOUBLE) AS actual, my + b * (t - mt) AS mean FROM sw JOIN b USING (p, {K}) JOIN sm USING (p, {K}, season) WHERE t > k)",
        *accuracy_ctes(f"p, {K}"),
        select=f"SELECT p, {K}, {ACC} FROM acc",
    ),
)
def ev3b(t):
    """Trend and season regression over the same six splits."""
    s = battery.prepared(weekly(t))
    key = list(s.key)
    train, test = splits.train(s).df, splits.test(s).df
    out = reg.predict_seasonal(test, reg.fit_seasonal(train, key, "y", ["t"]), key, ["t"])
    return evaluate.accuracy(out.withColumnRenamed("y", "actual"), key)


@query(
    "EV3_share_sweep_denoised",
    with_ctes(
        *classical_sql(OW, K, "week", 52, "additive", "ow"),
        f"dn AS (SELECT {K}, week, y - random AS y, row_number() OVER (PARTITION BY {K} ORDER BY week) AS t, count(*) OVER (PARTITION BY {K}) AS n FROM parts WHERE random IS NOT NULL)",
        "ps AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS p)",
        "sw AS (SELECT *, CAST(floor((1 - p) * n) AS BIGINT) AS k FROM dn, ps)",
        "tr AS (SELECT * FROM sw WHERE t <= k)",
        "te AS (SELECT *, t - k AS h FROM sw WHERE t > k)",
        *base_ctes("", "tr", f"p, {K}", "week", 52),
        pair_cte(["naive", "snaive", "drift"], f"p, {K}"),
        *accuracy_ctes(f"p, {K}, model"),
        select=f"SELECT p, {K}, model, {ACC} FROM acc",
    ),
)
def ev3d(t):
    """The sweep on the additively denoised target, decomposed over the whole series."""
    p = decompose.denoise(weekly(t), "y")
    p = p.on(p.df.where("denoised IS NOT NULL").select(K, "week", "denoised"))
    s = battery.prepared(p)
    return evaluate.accuracy(battery.baseline_pairs(s, "denoised"), ["p", K, "model"])


@query("EV3_full_battery")
def ev3c(t):
    """Twelve models over six splits of every series: accuracy with model families."""
    s = battery.prepared(model_panel(t)).written("splits")
    pairs = battery.all_pairs(s, "y")
    scores = evaluate.accuracy(pairs, ["p", K, "model"])
    return battery.result_table(scores)


@query("EV3_regressions_with_holiday")
def ev3h(t):
    """The four regressions over six splits, the interaction model with the holiday flag too."""
    s = battery.prepared(model_panel(t)).written("splits")
    return evaluate.accuracy(battery.regression_pairs(s, "y", battery.FLAGS), ["p", K, "model"])


def _denoised_battery(p):
    """All twelve models on a denoised target, with the covariates of the original panel."""
    s = battery.prepared(p).written("splits")
    return battery.result_table(evaluate.accuracy(battery.all_pairs(s, "denoised"), ["p", K, "model"]))


@query("EV3_battery_additive")
def ev3e(t):
    """The battery on the target without the rest of its additive decomposition."""
    p = decompose.denoise(model_panel(t), "y")
    return _denoised_battery(p.on(p.df.where("denoised IS NOT NULL").drop("y", "trend", "seasonal", "random", "season_adjust", "detrended", "t", "season")))


@query("EV3_battery_stl")
def ev3f(t):
    """The battery on the target without the remainder of its STL decomposition."""
    p = model_panel(t).written("panel")
    parts = stl.stl(p, "y").df.select(*p.key, p.index, (F.col("y") - F.col("remainder")).alias("denoised"))
    return _denoised_battery(p.on(p.df.join(parts, [*p.key, p.index]).where("denoised IS NOT NULL").drop("y", "t", "season")))


@query(
    "EV4_date_windows",
    with_ctes(OW, select=f"""SELECT {K}, {d('week')} AS week, y, CASE WHEN week < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS part FROM ow
    WHERE (week >= DATE '1996-01-01' AND week < DATE '2000-01-01') OR (week >= DATE '2000-01-01' AND week < DATE '2000-02-01')"""),
)
def ev4(t):
    """Train on four years, test on the next month."""
    return splits.date_window(weekly(t), in_span("week", "1996", "1999"), in_month("week", 2000, 1))


@query(
    "EV5_expanding_validation",
    with_ctes(
        OW,
        f"w AS (SELECT *, lag(y) OVER (PARTITION BY {K} ORDER BY week) AS l1, first(y) OVER (PARTITION BY {K} ORDER BY week) AS f, avg(y) OVER (PARTITION BY {K} ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mn FROM ow)",
        select=" UNION ALL ".join(
            f"SELECT {K}, t - 1 AS origin, '{m}' AS model, CAST(y AS DOUBLE) AS actual, {r(e)} AS pred FROM w WHERE t - 1 >= 3"
            for m, e in {"mean": "mn", "naive": "l1", "drift": "l1 + (l1 - f) / (t - 2)"}.items()
        ),
    ),
)
def ev5(t):
    """One-step forecasts of every expanding fold in linear time."""
    return splits.expanding_one_step(weekly(t), "y", 3)


@query(
    "EV5_validation_accuracy",
    with_ctes(
        OW,
        f"w AS (SELECT *, lag(y) OVER (PARTITION BY {K} ORDER BY week) AS l1, first(y) OVER (PARTITION BY {K} ORDER BY week) AS f FROM ow)",
        f"pairs AS (SELECT {K}, t AS h, CAST(y AS DOUBLE) AS actual, l1 + (l1 - f) / (t - 2) AS mean FROM w WHERE t - 1 >= 3)",
        *accuracy_ctes(K), select=f"SELECT {K}, {ACC} FROM acc",
    ),
)
def ev5b(t):
    cv = splits.expanding_one_step(weekly(t), "y", 3).where("model = 'drift'")
    return evaluate.accuracy(cv, [K], pred="pred", order="origin")


@query(
    "EV5_materialised_folds",
    with_ctes(LM, select=f"SELECT {LMK}, CAST(o AS BIGINT) AS origin, count(*) AS n, {r('avg(y)')} AS mean FROM lm, range(24, 1000, 12) g(o) WHERE t <= o AND o <= n GROUP BY {LMK}, o"),
)
def ev5c(t):
    """Sums of every twelve-month fold, one row a fold, however long the series is."""
    folds = splits.expanding_sums(monthly(t), ["y"], 24, 12)
    return folds.select(*LMK.split(", "), "origin", "n", (F.col("sums")[0] / F.col("n")).alias("mean"))


@query("EV6_accuracy", with_ctes(*SPLIT20, pair_cte(FOUR), *accuracy_ctes(f"{K}, model"),
                                 f"sc_d AS (SELECT {K}, y - lag(y, 52) OVER (PARTITION BY {K} ORDER BY week) AS d FROM tr)",
                                 f"sc AS (SELECT {K}, avg(abs(d)) AS ma, avg(d * d) AS ms FROM sc_d GROUP BY 1)",
                                 select=f"SELECT {K}, model, {ACC}, {r('mae / nullif(ma, 0)')} AS mase, {r('rmse / sqrt(ms)')} AS rmsse FROM acc JOIN sc USING ({K})"))
def ev6(t):
    """Point accuracy with scaled errors."""
    s = splits.split_by_share(weekly(t), 0.2)
    pairs = battery.baseline_pairs(s, "y", models=baseline.MODELS)
    scale = evaluate.naive_scale(splits.train(s), "y")
    return evaluate.accuracy(pairs, [K, "model"], scale=scale, scale_on=[K])


@query(
    "EV6_training_accuracy",
    with_ctes(
        OW, f"pairs AS (SELECT {K}, t AS h, CAST(y AS DOUBLE) AS actual, CAST(lag(y) OVER (PARTITION BY {K} ORDER BY week) AS DOUBLE) AS mean FROM ow)",
        *accuracy_ctes(K), select=f"SELECT {K}, 'naive' AS model, {ACC} FROM acc",
    ),
)
def ev6b(t):
    fitted = baseline.fitted_baselines(weekly(t), "y").where("model = 'naive'")
    return evaluate.accuracy(fitted, [K, "model"], actual="y", pred="fitted", order="t")


@query(
    "EV7_rmse_columns",
    with_ctes(
        LM, f"w AS (SELECT *, lag(y) OVER x AS a, lag(y, 12) OVER x AS b FROM lm WINDOW x AS (PARTITION BY {LMK} ORDER BY month))",
        select=f"SELECT {LMK}, {r('sqrt(avg(pow(y - a, 2)))')} AS a, {r('sqrt(avg(pow(y - b, 2)))')} AS b FROM w GROUP BY {LMK}",
    ),
)
def ev7(t):
    """RMSE of two prediction columns; NULL pairs drop out."""
    p = monthly(t)
    w = p.window()
    df = p.df.withColumns({"a": F.lag("y").over(w), "b": F.lag("y", 12).over(w)})
    return evaluate.rmse(df, p.key, "y", ["a", "b"])


KM = "o_orderstatus, measure"


@query(
    "EV7_ensemble_rmse",
    with_ctes(
        OD.replace("count(*) AS y FROM orders", "count(*) AS y, count(*) FILTER (o_totalprice > 250000) AS big FROM orders"),
        "lg AS (SELECT o_orderstatus, 'orders' AS measure, day, y FROM od UNION ALL SELECT o_orderstatus, 'large', day, coalesce(big, 0) FROM od_fill)",
        f"sm AS (SELECT {KM}, day, {frame(f'PARTITION BY {KM} ORDER BY day', 3, 3)} AS y FROM lg)",
        f"kp AS (SELECT *, row_number() OVER (PARTITION BY {KM} ORDER BY day) AS t, count(*) OVER (PARTITION BY {KM}) AS n FROM sm WHERE y IS NOT NULL)",
        "sp AS (SELECT *, n - CAST(round_even(n * 0.05::DOUBLE, 0) AS BIGINT) AS k FROM kp)",
        "tr AS (SELECT * FROM sp WHERE t <= k)", "te AS (SELECT *, t - k AS h FROM sp WHERE t > k)",
        *base_ctes("", "tr", KM, "day", 7), pair_cte(FOUR, KM, 7),
        f"wd AS (SELECT {KM}, h, max(actual) AS a, " + ", ".join(f"max(mean) FILTER (model = '{m}') AS {m}" for m in FOUR) + f" FROM pairs GROUP BY {KM}, h)",
        select=f"SELECT {KM}, " + ", ".join(f"{r(f'sqrt(avg(pow(a - {e}, 2)))')} AS {n}" for n, e in {
            "mean": '"mean"', "naive": "naive", "snaive": "snaive", "drift": "drift", "pair": '(("mean" + snaive) / 2)', "four": '(("mean" + naive + snaive + drift) / 4)'}.items()) + f" FROM wd GROUP BY {KM}",
    ),
)
def ev7b(t):
    """Two measures as one key: smooth, split, forecast, ensembles, RMSE per column."""
    from chronopanel.panel import fill_gaps

    raw = aggregate.roll_up(
        t("orders"), "o_orderdate", "day", ["o_orderstatus"], "day",
        orders=F.count(F.lit(1)), large=F.count_if(F.col("o_totalprice") > 250000),
    )
    wide = fill_gaps(raw, {"orders": 0, "large": 0})
    long = shape.longer(wide.df, ["o_orderstatus", "day"], ["orders", "large"], "measure", "y")
    p = windows.moving_mean(Panel(long, ("o_orderstatus", "measure"), "day", "day"), "y", 3, 3, "ma")
    p = p.on(p.df.where("ma IS NOT NULL").select(*p.key, "day", "ma"))
    pairs = battery.baseline_pairs(splits.split_last(p, 0.05), "ma", models=baseline.MODELS)
    rows = shape.wider(pairs, [*p.key, "h", "actual"], "model", baseline.MODELS, F.first("mean"))
    rows = rows.withColumns(
        {
            "pair": (F.col("mean") + F.col("snaive")) / 2,
            "four": (F.col("mean") + F.col("naive") + F.col("snaive") + F.col("drift")) / 4,
        }
    )
    return evaluate.rmse(rows, p.key, "actual", [*baseline.MODELS, "pair", "four"])


def _z(p: float) -> float:
    from chronopanel.functions.tails import normal_quantile

    return normal_quantile(p)


@query(
    "EV8_quantile_score",
    with_ctes(
        *SPLIT20, pair_cte(["mean", "naive", "drift"]),
        f"q AS (SELECT *, mean + sd * ({_z(0.1)!r}::DOUBLE) AS q1, mean + sd * ({_z(0.9)!r}::DOUBLE) AS q9 FROM pairs)",
        select=f"""SELECT {K}, model, {r('avg(2 * CASE WHEN actual < q1 THEN 0.9 * (q1 - actual) ELSE 0.1 * (actual - q1) END)')} AS qs10,
    {r('avg(2 * CASE WHEN actual < q9 THEN 0.1 * (q9 - actual) ELSE 0.9 * (actual - q9) END)')} AS qs90 FROM q GROUP BY 1, 2""",
    ),
)
def ev8(t):
    s = splits.split_by_share(weekly(t), 0.2)
    p = battery.baseline_pairs(s, "y", models=("mean", "naive", "drift"))
    a, m, sd = F.col("actual"), F.col("mean"), F.col("sd")
    return p.groupBy(K, "model").agg(
        F.avg(evaluate.quantile_score(a, m, sd, 0.1)).alias("qs10"), F.avg(evaluate.quantile_score(a, m, sd, 0.9)).alias("qs90")
    )


@query(
    "EV9_winkler_score",
    with_ctes(
        *SPLIT20, pair_cte(["mean", "naive", "drift"]),
        "q AS (SELECT *, mean - 1.2815515655446004 * sd AS lo, mean + 1.2815515655446004 * sd AS hi FROM pairs)",
        select=f"SELECT {K}, model, {r('avg(hi - lo + CASE WHEN actual < lo THEN 10 * (lo - actual) WHEN actual > hi THEN 10 * (actual - hi) ELSE 0 END)')} AS winkler FROM q GROUP BY 1, 2",
    ),
)
def ev9(t):
    s = splits.split_by_share(weekly(t), 0.2)
    p = battery.baseline_pairs(s, "y", models=("mean", "naive", "drift"))
    return p.groupBy(K, "model").agg(F.avg(evaluate.winkler_score(F.col("actual"), F.col("mean"), F.col("sd"), 80)).alias("winkler"))


# Normal CDF by its odd power series, good for |z| below 6.
PHI = "(0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda i: exp((2 * i + 1) * ln(abs(z) + 1e-300) - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1))))))"
CRPS_CTES = [
    *SPLIT20, pair_cte(["mean", "naive", "drift"]),
    "zz AS (SELECT *, (actual - mean) / sd AS z FROM pairs)",
    f"cr AS (SELECT {K}, model, avg(sd * (z * (2 * {PHI} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps FROM zz GROUP BY 1, 2)",
]


def _crps(t):
    s = splits.split_by_share(weekly(t), 0.2)
    p = battery.baseline_pairs(s, "y", models=("mean", "naive", "drift"))
    return p.groupBy(K, "model").agg(F.avg(evaluate.crps(F.col("actual"), F.col("mean"), F.col("sd"))).alias("crps"))


@query("EV10_crps", with_ctes(*CRPS_CTES, select=f"SELECT {K}, model, {r('crps')} AS crps FROM cr"))
def ev10(t):
    """Distribution score of normal forecasts."""
    return _crps(t)


@query(
    "EV11_skill_score",
    with_ctes(*CRPS_CTES, select=f"SELECT a.{K}, a.model, {r('a.crps')} AS crps, {r('1 - a.crps / b.crps')} AS skill FROM cr a JOIN cr b ON a.{K} = b.{K} AND b.model = 'naive'"),
)
def ev11(t):
    return evaluate.skill(_crps(t), [K], "crps", "naive")


@query(
    "EV12_result_table",
    with_ctes(
        *SPLIT20, pair_cte(FOUR), *accuracy_ctes(f"{K}, model"),
        select=f"""SELECT {K}, model, {r('rmse')} AS rmse, CASE WHEN model IN ('drift', 'naive', 'snaive') THEN 'Baseline' ELSE 'Other' END AS family,
    CAST(CASE WHEN model IN ('drift', 'naive', 'snaive') THEN 4 END AS BIGINT) AS family_order FROM acc""",
    ),
)
def ev12(t):
    """Scores with families; a family outside the level list has no order."""
    s = splits.split_by_share(weekly(t), 0.2)
    acc = evaluate.accuracy(battery.baseline_pairs(s, "y", models=baseline.MODELS), [K, "model"])
    return battery.result_table(acc.select(K, "model", "rmse"))


@query(
    "EV13_residual_tests",
    with_ctes(
        OW,
        "ps AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS p)",
        "sw AS (SELECT * FROM ow, ps WHERE t <= CAST(floor((1 - p) * n) AS BIGINT))",
        f"rs AS (SELECT p, {K}, week, y - lag(y) OVER w AS naive, y - lag(y, 52) OVER w AS snaive FROM sw WINDOW w AS (PARTITION BY p, {K} ORDER BY week))",
        *acf_ctes("(SELECT * FROM rs WHERE naive IS NOT NULL)", f"p, {K}", "week", "naive", [1], "a1"),
        *acf_ctes("(SELECT * FROM rs WHERE snaive IS NOT NULL)", f"p, {K}", "week", "snaive", [1], "a2"),
        select=" UNION ALL ".join(
            f"SELECT p, {K}, '{m}' AS model, {r('n * (n + 2) * r1 * r1 / (n - 1)')} AS lb_stat FROM {a}" for m, a in (("naive", "a1"), ("drift", "a1"), ("snaive", "a2"))
        ),
    ),
)
def ev13(t):
    """White-noise test of the residuals of every split and model in one plan."""
    s = battery.prepared(weekly(t))
    fitted = baseline.fitted_baselines(splits.train(s), "y").where("model <> 'mean' AND resid IS NOT NULL")
    p = Panel(fitted, ("p", K, "model"), "week", "week")
    return features.portmanteau(p, "resid", 1).select("p", K, "model", "lb_stat")


def _chi1_tail(q: str) -> str:
    """P(X > q) with one degree of freedom; below the sixth digit from 30 on."""
    return f"CASE WHEN {q} > 30 THEN 0 ELSE 2 * (1 - {PHI.replace('z', f'sqrt({q})')}) END"


_PK = f"p, {K}"
_SEASON_MEAN = f"OVER (PARTITION BY {_PK}, season)"
_FREE = ", ".join(f"{c} - avg({c}) {_SEASON_MEAN} AS {n}" for c, n in [("yy", "y"), ("t", "x0"), *[(f, f"x{i + 1}") for i, f in enumerate(battery.FLAGS)]])
_RESIDUALS = {"naive": "a1", "drift": "a1", "snaive": "a2", "tslm_base": "a3", "tslm_vars": "a4"}


@query(
    "EV13_residual_tests_all",
    with_ctes(
        MODEL, MP_SEASON,
        "ps AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS p)",
        "sw AS (SELECT * FROM mps, ps WHERE t <= CAST(floor((1 - p) * n) AS BIGINT))",
        f"rs AS (SELECT {_PK}, week, yy - lag(yy) OVER w AS naive, yy - lag(yy, 52) OVER w AS snaive FROM sw WINDOW w AS (PARTITION BY {_PK} ORDER BY week))",
        f"z AS (SELECT {_PK}, week, {_FREE} FROM sw)",
        *projected("z", _PK, "y", ["x0"], "week", "gb"), *projected("z", _PK, "y", ["x0", "x1", "x2", "x3", "x4"], "week", "gv"),
        *acf_ctes("(SELECT * FROM rs WHERE naive IS NOT NULL)", _PK, "week", "naive", [1], "a1"),
        *acf_ctes("(SELECT * FROM rs WHERE snaive IS NOT NULL)", _PK, "week", "snaive", [1], "a2"),
        *acf_ctes("gb1", _PK, "week", "y", [1], "a3"), *acf_ctes("gv5", _PK, "week", "y", [1], "a4"),
        "q AS (" + " UNION ALL ".join(f"SELECT {_PK}, '{m}' AS model, n, n * (n + 2) * r1 * r1 / (n - 1) AS lb, n * r1 * r1 AS bp FROM {a}" for m, a in _RESIDUALS.items()) + ")",
        select=f"SELECT {_PK}, model, n, {r('lb')} AS lb_stat, {r('bp')} AS bp_stat, {r(_chi1_tail('lb'))} AS lb_pvalue, {r(_chi1_tail('bp'))} AS bp_pvalue FROM q",
    ),
)
def ev13b(t):
    """The same with tail probabilities, for regression and benchmark residuals."""
    s = battery.prepared(model_panel(t)).written("splits")
    key, train = list(s.key), splits.train(s)
    base = baseline.fitted_baselines(train, "y").where("model <> 'mean'").select(*key, "model", "week", "resid")
    named = {
        "tslm_base": reg.predict_seasonal(train.df, reg.fit_seasonal(train.df, key, "y", ["t"]), key, ["t"]),
        "tslm_vars": reg.predict_seasonal(
            train.df, reg.fit_seasonal(train.df, key, "y", ["t", *battery.FLAGS]), key, ["t", *battery.FLAGS]
        ),
    }
    fits = [
        df.select(*key, F.lit(m).alias("model"), "week", (F.col("y") - F.col("mean")).alias("resid")) for m, df in named.items()
    ]
    rows = shape.bind_rows(base, *fits).where("resid IS NOT NULL")
    return features.portmanteau(Panel(rows, (*key, "model"), "week", "week"), "resid", 1)


@query("EV13_residual_tests_battery")
def ev13c(t):
    """White-noise tests of the residuals of all twelve models, for every split and series."""
    s = battery.prepared(model_panel(t)).written("splits")
    rows = battery.all_residuals(s, "y")
    return features.portmanteau(Panel(rows, (*s.key, "model"), "week", "week"), "resid", 1)


_NAIVE_RES = f"nr AS (SELECT {K}, week, y - lag(y) OVER (PARTITION BY {K} ORDER BY week) AS resid FROM ow)"


@query("EV14_residual_series", with_ctes(OW, _NAIVE_RES, select=f"SELECT {K}, {d('week')} AS week, {r('resid')} AS resid FROM nr WHERE resid IS NOT NULL"))
def ev14(t):
    return _naive_residuals(t).df


def _naive_residuals(t) -> Panel:
    f = baseline.fitted_baselines(weekly(t), "y").where("model = 'naive' AND resid IS NOT NULL")
    return Panel(f.select(K, "week", "resid"), (K,), "week", "week")


L8 = list(range(1, 9))


@query("EV14_residual_acf", with_ctes(OW, _NAIVE_RES, *acf_ctes("(SELECT * FROM nr WHERE resid IS NOT NULL)", K, "week", "resid", L8), select=acf_long("ac", K, L8)))
def ev14b(t):
    return features.acf(_naive_residuals(t), "resid", 8)


@query(
    "EV14_residual_histogram",
    with_ctes(
        OW, _NAIVE_RES, f"l AS (SELECT {K}, min(resid) AS lo, max(resid) AS hi, count(*) AS n FROM nr WHERE resid IS NOT NULL GROUP BY 1)",
        f"b AS (SELECT {K}, CAST(least(floor((resid - lo) / ((hi - lo) / 15.0)) + 1, 15) AS BIGINT) AS bin, lo, (hi - lo) / 15.0 AS w, n FROM nr JOIN l USING ({K}) WHERE resid IS NOT NULL)",
        select=f"SELECT {K}, bin, {r('max(lo + (bin - 1) * w)')} AS left, count(*) AS count, {r('count(*) / max(n * w)')} AS density FROM b GROUP BY 1, 2",
    ),
)
def ev14c(t):
    return aggregate.histogram(_naive_residuals(t).df, [K], "resid", 15)


@query(
    "EV15_residual_by_regressor",
    with_ctes(
        MODEL, f"w AS (SELECT {K}, week, CAST(y AS DOUBLE) AS y, covid, ice_present AS ice FROM mp)", *cramer(K, "w", "y", ["covid", "ice"]),
        f"z AS (SELECT {K}, week, covid, ice, w.y - b0 - b1 * covid - b2 * ice AS resid FROM w JOIN ls USING ({K}))",
        select=f"SELECT {K}, {d('week')} AS week, 'covid' AS regressor, covid AS x, {r('resid')} AS resid FROM z UNION ALL SELECT {K}, {d('week')}, 'ice_present', ice, {r('resid')} FROM z",
    ),
)
def ev15(t):
    """Residuals against each regressor in long form."""
    p = model_panel(t)
    fit = reg.fit_ols(p.df, p.key, "y", ["covid", "ice_present"])
    df = reg.augment_ols(p.df, fit, p.key, "y", ["covid", "ice_present"])
    return shape.longer(df.select(K, "week", "resid", "covid", "ice_present"), [K, "week", "resid"], ["covid", "ice_present"], "regressor", "x")


@query(
    "EV16_fitted_vs_actual",
    with_ctes(OW, f"w AS (SELECT {K}, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM ow GROUP BY 1)",
              select=f"SELECT {K}, {d('week')} AS week, y, {r('a + b * t')} AS fitted, {r('y - a - b * t')} AS resid FROM ow JOIN w USING ({K})"),
)
def ev16(t):
    p = weekly(t).with_position("t")
    fit = reg.fit_ols(p.df, p.key, "y", ["t"])
    return reg.augment_ols(p.df, fit, p.key, "y", ["t"]).select(K, "week", "y", "fitted", "resid")


@query(
    "L2_best_model_per_share",
    with_ctes(
        OW, "ps AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3]::DOUBLE[]) AS p)",
        "sw AS (SELECT *, CAST(floor((1 - p) * n) AS BIGINT) AS k FROM ow, ps)",
        "tr AS (SELECT * FROM sw WHERE t <= k)", "te AS (SELECT *, t - k AS h FROM sw WHERE t > k)",
        *base_ctes("", "tr", f"p, {K}", "week", 52), pair_cte(FOUR, f"p, {K}"), *accuracy_ctes(f"p, {K}, model"),
        select=f"SELECT p, {K}, model, {r('rmse')} AS rmse FROM acc QUALIFY rank() OVER (PARTITION BY p, {K} ORDER BY round(rmse, 9)) = 1",
    ),
)
def l2(t):
    s = battery.prepared(weekly(t))
    acc = evaluate.accuracy(battery.baseline_pairs(s, "y", models=baseline.MODELS), ["p", K, "model"])
    acc = acc.withColumn("rmse", F.round("rmse", 9))
    return evaluate.best_models(acc, ["p", K]).select("p", K, "model", "rmse")


@query(
    "L3_two_best_models",
    with_ctes(*SPLIT20, pair_cte(FOUR), *accuracy_ctes(f"{K}, model"),
              select=f"SELECT {K}, model, {r('rmse')} AS rmse, row_number() OVER (PARTITION BY {K} ORDER BY round(rmse, 9), model) AS rank FROM acc QUALIFY rank <= 2"),
)
def l3(t):
    s = splits.split_by_share(weekly(t), 0.2)
    acc = evaluate.accuracy(battery.baseline_pairs(s, "y", models=baseline.MODELS), [K, "model"])
    acc = acc.select(K, "model", F.round("rmse", 9).alias("rmse"))
    return evaluate.top_models(acc, [K], 2)


@query(
    "flagship_best_model",
    with_ctes(
        OW, f"sm AS (SELECT * REPLACE (CAST({frame(f'PARTITION BY {K} ORDER BY week', 2, 2)} AS DOUBLE) AS y) FROM ow)",
        f"kept AS (SELECT {K}, week, y, row_number() OVER (PARTITION BY {K} ORDER BY week) AS t, count(*) OVER (PARTITION BY {K}) AS n FROM sm WHERE y IS NOT NULL)",
        *split_ctes(0.2, "kept"), *base_ctes("", "tr", K, "week", 52), pair_cte(FOUR), *accuracy_ctes(f"{K}, model"),
        select=f"SELECT {K}, model, {r('rmse')} AS rmse, {r('mae')} AS mae FROM acc QUALIFY rank() OVER (PARTITION BY {K} ORDER BY round(rmse, 9)) = 1",
    ),
)
def flagship(t):
    """Roll up, fill gaps, smooth, split, forecast with four models, score, keep the best."""
    p = windows.moving_mean(weekly(t), "y", 2, 2, "ma")
    p = p.on(p.df.where("ma IS NOT NULL").select(K, "week", F.col("ma").alias("y")))
    s = splits.split_by_share(p, 0.2)
    acc = evaluate.accuracy(battery.baseline_pairs(s, "y", models=baseline.MODELS), [K, "model"])
    best = evaluate.best_models(acc.withColumn("rmse", F.round("rmse", 9)), [K])
    return best.select(K, "model", "rmse", "mae")


@query(
    "flagship_many_series",
    with_ctes(
        PM, *split_ctes(0.2, "pm"), *base_ctes("", "tr", "l_partkey", "month", 12), pair_cte(["mean", "naive", "drift"], "l_partkey", 12),
        *accuracy_ctes("l_partkey, model"), select=f"SELECT l_partkey, model, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('acf1')} AS acf1 FROM acc",
    ),
)
def flagship_many(t):
    """The same evaluation for the monthly series of every part."""
    s = splits.split_by_share(parts_monthly(t), 0.2)
    acc = evaluate.accuracy(battery.baseline_pairs(s, "y", models=("mean", "naive", "drift")), ["l_partkey", "model"])
    return acc.select("l_partkey", "model", "rmse", "mae", "acf1")
