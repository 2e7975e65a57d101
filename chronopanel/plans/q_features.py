"""Autocorrelation, tests and features per series."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.operators import baseline, decompose, features, joins, stl
from chronopanel.operators.windows import difference
from chronopanel.panel import Panel
from chronopanel.plans.inputs import EH, LM, OD, OW, PM, daily, hourly, monthly, parts_monthly, weekly
from chronopanel.plans.q_windows import LMK, classical_sql
from chronopanel.plans.registry import d, query, r, with_ctes
from chronopanel.plans.stl_sql import stl_ctes
from chronopanel.session import written
from chronopanel.sources.noise import noise_ctes, white_noise


def acf_ctes(src: str, key: str, idx: str, x: str, lags: list[int], name: str = "ac") -> list[str]:
    """CTEs: one row per key with n and r<k>; ``src`` may hold NULLs of x."""
    lag_cols = ", ".join(f"lag(e, {k}) OVER (PARTITION BY {key} ORDER BY {idx}) AS l{k}" for k in lags)
    rs = ", ".join(f"sum(e * l{k}) / (count(e * l{k}) + {k}) / avg(e * e) AS r{k}" for k in lags)
    return [
        f"{name}_c AS (SELECT {key}, {idx}, {x} - avg({x}) OVER (PARTITION BY {key}) AS e FROM {src})",
        f"{name}_l AS (SELECT *, {lag_cols} FROM {name}_c)",
        f"{name} AS (SELECT {key}, count(e) AS n, {rs} FROM {name}_l GROUP BY {key})",
    ]


def acf_long(name: str, key: str, lags: list[int]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {k}::BIGINT AS lag, {r(f'r{k}')} AS acf FROM {name}" for k in lags)


L26, L10, L24 = list(range(1, 27)), list(range(1, 11)), list(range(1, 25))


@query("X1_acf", with_ctes(OW, *acf_ctes("ow", "o_orderpriority", "week", "y", L26), select=acf_long("ac", "o_orderpriority", L26)))
def x1(t):
    """Autocorrelations of every weekly series up to lag 26."""
    return features.acf(weekly(t), "y", 26)


@query("X1_acf_blocked", with_ctes(EH, *acf_ctes("eh", "event_type", "hour", "y", L24), select=acf_long("ac", "event_type", L24)))
def x1b(t):
    """The same on blocks of 100 hours: no task sees a whole series."""
    p = hourly(t)
    return features.acf(p.on(p.df, block=100), "y", 24)


@query(
    "X1_acf_of_difference",
    with_ctes(OW, "dd AS (SELECT o_orderpriority, week, y - lag(y) OVER (PARTITION BY o_orderpriority ORDER BY week) AS dy FROM ow)",
              *acf_ctes("dd", "o_orderpriority", "week", "dy", L10), select=acf_long("ac", "o_orderpriority", L10)),
)
def x1c(t):
    return features.acf(difference(weekly(t), "y", [1], "dy"), "dy", 10)


@query("X1_acf_many_series", with_ctes(
    "pmx AS (SELECT l_partkey, l_shipdate AS ts, l_orderkey, l_linenumber, l_quantity AS y FROM lineitem)",
    "pm2 AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY ts, l_orderkey, l_linenumber) AS t, y FROM pmx)",
    *acf_ctes("pm2", "l_partkey", "t", "y", [1, 2, 3]), select=acf_long("ac", "l_partkey", [1, 2, 3])))
def x1d(t):
    """Three lags for every part, its shipments in order."""
    from chronopanel.panel import numbered

    li = t("lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("y"))
    df = numbered(li, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "t")
    return features.acf(Panel(df.select("l_partkey", "t", "y"), ("l_partkey",), "t", block=1000, position="t"), "y", 3)


def _pacf_sql(kmax: int) -> tuple[list[str], str]:
    """Durbin-Levinson in SQL, one CTE per order."""
    ctes = ["p1 AS (SELECT *, r1 AS f1_1 FROM ac)"]
    for k in range(2, kmax + 1):
        num = f"r{k} - (" + " + ".join(f"f{k-1}_{j} * r{k-j}" for j in range(1, k)) + ")"
        den = "1 - (" + " + ".join(f"f{k-1}_{j} * r{j}" for j in range(1, k)) + ")"
        ctes.append(f"q{k} AS (SELECT *, ({num}) / ({den}) AS f{k}_{k} FROM p{k-1})")
        rest = ", ".join(f"f{k-1}_{j} - f{k}_{k} * f{k-1}_{k-j} AS f{k}_{j}" for j in range(1, k))
        ctes.append(f"p{k} AS (SELECT *, {rest} FROM q{k})")
    sel = " UNION ALL ".join(f"SELECT o_orderpriority, {k}::BIGINT AS lag, {r(f'f{k}_{k}')} AS pacf FROM p{kmax}" for k in range(1, kmax + 1))
    return ctes, sel


_P_CTES, _P_SEL = _pacf_sql(6)


@query("X2_pacf", with_ctes(OW, *acf_ctes("ow", "o_orderpriority", "week", "y", list(range(1, 7))), *_P_CTES, select=_P_SEL))
def x2(t):
    return features.pacf(weekly(t), "y", 6)


def _lb(lag: int) -> str:
    return "n * (n + 2) * (" + " + ".join(f"r{k} * r{k} / (n - {k})" for k in range(1, lag + 1)) + ")"


def _bp(lag: int) -> str:
    return "n * (" + " + ".join(f"r{k} * r{k}" for k in range(1, lag + 1)) + ")"


def _even_tail(q: str, dof: int) -> str:
    terms = " + ".join(f"pow({q} / 2, {j}) / {_fact(j)}" for j in range(dof // 2))
    return f"exp(-{q} / 2) * ({terms})"


def _fact(j: int) -> str:
    out = 1.0
    for i in range(2, j + 1):
        out *= i
    return f"{out!r}::DOUBLE"


@query(
    "X3_ljung_box",
    with_ctes(OW, *acf_ctes("ow", "o_orderpriority", "week", "y", L26), f"q AS (SELECT *, {_lb(26)} AS lb FROM ac)",
              select=f"SELECT o_orderpriority, {r('lb')} AS lb_stat, {r(_even_tail('lb', 26))} AS lb_pvalue FROM q"),
)
def x3(t):
    """White-noise test at lag 26."""
    return features.portmanteau(weekly(t), "y", 26).select("o_orderpriority", "lb_stat", "lb_pvalue")


@query(
    "X3_ljung_box_lag1",
    with_ctes(OW, *acf_ctes("ow", "o_orderpriority", "week", "y", [1]), select=f"SELECT o_orderpriority, n, {r(_lb(1))} AS lb_stat FROM ac"),
)
def x3b(t):
    """The default test: one lag."""
    return features.portmanteau(weekly(t), "y", 1).select("o_orderpriority", "n", "lb_stat")


@query(
    "X4_box_pierce",
    with_ctes(OW, *acf_ctes("ow", "o_orderpriority", "week", "y", L10), f"q AS (SELECT *, {_bp(10)} AS bp FROM ac)",
              select=f"SELECT o_orderpriority, {r('bp')} AS bp_stat, {r(_even_tail('bp', 10))} AS bp_pvalue FROM q"),
)
def x4(t):
    return features.portmanteau(weekly(t), "y", 10).select("o_orderpriority", "bp_stat", "bp_pvalue")


def kpss_ctes(src: str, key: str, idx: str, x: str, name: str = "kp") -> list[str]:
    by = f"PARTITION BY {key} ORDER BY {idx}"
    lags = range(1, 25)
    lag_cols = ", ".join(f"lag(e, {k}) OVER ({by}) AS l{k}" for k in lags)
    g = ", ".join(f"coalesce(sum(e * l{k}), 0) AS g{k}" for k in lags)
    lr = " + ".join(f"2 * greatest(1 - {k} / (b + 1), 0) * g{k}" for k in lags)
    p = """CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - (stat - 0.347) * 0.05 / 0.116
      WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) * 0.025 / 0.111 WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) * 0.015 / 0.165
      WHEN stat > 0.739 THEN 0.01 END"""
    return [
        f"{name}_c AS (SELECT {key}, {idx}, {x} - avg({x}) OVER (PARTITION BY {key}) AS e FROM {src} WHERE {x} IS NOT NULL)",
        f"{name}_l AS (SELECT *, sum(e) OVER ({by}) AS cu, {lag_cols} FROM {name}_c)",
        f"{name}_s AS (SELECT {key}, count(*) AS n, sum(cu * cu) AS s2, sum(e * e) AS g0, floor(4 * pow(count(*) / 100, 0.25)) AS b, {g} FROM {name}_l GROUP BY {key})",
        f"{name}_t AS (SELECT {key}, n, CASE WHEN g0 > 1e-12 THEN s2 / (n * (g0 + {lr})) END AS stat FROM {name}_s)",
        f"{name} AS (SELECT {key}, n, stat, {p} AS pv FROM {name}_t)",
    ]


@query("X5_kpss", with_ctes(LM, *kpss_ctes("lm", LMK, "month", "y"), select=f"SELECT {LMK}, n, {r('stat')} AS kpss_stat, {r('pv')} AS kpss_pvalue FROM kp"))
def x5(t):
    return features.kpss(monthly(t), "y")


@query(
    "X6_ndiffs",
    with_ctes(LM, f"dl AS (SELECT {LMK}, month, y - lag(y) OVER (PARTITION BY {LMK} ORDER BY month) AS dy FROM lm)",
              *kpss_ctes("lm", LMK, "month", "y", "k0"), *kpss_ctes("dl", LMK, "month", "dy", "k1"),
              select=f"""SELECT {LMK}, CAST(CASE WHEN k0.pv >= 0.05 THEN 0 WHEN k1.pv >= 0.05 THEN 1 ELSE 2 END AS BIGINT) AS ndiffs
    FROM k0 JOIN k1 USING ({LMK})"""),
)
def x6(t):
    return features.ndiffs(monthly(t).written("monthly"), "y")


@query(
    "X7_nsdiffs_stl",
    with_ctes(
        LM, *stl_ctes("lm", LMK, "month", 12),
        f"ss AS (SELECT {LMK}, greatest(0, least(1, 1 - var_samp(remainder) / var_samp(remainder + seasonal))) AS strength FROM st_parts GROUP BY {LMK})",
        select=f"SELECT {LMK}, {r('strength')} AS seasonal_strength, CAST(CASE WHEN strength > 0.64 THEN 1 ELSE 0 END AS BIGINT) AS nsdiffs FROM ss",
    ),
)
def x7s(t):
    """Seasonal differences that the strength of the STL season asks for."""
    p = monthly(t)
    s = features.seasonal_strength(stl.stl(p, "y"), "seasonal", "remainder")
    return s.join(features.nsdiffs(s, p.key), list(p.key)).select(*p.key, "seasonal_strength", "nsdiffs")


@query(
    "X7_nsdiffs",
    with_ctes(*classical_sql(LM, LMK, "month", 12, "additive", "lm"),
              select=f"""SELECT {LMK}, CAST(CASE WHEN 1 - var_samp(random) / var_samp(random + seasonal) > 0.64 THEN 1 ELSE 0 END AS BIGINT) AS nsdiffs
    FROM parts WHERE random IS NOT NULL GROUP BY {LMK}"""),
)
def x7(t):
    """Seasonal differences from the strength of the classical seasonal part."""
    p = monthly(t)
    s = features.seasonal_strength(decompose.classical(p, "y"), "seasonal", "random")
    return features.nsdiffs(s, p.key)


_SQ = " + ".join(f"r{k} * r{k}" for k in L10)


@query(
    "X8_feat_acf",
    with_ctes(
        LM,
        f"d1 AS (SELECT {LMK}, month, y - lag(y) OVER (PARTITION BY {LMK} ORDER BY month) AS y FROM lm)",
        f"d2 AS (SELECT {LMK}, month, y - lag(y) OVER (PARTITION BY {LMK} ORDER BY month) AS y FROM d1)",
        *acf_ctes("lm", LMK, "month", "y", L10 + [12], "a0"),
        *acf_ctes("(SELECT * FROM d1 WHERE y IS NOT NULL)", LMK, "month", "y", L10, "a1"),
        *acf_ctes("(SELECT * FROM d2 WHERE y IS NOT NULL)", LMK, "month", "y", L10, "a2"),
        f"b0 AS (SELECT {LMK}, r1 AS v1, {_SQ} AS v2, r12 AS v3 FROM a0)",
        f"b1 AS (SELECT {LMK}, r1 AS v4, {_SQ} AS v5 FROM a1)",
        f"b2 AS (SELECT {LMK}, r1 AS v6, {_SQ} AS v7 FROM a2)",
        select=f"""SELECT {LMK}, {r('v1')} AS acf1, {r('v2')} AS acf10, {r('v3')} AS season_acf1, {r('v4')} AS diff1_acf1, {r('v5')} AS diff1_acf10,
    {r('v6')} AS diff2_acf1, {r('v7')} AS diff2_acf10 FROM b0 JOIN b1 USING ({LMK}) JOIN b2 USING ({LMK})""",
    ),
)
def x8(t):
    return features.feat_acf(monthly(t).written("monthly"), "y")


@query(
    "X9_sum_of_squared_acf",
    with_ctes(OW, *acf_ctes("ow", "o_orderpriority", "week", "y", L10), select=f"SELECT o_orderpriority, {r(_SQ)} AS acf10 FROM ac"),
)
def x9(t):
    a = features.acf(weekly(t), "y", 10)
    return a.groupBy("o_orderpriority").agg(F.sum(F.col("acf") * F.col("acf")).alias("acf10"))


@query(
    "X10_feat_stl",
    with_ctes(
        LM, *stl_ctes("lm", LMK, "month", 12),
        *acf_ctes("st_parts", LMK, "month", "remainder", L10),
        f"su AS (SELECT *, t - (count(*) OVER g + 1) / 2.0 AS c, CAST(count(*) OVER g AS DOUBLE) AS m, avg(remainder) OVER g AS mu, var_samp(remainder) OVER g AS va, (t - 1) % 12 AS s FROM st_parts WINDOW g AS (PARTITION BY {LMK}))",
        "sv AS (SELECT *, c * c - (m * m - 1) / 12 AS b, (va * (m - 1) - (remainder - mu) * (remainder - mu) * m / (m - 1)) / (m - 2) AS loo FROM su)",
        f"sh AS (SELECT {LMK}, greatest(0, least(1, 1 - var_samp(remainder) / var_samp(remainder + trend))) AS trend_strength, greatest(0, least(1, 1 - var_samp(remainder) / var_samp(remainder + seasonal))) AS seasonal_strength, "
        f"var_samp(loo) AS spikiness, sum(trend * c) / sqrt(sum(c * c)) AS linearity, sum(trend * b) / sqrt(sum(b * b)) AS curvature FROM sv GROUP BY {LMK})",
        f"sf AS (SELECT {LMK}, s, avg(seasonal) AS f FROM sv GROUP BY {LMK}, s)",
        f"tu AS (SELECT {LMK}, (arg_max(s, f) + 1) % 12 AS seasonal_peak, (arg_min(s, f) + 1) % 12 AS seasonal_trough FROM sf GROUP BY {LMK})",
        select=f"SELECT {LMK}, " + ", ".join(f"{r(c, 0 if c == 'spikiness' else 6)} AS {c}" for c in ("trend_strength", "seasonal_strength", "spikiness", "linearity", "curvature"))
        + f", seasonal_peak, seasonal_trough, {r('r1')} AS rest_acf1, {r(_SQ)} AS rest_acf10 FROM sh JOIN tu USING ({LMK}) JOIN ac USING ({LMK})",
    ),
)
def x10(t):
    """Features of the STL components of every monthly series; spikiness, a variance of variances, in whole numbers."""
    p = stl.stl(monthly(t), "y").written("stl")
    out = features.strengths(p, "trend", "seasonal", "remainder")
    return out.withColumn("spikiness", F.round("spikiness"))


@query(
    "X10_feat_classical",
    with_ctes(
        *classical_sql(LM, LMK, "month", 12, "additive", "lm"),
        f"v AS (SELECT *, row_number() OVER (PARTITION BY {LMK} ORDER BY month) AS i, count(*) OVER (PARTITION BY {LMK}) AS m FROM parts WHERE random IS NOT NULL)",
        "u AS (SELECT *, i - (m + 1) / 2.0 AS c FROM v)",
        "w AS (SELECT *, c * c - (CAST(m AS DOUBLE) * m - 1) / 12 AS b FROM u)",
        select=f"""SELECT {LMK}, {r('greatest(0, least(1, 1 - var_samp(random) / var_samp(random + trend)))', 4)} AS trend_strength,
    {r('greatest(0, least(1, 1 - var_samp(random) / var_samp(random + seasonal)))', 4)} AS seasonal_strength,
    {r('sum(trend * c) / sqrt(sum(c * c))', 4)} AS linearity, {r('sum(trend * b) / sqrt(sum(b * b))', 4)} AS curvature FROM w GROUP BY {LMK}""",
    ),
    digits=4,
)
def x10b(t):
    """Strength and trend shape from the classical components (no Python worker)."""
    s = features.strengths(decompose.classical(monthly(t), "y"), "trend", "seasonal", "random")
    s = s.select("l_returnflag", "l_linestatus", "trend_strength", "seasonal_strength", "linearity", "curvature")
    return s


@query(
    "X11_most_seasonal",
    with_ctes(
        *classical_sql(LM, LMK, "month", 12, "additive", "lm"),
        f"s AS (SELECT {LMK}, 1 - var_samp(random) / var_samp(random + seasonal) AS strength FROM parts WHERE random IS NOT NULL GROUP BY {LMK})",
        f"top AS (SELECT {LMK} FROM s WHERE strength = (SELECT max(strength) FROM s))",
        select=f"SELECT {LMK}, {d('month')} AS month, {r('y')} AS y FROM top JOIN lm USING ({LMK})",
    ),
)
def x11(t):
    """The most seasonal series, drilled back to its observations."""
    p = monthly(t).written("monthly")
    s = features.seasonal_strength(decompose.classical(p, "y"), "seasonal", "random")
    top = s.where(F.col("seasonal_strength") == s.agg(F.max("seasonal_strength")).scalar()).select(*p.key)
    return joins.drill_back(top, p.df, p.key)


@query("X12_feature_set")
def x12(t):
    """All features of every monthly series in one wide table."""
    p = monthly(t).written("monthly")
    return features.feature_table(p, "y", decompose.classical(p, "y").written("classical"))


@query(
    "X12_shape_features",
    with_ctes(
        OD,
        "z AS (SELECT *, (y - avg(y) OVER k) / stddev_samp(y) OVER k AS z, y > median(y) OVER k AS up, least(floor((y - min(y) OVER k) * 10.0 / (max(y) OVER k - min(y) OVER k)), 9) AS band "
        "FROM od WINDOW k AS (PARTITION BY o_orderstatus))",
        "tl AS (SELECT o_orderstatus, (t - 1) // 10 AS tile, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY 1, 2)",
        "tt AS (SELECT o_orderstatus, var_samp(m) AS vm, var_samp(v) AS vv FROM tl GROUP BY 1)",
        "c AS (SELECT *, CASE WHEN up <> lag(up) OVER w THEN 1 ELSE 0 END AS x, CASE WHEN band = lag(band) OVER w THEN 0 ELSE 1 END AS nw FROM z WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day))",
        "rn AS (SELECT *, sum(nw) OVER (PARTITION BY o_orderstatus ORDER BY day) AS run FROM c)",
        "rl AS (SELECT o_orderstatus, run, count(*) AS len, sum(x) AS x FROM rn GROUP BY 1, 2)",
        "rr AS (SELECT o_orderstatus, CAST(sum(x) AS BIGINT) AS cr, max(len) AS fl FROM rl GROUP BY 1)",
        select=f"SELECT o_orderstatus, {r('vm')} AS var_tiled_mean, {r('vv')} AS var_tiled_var, cr AS n_crossing_points, fl AS longest_flat_spot FROM tt JOIN rr USING (o_orderstatus)",
    ),
)
def x12b(t):
    """Tiles, crossings and flat spots of the daily series."""
    p = daily(t).written("daily")
    return features.tiled(p, "y", 10).join(features.crossings(p, "y"), "o_orderstatus")


def _entropy_sql(lags: int, points: int) -> str:
    cosines = " + ".join(f"{1 - k / (lags + 1)!r} * coalesce(r{k}, 0) * cos(j * {k} * pi() / {points})" for k in range(1, lags + 1))
    return f"greatest(1 + 2 * ({cosines}), 0)"


@query(
    "X12_spectral_entropy",
    with_ctes(
        OW, *acf_ctes("ow", "o_orderpriority", "week", "y", list(range(1, 13))),
        f"sp AS (SELECT o_orderpriority, {_entropy_sql(12, 32)} AS s FROM ac, range(0, 33) g(j))",
        "pr AS (SELECT o_orderpriority, s / sum(s) OVER (PARTITION BY o_orderpriority) AS p FROM sp)",
        select=f"SELECT o_orderpriority, {r('-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(33)')} AS spectral_entropy FROM pr GROUP BY 1",
    ),
)
def x12d(t):
    """Entropy of the spectral density of every weekly series."""
    return features.spectral_entropy(weekly(t), "y")


@query(
    "X12_hurst",
    with_ctes(
        OD,
        "sc AS (SELECT o_orderstatus, t, CAST(y AS DOUBLE) AS y, n, unnest(range(3, CAST(floor(log2(n)) AS BIGINT) + 1)) AS e FROM od)",
        "ti AS (SELECT o_orderstatus, t, y, 1 << e AS size, (t - 1) // (1 << e) AS tile FROM sc WHERE ((t - 1) // (1 << e) + 1) * (1 << e) <= n)",
        "ce AS (SELECT *, y - avg(y) OVER (PARTITION BY o_orderstatus, size, tile) AS c FROM ti)",
        "cu AS (SELECT *, sum(c) OVER (PARTITION BY o_orderstatus, size, tile ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM ce)",
        "rs AS (SELECT o_orderstatus, size, tile, (max(s) - min(s)) / CASE WHEN max(y) > min(y) THEN stddev_pop(y) END AS rs FROM cu GROUP BY 1, 2, 3)",
        "sl AS (SELECT o_orderstatus, size, avg(rs) AS rs FROM rs GROUP BY 1, 2)",
        select=f"SELECT o_orderstatus, {r('regr_slope(ln(rs), ln(size))')} AS coef_hurst FROM sl GROUP BY 1",
    ),
)
def x12e(t):
    """Hurst exponent of every daily series."""
    return features.hurst(daily(t), "y")


@query(
    "X12_kl_shift",
    with_ctes(
        LM,
        f"st AS (SELECT {LMK}, min(y) AS lo, max(y) AS hi, stddev_samp(y) AS sd, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, count(*) AS n FROM (SELECT {LMK}, CAST(y AS DOUBLE) AS y FROM lm) GROUP BY {LMK})",
        f"bw AS (SELECT {LMK}, lo, (hi - lo) / 49 AS step, 0.9 * coalesce(nullif(least(sd, iqr / 1.34), 0), nullif(sd, 0), 1) * pow(n, -0.2) AS h FROM st)",
        f"de AS (SELECT {LMK}, t, g, step, greatest(exp(-pow((lo + g * step - y) / h, 2) / 2) / (h * sqrt(2 * pi())), exp(-722.0::DOUBLE) / sqrt(2 * pi())) AS dn FROM lm JOIN bw USING ({LMK}), range(0, 50) r(g))",
        f"wi AS (SELECT {LMK}, t, g, step, CASE WHEN count(*) OVER l = 12 THEN avg(dn) OVER l END AS a, CASE WHEN count(*) OVER f = 12 THEN avg(dn) OVER f END AS b FROM de "
        f"WINDOW l AS (PARTITION BY {LMK}, g ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), f AS (PARTITION BY {LMK}, g ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))",
        f"kl AS (SELECT {LMK}, t, sum(a * (ln(a) - ln(b)) * step) AS kl FROM wi GROUP BY {LMK}, t)",
        select=f"SELECT {LMK}, {r('max(kl)')} AS shift_kl_max, arg_max(t, kl) AS shift_kl_index FROM kl GROUP BY {LMK}",
    ),
)
def x12f(t):
    """Largest change of distribution between two neighbouring years of every monthly series."""
    return features.kl_shift(monthly(t), "y")


@query(
    "X12_level_shifts",
    with_ctes(
        LM,
        f"wi AS (SELECT {LMK}, t, CASE WHEN count(y) OVER l = 12 AND count(y) OVER f = 12 THEN abs(avg(y) OVER f - avg(y) OVER l) END AS m, "
        f"CASE WHEN count(y) OVER l = 12 AND count(y) OVER f = 12 THEN abs(var_samp(y) OVER f - var_samp(y) OVER l) END AS v FROM lm "
        f"WINDOW l AS (PARTITION BY {LMK} ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), f AS (PARTITION BY {LMK} ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))",
        select=f"SELECT {LMK}, {r('max(m)', 4)} AS shift_level_max, arg_max(t, m) AS shift_level_index, {r('max(v)', 4)} AS shift_var_max, arg_max(t, v) AS shift_var_index FROM wi GROUP BY {LMK}",
    ),
    digits=4,
)
def x12g(t):
    """Largest change of mean and of variance between two neighbouring years, and where."""
    return features.level_shifts(monthly(t), "y")


_PP_VALUE = """CASE WHEN stat <= c1 THEN 0.01 WHEN stat <= c5 THEN 0.01 + (stat - c1) * 0.04 / (c5 - c1) WHEN stat <= c10 THEN 0.05 + (stat - c5) * 0.05 / (c10 - c5) ELSE 0.1 END"""


@query(
    "X12_phillips_perron",
    with_ctes(
        LM,
        f"ll AS (SELECT {LMK}, t, CAST(y AS DOUBLE) AS y, CAST(lag(y) OVER (PARTITION BY {LMK} ORDER BY t) AS DOUBLE) AS x FROM lm)",
        f"ft AS (SELECT {LMK}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, var_pop(y) AS vy, count(*) AS n FROM ll WHERE x IS NOT NULL GROUP BY {LMK})",
        f"re AS (SELECT {LMK}, t, y - a - b * x AS u, n, CAST(floor(4 * pow(n / 100.0, 0.25)) AS BIGINT) AS w FROM ll JOIN ft USING ({LMK}) WHERE x IS NOT NULL)",
        f"co AS (SELECT i.l_returnflag, i.l_linestatus, sum((1 - (i.t - j.t) / (i.w + 1.0)) * i.u * j.u) AS s FROM re AS i JOIN re AS j ON i.l_returnflag = j.l_returnflag AND i.l_linestatus = j.l_linestatus AND j.t < i.t AND j.t >= i.t - i.w GROUP BY 1, 2)",
        f"va AS (SELECT {LMK}, avg(u * u) AS s FROM re GROUP BY {LMK})",
        f"st AS (SELECT {LMK}, n, va.s AS s, va.s + 2 * co.s / n AS g, b, sxx, vy FROM ft JOIN va USING ({LMK}) JOIN co USING ({LMK}))",
        f"pp AS (SELECT {LMK}, n, sqrt(s / g) * (b - 1) / sqrt(s * n / (n - 2) / sxx) - (g - s) / 2 / (sqrt(g) * sqrt(vy / n)) AS stat, "
        "-3.4335 - 5.999 / n - 29.25 / (n * n) AS c1, -2.8621 - 2.738 / n - 8.36 / (n * n) AS c5, -2.5671 - 1.438 / n - 4.48 / (n * n) AS c10 FROM st)",
        select=f"SELECT {LMK}, {r('stat')} AS pp_stat, {r(_PP_VALUE)} AS pp_pvalue FROM pp",
    ),
)
def x12h(t):
    """Unit-root test with a long-run variance, for every monthly series."""
    return features.phillips_perron(monthly(t), "y")


def pacf_ctes(kmax: int, src: str, tag: str) -> list[str]:
    """Durbin-Levinson in SQL: the last CTE, <tag>p<kmax>, has the partial autocorrelations as f<k>_<k>."""
    ctes = [f"{tag}p1 AS (SELECT *, r1 AS f1_1 FROM {src})"]
    for k in range(2, kmax + 1):
        num = f"r{k} - (" + " + ".join(f"f{k-1}_{j} * r{k-j}" for j in range(1, k)) + ")"
        den = "1 - (" + " + ".join(f"f{k-1}_{j} * r{j}" for j in range(1, k)) + ")"
        ctes.append(f"{tag}q{k} AS (SELECT *, ({num}) / ({den}) AS f{k}_{k} FROM {tag}p{k-1})")
        rest = ", ".join(f"f{k-1}_{j} - f{k}_{k} * f{k-1}_{k-j} AS f{k}_{j}" for j in range(1, k))
        ctes.append(f"{tag}p{k} AS (SELECT *, {rest} FROM {tag}q{k})")
    return ctes


_FIVE = " + ".join(f"pow(f{k}_{k}, 2)" for k in range(1, 6))
_LM_T = f"OVER (PARTITION BY {LMK} ORDER BY t)"


@query(
    "X12_pacf_features",
    with_ctes(
        LM,
        f"e1 AS (SELECT {LMK}, t, y - lag(y) {_LM_T} AS y FROM lm)", f"e2 AS (SELECT {LMK}, t, y - lag(y) {_LM_T} AS y FROM e1)",
        *acf_ctes("lm", LMK, "t", "y", list(range(1, 13)), "a0"), *acf_ctes("e1", LMK, "t", "y", list(range(1, 6)), "a1"), *acf_ctes("e2", LMK, "t", "y", list(range(1, 6)), "a2"),
        *pacf_ctes(12, "a0", "u"), *pacf_ctes(5, "a1", "v"), *pacf_ctes(5, "a2", "w"),
        f"s0 AS (SELECT {LMK}, {r(_FIVE)} AS pacf5, {r('f12_12')} AS season_pacf FROM up12)", f"s1 AS (SELECT {LMK}, {r(_FIVE)} AS diff1_pacf5 FROM vp5)", f"s2 AS (SELECT {LMK}, {r(_FIVE)} AS diff2_pacf5 FROM wp5)",
        select=f"SELECT * FROM s0 JOIN s1 USING ({LMK}) JOIN s2 USING ({LMK})",
    ),
)
def x12i(t):
    """The four features of partial autocorrelations of every monthly series."""
    return features.feat_pacf(monthly(t), "y")


@query(
    "X12_intermittency",
    with_ctes(
        PM,
        "s AS (SELECT *, CASE WHEN y = 0 AND coalesce(lag(y) OVER (PARTITION BY l_partkey ORDER BY month), 1) <> 0 THEN 1 ELSE 0 END AS st FROM pm)",
        select=f"""SELECT l_partkey, {r('coalesce(count(*) FILTER (y = 0) / nullif(sum(st), 0), 0)')} AS zero_run_mean,
    {r('pow(stddev_samp(y) FILTER (y <> 0) / avg(y) FILTER (y <> 0), 2)')} AS nonzero_squared_cv,
    {r('coalesce(min(t) FILTER (y <> 0) - 1, count(*)) / count(*)')} AS zero_start_prop,
    {r('coalesce(count(*) - max(t) FILTER (y <> 0), count(*)) / count(*)')} AS zero_end_prop FROM s GROUP BY 1""",
    ),
)
def x12c(t):
    """Zero runs of every part's monthly series."""
    return features.intermittency(parts_monthly(t), "y")


@query(
    "X13_label_turns",
    with_ctes(
        LM, f"q AS (SELECT {LMK}, quarter(month) AS q, avg(y) AS m FROM lm GROUP BY 1, 2, 3)",
        select=f"""SELECT {LMK}, 'Q' || arg_max(q, m) AS peak, 'Q' || arg_min(q, m) AS trough FROM q GROUP BY {LMK}""",
    ),
)
def x13(t):
    """Peak and trough quarter as labels; position 0 stands for the last quarter."""
    q = monthly(t).df.groupBy("l_returnflag", "l_linestatus", F.pmod(F.quarter("month"), F.lit(4)).alias("q")).agg(F.avg("y").alias("m"))
    turns = q.groupBy("l_returnflag", "l_linestatus").agg(F.max_by("q", "m").alias("peak"), F.min_by("q", "m").alias("trough"))
    return features.label_turns(turns, ["peak", "trough"], 4)


@query(
    "X14_guerrero",
    with_ctes(
        LM,
        f"b AS (SELECT {LMK}, (n - t) // 12 AS blk, avg(y) AS mu, stddev_samp(y) AS sd FROM lm WHERE (n - t) // 12 < n // 12 GROUP BY 1, 2, 3)",
        f"c AS (SELECT {LMK}, -0.9 + CAST(i AS DOUBLE) * 0.01 AS lam, stddev_samp(sd / pow(mu, 1 - (-0.9 + CAST(i AS DOUBLE) * 0.01))) / avg(sd / pow(mu, 1 - (-0.9 + CAST(i AS DOUBLE) * 0.01))) AS cv FROM b, range(0, 291) g(i) GROUP BY {LMK}, i)",
        select=f"SELECT {LMK}, {r('arg_min(lam, cv)', 2)} AS lambda_guerrero FROM c GROUP BY {LMK}",
    ),
    digits=2,
)
def x14(t):
    return features.guerrero(monthly(t), "y")


_PC = ["zero_run_mean", "nonzero_squared_cv", "zero_start_prop", "zero_end_prop", "mean", "sd", "top"]


def _leading(matrix: str, name: str) -> list[str]:
    """CTEs <name>: value and vector of a symmetric matrix's largest eigenvalue by power iteration, its largest loading positive."""
    start = "[" + ", ".join(f"{1 + k / 7!r}" for k in range(len(_PC))) + "]"
    by = "list_transform(m, lambda row: list_dot_product(row, {0}))"
    return [
        f"{name}_i AS (SELECT 0 AS k, CAST({start} AS DOUBLE[]) AS v UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, {by.format('v')} AS w FROM {name}_i, {matrix} WHERE k < 1500))",
        f"{name}_v AS (SELECT v, list_max(v) AS hi, list_min(v) AS lo FROM {name}_i WHERE k = 1500)",
        f"{name}_s AS (SELECT CASE WHEN hi >= -lo THEN v ELSE list_transform(v, lambda x: -x) END AS v FROM {name}_v)",
        f"{name} AS (SELECT v, list_dot_product(v, {by.format('v')}) AS value FROM {name}_s, {matrix})",
    ]


_PC_CTES = [
    PM,
    "ft_s AS (SELECT *, CASE WHEN y = 0 AND coalesce(lag(y) OVER (PARTITION BY l_partkey ORDER BY month), 1) <> 0 THEN 1 ELSE 0 END AS st FROM pm)",
    """ft AS (SELECT l_partkey, coalesce(count(*) FILTER (y = 0) / nullif(sum(st), 0), 0) AS zero_run_mean, pow(stddev_samp(y) FILTER (y <> 0) / avg(y) FILTER (y <> 0), 2) AS nonzero_squared_cv,
  coalesce(min(t) FILTER (y <> 0) - 1, count(*)) / count(*) AS zero_start_prop, coalesce(count(*) - max(t) FILTER (y <> 0), count(*)) / count(*) AS zero_end_prop,
  avg(y) AS mean, stddev_samp(y) AS sd, max(y) AS top FROM ft_s GROUP BY 1)""",
    "ok AS (SELECT * FROM ft WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _PC) + ")",
    # A column without spread has no correlations: it is left out as a row and column of zeros.
    "cm AS (SELECT [" + ", ".join("[" + ", ".join(f"coalesce(CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN corr({a}, {b}) END, 0)" for b in _PC) + "]" for a in _PC) + "] AS m FROM ok)",
    *_leading("cm", "e1"),
    "dm AS (SELECT list_transform(m, lambda row, i: list_transform(row, lambda x, j: x - value * v[i] * v[j])) AS m FROM cm, e1)",
    *_leading("dm", "e2"),
    f"zs AS (SELECT *, [{', '.join(f'coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)' for c in _PC)}] AS z FROM ok)",
    "sc AS (SELECT zs.*, list_dot_product(z, e1.v) AS pc1, list_dot_product(z, e2.v) AS pc2 FROM zs, e1, e2)",
]


def _part_scores(t):
    p = parts_monthly(t)
    f = features.intermittency(p, "y").join(
        p.df.groupBy("l_partkey").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.max("y").alias("top")), "l_partkey"
    )
    # Spread, correlations and scores each read the features: stored once.
    return p, features.principal_scores(written(f, "features"), _PC)


@query("A23_principal_scores", with_ctes(*_PC_CTES, select="SELECT l_partkey, " + ", ".join(f"{r(c, 5)} AS {c}" for c in [*_PC, "pc1", "pc2"]) + " FROM sc").replace("WITH", "WITH RECURSIVE", 1), digits=5)
def a23(t):
    """Two principal components of the standardised features of all parts."""
    return _part_scores(t)[1]


@query("A24_outliers_in_pc_space", with_ctes(*_PC_CTES, select=f"SELECT l_partkey, {r('pc1', 5)} AS pc1, {r('pc2', 5)} AS pc2, {d('month')} AS month, {r('y', 5)} AS y FROM sc JOIN pm USING (l_partkey) WHERE abs(pc1) > 4").replace("WITH", "WITH RECURSIVE", 1), digits=5)
def a24(t):
    """Series far out on the first component, with their observations."""
    p, pcs = _part_scores(t)
    far = pcs.where(F.abs("pc1") > 4).select("l_partkey", "pc1", "pc2")
    return joins.drill_back(far, p.df, ["l_partkey"])


@query("A23_principal_features")
def a23b(t):
    """Two components of the whole feature table of every monthly series."""
    p = monthly(t).written("monthly")
    table = written(features.feature_table(p, "y", decompose.classical(p, "y").written("classical")), "features")
    return features.principal_scores(table, [c for c, kind in table.dtypes if c not in p.key and kind in ("double", "bigint", "int")])


@query("S10_white_noise_acf", with_ctes(OW, *noise_ctes("ow", 30, ["o_orderpriority"], "week"), *acf_ctes("noise", "o_orderpriority", "week", "wn", L10), select=acf_long("ac", "o_orderpriority", L10)))
def white(t):
    """Autocorrelations of a generated white-noise panel."""
    return features.acf(white_noise(weekly(t), "wn", 30), "wn", 10)
