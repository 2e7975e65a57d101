"""Windows, decompositions, features, models and splits against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions.tails import chi2_tail, normal_cdf, normal_quantile
from chronopanel.operators import (
    aggregate, arima, baseline, decompose, evaluate, features, neural, quantiles, regression as reg,
    shape, splits, stl, windows,
)
from chronopanel.panel import Panel


def panel_of(spark, series, grain="step", block=None):
    rows = [(k, i + 1, None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return Panel(spark.createDataFrame(rows, "k string, i long, y double"), ("k",), "i", grain, block)


def column(df, name, key="a"):
    return [r[name] for r in df.where(F.col("k") == key).orderBy("i").collect()]


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(3)
    return {k: np.round(rng.normal(50, 10, n), 3) for k, n in (("a", 130), ("b", 97))}


def test_complete_mean_is_null_at_edges_and_around_null(spark):
    p = panel_of(spark, {"a": [1, 2, 3, None, 5, 6, 7, 8]})
    out = column(windows.moving_mean(p, "y", 1, 1, "m").df, "m")
    assert out == [None, 2.0, None, None, None, 6.0, 7.0, None]


def test_even_order_is_the_mean_of_two_means(spark):
    p = panel_of(spark, {"a": range(10)})
    out = column(windows.centred_ma(p, "y", 4, "m").df, "m")
    assert out == [None, None, *[float(x) for x in range(2, 8)], None, None]


def gapped(spark, series, block, seed=4):
    """The same values on an index with holes of any size, some of them missing."""
    rng, rows = np.random.default_rng(seed), []
    for k, vs in series.items():
        at = np.cumsum(rng.choice([1, 1, 1, 2, 9, 40], len(vs)))
        rows += [(k, int(i), None if rng.random() < 0.05 else float(v)) for i, v in zip(at, vs)]
    return Panel(spark.createDataFrame(rows, "k string, i long, y double"), ("k",), "i", "step", block)


@pytest.mark.parametrize("make", [panel_of, gapped])
def test_blocks_give_the_same_frames(spark, noise, make):
    """Blocked equals unblocked for every operator that takes blocks, on regular and on gapped indices."""

    def only(p, name):
        return p.on(p.df.withColumnRenamed(name, "v"))

    for fn in (
        lambda p: windows.moving_mean(p, "y", 12, 13, "v"),
        lambda p: windows.difference(p, "y", [12, 1], "v"),
        lambda p: windows.cumulative(p, "y", "v"),
        lambda p: windows.daily_from_cumulative(p, "y", "v"),
        lambda p: windows.with_row_number(p, "v"),
        lambda p: windows.centred_ma(p, "y", 12, "v"),
        lambda p: only(decompose.classical(p, "y", "additive", 6), "random"),
        lambda p: only(decompose.classical(p, "y", "multiplicative", 4), "seasonal"),
        lambda p: only(decompose.denoise(p, "y", "additive", 5), "denoised"),
        lambda p: p.on(windows.subseries(p, "y", F.col("i") % 5).withColumnRenamed("season_mean", "v")),
        lambda p: only(splits.split_by_share(p, 0.3), "h"),
    ):
        tables = [fn(make(spark, noise, block=n)).df for n in (None, 10)]
        assert tables[0].columns == tables[1].columns
        a, b = (t.orderBy("k", "i").collect() for t in tables)
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert (x.k, x.i) == (y.k, y.i)
            assert x.v == pytest.approx(y.v, abs=1e-9) if x.v is not None else y.v is None


def test_operators_that_need_whole_series_refuse_blocks(spark, noise):
    p = panel_of(spark, noise, block=10)
    for fn in (lambda: decompose.x11_filters(p, "y", 4), lambda: stl.stl(p, "y", 6)):
        with pytest.raises(ValueError, match="whole series"):
            fn()


def test_blocked_acf_equals_numpy(spark, noise):
    for block in (None, 20):
        rows = features.acf(panel_of(spark, noise, block=block), "y", 5).collect()
        for r in rows:
            e = noise[r.k] - noise[r.k].mean()
            assert r.acf == pytest.approx((e[r.lag:] * e[:-r.lag]).sum() / (e * e).sum(), abs=1e-10)


def test_order_statistics_equal_numpy_at_any_scale(spark):
    """Quantiles, trimmed mean and MAD over signs, zeros, ties, one value, huge and tiny numbers."""
    rng = np.random.default_rng(9)
    series = {
        "mixed": rng.normal(0, 1, 4001), "far": 1e6 + rng.normal(0, 1, 3000), "ones": np.ones(50), "zeros": np.concatenate([np.zeros(300), rng.normal(size=99)]),
        "ints": rng.integers(-3, 4, 2000), "log": np.exp(rng.normal(0, 40, 1500)) * rng.choice([-1, 1], 1500), "two": [-5.0, 7.0], "one": [3.5], "edge": 2.0 ** np.arange(-30, 30),
        "half": np.concatenate([np.full(500, 1.0), rng.uniform(0, 1e-3, 499), [2.0, 5.0]]),
    }
    rows = [(k, float(v)) for k, vs in series.items() for v in vs] + [("mixed", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, y double").repartition(5)
    probs = [0.5, 0.0, 0.05, 0.25, 0.9, 1.0]
    found = {r.k: r for r in quantiles.order_statistics(df, ["k"], "y", probs, [f"q{i}" for i in range(6)], 0.1, "mad").collect()}
    assert found.keys() == series.keys()
    for k, vs in series.items():
        v = np.sort(np.asarray(vs, float))
        cut = int(np.floor(len(v) * 0.1))
        want = [*np.quantile(v, probs), v[cut : len(v) - cut].mean(), np.median(np.abs(v - np.median(v)))]
        scale = np.abs(v).max()
        got = [*(found[k][f"q{i}"] for i in range(6)), found[k].trimmed, found[k].mad]
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12 * scale), k


def test_quantiles_equal_numpy_on_ties_and_small_groups(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.integers(0, 5, 400), "b": rng.normal(0, 1, 3), "c": [4.0], "d": rng.normal(size=25001)}
    p = panel_of(spark, series)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    for r in quantiles.quantiles(p.df, ["k"], "y", probs, names).collect():
        want = np.quantile(np.asarray(series[r.k], float), probs)
        assert [r[n] for n in names] == pytest.approx(want.tolist(), abs=1e-12)


def test_describe_against_numpy(spark, noise):
    x = np.concatenate(list(noise.values()))
    r = quantiles.describe(panel_of(spark, noise).df, ["y"]).first()
    s = np.sort(x)
    cut = int(len(s) * 0.1)
    assert r.trimmed == pytest.approx(s[cut : len(s) - cut].mean())
    assert r.mad == pytest.approx(np.median(np.abs(x - np.median(x))) * 1.4826)
    assert r["skew"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std(ddof=1) ** 3)
    assert r["kurtosis"] == pytest.approx(((x - x.mean()) ** 4).mean() / x.std(ddof=1) ** 4 - 3)
    assert r.se == pytest.approx(x.std(ddof=1) / math.sqrt(len(x)))


def test_winsorise_keeps_nulls(spark):
    p = panel_of(spark, {"a": [None, *range(1, 101)]})
    out = quantiles.winsorise(p, "y", 0.05).df.orderBy("i").collect()
    assert out[0].clamped is None
    assert out[1].clamped == pytest.approx(np.quantile(np.arange(1, 101), 0.05))


def test_histogram_and_lag_pairs(spark):
    p = panel_of(spark, {"a": [0, 1, 2, 3, 4, 5, 6, 7, 8, 10], "flat": [2, 2]})
    h = {(r.k, r.bin): r["count"] for r in aggregate.histogram(p.df, ["k"], "y", 5).collect()}
    assert h == {("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): 2, ("a", 5): 2, ("flat", 1): 2}
    pairs = windows.lag_pairs(p, "y", [3]).where("k = 'a'")
    assert pairs.count() == 7 and pairs.where("y - lagged <> 3").count() == 1


def test_known_season_is_recovered(spark):
    season = [3.0, -1.0, -4.0, 2.0]
    p = panel_of(spark, {"a": [2 * t + season[t % 4] for t in range(40)], "short": [1, 2, 3, 4, 5]})
    out = decompose.classical(p, "y", period=4).df
    assert column(out, "seasonal")[:4] == pytest.approx(season)
    assert max(abs(v) for v in column(out, "random") if v is not None) < 1e-9
    assert set(column(out, "seasonal", "short")) == {None}
    fit = reg.fit_seasonal(p.with_position("t").with_season("s", 4).df.where("k = 'a'"), ["k"], "y", ["t"], "s")
    assert {round(r.coef[0], 9) for r in fit.collect()} == {2.0}


def test_multiplicative_parts_multiply_back(spark, noise):
    out = decompose.classical(panel_of(spark, noise), "y", "multiplicative", 12).df.where("random IS NOT NULL")
    gap = out.select(F.max(F.abs(F.col("trend") * F.col("seasonal") * F.col("random") - F.col("y")))).first()[0]
    assert gap < 1e-9


def test_henderson_weights():
    w = decompose.henderson_weights(13)
    assert sum(w) == pytest.approx(1)
    assert w[6] == pytest.approx(0.24006, abs=5e-6) and w[0] == pytest.approx(-0.01935, abs=5e-6)


def test_stl_splits_trend_and_season(spark):
    rng = np.random.default_rng(5)
    t = np.arange(120)
    y = 0.5 * t + 10 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.3, 120)
    p = panel_of(spark, {"a": y, "short": y[:10]})
    for kw in ({}, {"season_window": None, "trend_window": 21, "robust": True}):
        out = stl.stl(p, "y", periods=[12], **kw).df
        got = np.array(column(out, "seasonal"))
        assert np.abs(got - 10 * np.sin(2 * np.pi * t / 12))[6:-6].max() < 1.0
        total = np.array(column(out, "trend")) + got + np.array(column(out, "remainder"))
        assert np.abs(total - y).max() < 1e-9
        assert set(column(out, "trend", "short")) == {None}


def test_portmanteau_and_tails(spark):
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054)
    df = spark.range(1).select(
        chi2_tail(F.lit(3.841458820694124), 1).alias("one"),
        chi2_tail(F.lit(18.307038053275146), 10).alias("ten"),
        chi2_tail(F.lit(7.814727903251179), 3).alias("three"),
        normal_cdf(F.lit(1.959963984540054)).alias("phi"),
    ).first()
    assert (df.one, df.ten, df.three) == pytest.approx((0.05, 0.05, 0.05))
    assert df.phi == pytest.approx(0.975)


def test_kpss_equals_the_autocovariance_form(spark, noise):
    walk = {"a": np.cumsum(noise["a"] - 50), "b": noise["b"], "flat": [1.0] * 20}
    for r in features.kpss(panel_of(spark, walk), "y").collect():
        if r.k == "flat":
            assert r.kpss_stat is None
            continue
        x = np.asarray(walk[r.k])
        n, e = len(x), x - x.mean()
        width = int(4 * (n / 100) ** 0.25)
        lrv = (e @ e) / n + 2 * sum((1 - s / (width + 1)) * (e[s:] @ e[:-s]) / n for s in range(1, width + 1))
        assert r.kpss_stat == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / lrv)
    d = {r.k: r.ndiffs for r in features.ndiffs(panel_of(spark, walk), "y").collect()}
    assert d["b"] == 0 and d["a"] >= 1


def test_baseline_formulas(spark):
    y = [3.0, 5.0, 4.0, 8.0, 6.0, 9.0, 7.0]
    p = panel_of(spark, {"a": y, "one": [2.0]})
    fc = {(r.k, r.model, r.h): (r["mean"], r.sd) for r in baseline.forecast_baselines(p, "y", 3, 2).collect()}
    d1 = np.diff(y)
    assert fc["a", "mean", 1] == pytest.approx((np.mean(y), np.std(y, ddof=1) * math.sqrt(1 + 1 / 7)))
    assert fc["a", "naive", 3] == pytest.approx((7.0, d1.std(ddof=1) * math.sqrt(3)))
    assert fc["a", "snaive", 3][0] == 9.0
    assert fc["a", "drift", 2] == pytest.approx((7 + 2 * 4 / 6, d1.std(ddof=1) * math.sqrt(2 * (1 + 2 / 6))))
    assert fc["one", "naive", 1] == (2.0, None) and fc["one", "snaive", 1] == (None, None)


def test_bootstrap_is_repeatable(spark, noise):
    p = panel_of(spark, noise)
    a, b = (
        {(r.k, r.rep, r.h): r.sim for r in baseline.bootstrap_paths(q, "y", 5, 3).collect()}
        for q in (p, p.on(p.df.repartition(5)))
    )
    assert a == b and len(a) == 30


def test_least_squares_equals_numpy_and_drops_aliased_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(0, 0.1, 60)
    rows = [(float(a), float(b), 4.0, float(v)) for (a, b), v in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, y double").withColumn("k", F.lit("k"))
    fit = reg.fit_ols(df, ["k"], "y", ["a", "flat", "b"])
    r = fit.first()
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert r.coef == pytest.approx([want[0], want[1], 0.0, want[2]], abs=1e-8)
    assert r["rank"] == 3
    design = np.column_stack([np.ones(60), x])
    hat = design @ np.linalg.inv(design.T @ design) @ design.T
    loo = np.mean(((y - hat @ y) / (1 - np.diag(hat))) ** 2)
    got = reg.leave_one_out(df, reg.fit_ols(df, ["k"], "y", ["a", "b"]), ["k"], "y", ["a", "b"]).first().cv
    assert got == pytest.approx(loo)


def test_season_regression_equals_dummies(spark, noise):
    rng = np.random.default_rng(9)
    y = noise["a"]
    n = len(y)
    t, flag = np.arange(1, n + 1), rng.integers(0, 2, n)
    p = panel_of(spark, {"a": y}).with_position("t").with_season("s", 6)
    flags = spark.createDataFrame([(int(i), float(f)) for i, f in zip(t, flag)], "i long, f double")
    df = p.df.join(flags, "i")
    dummies = np.eye(6)[(t - 1) % 6]
    fit = reg.fit_seasonal(df, ["k"], "y", ["t", "f"], "s")
    want = np.linalg.lstsq(np.column_stack([dummies, t, flag]), y, rcond=None)[0]
    rows = sorted(fit.collect(), key=lambda r: r.s)
    assert [r.alpha for r in rows] == pytest.approx(want[:6].tolist())
    assert rows[0].coef == pytest.approx(want[6:].tolist())
    slopes = reg.fit_seasonal(df, ["k"], "y", ["f"], "s", slope_on="t")
    design = np.column_stack([dummies, dummies * t[:, None], flag])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    rows = sorted(slopes.collect(), key=lambda r: r.s)
    assert [r.slope for r in rows] == pytest.approx(want[6:12].tolist())
    assert rows[0].coef[0] == pytest.approx(want[12])
    assert rows[0].rss == pytest.approx(float(((y - design @ want) ** 2).sum()))
    assert rows[0]["rank"] == 13


def test_arima_finds_an_autoregression(spark):
    rng = np.random.default_rng(2)
    y = np.zeros(400)
    for i in range(1, 400):
        y[i] = 0.7 * y[i - 1] + rng.normal()
    p = panel_of(spark, {"a": y + 20})
    orders = arima.fixed_order((1, 0, 0), constant=True)
    models, designed = arima.fit_arima(p, "y", orders, period=1)
    m = models.first()
    z = y[10:] + 20
    b = np.polyfit((y + 20)[9:-1], z, 1)
    assert (m.coef[1], m.coef[0]) == pytest.approx((b[0], b[1]), rel=0.05)
    fc = arima.forecast_arima(models, designed, "y", 3, orders, period=1).orderBy("h").collect()
    step = m.coef[0] + m.coef[1] * (y[-1] + 20)
    assert fc[0]["mean"] == pytest.approx(step)
    assert fc[1]["mean"] == pytest.approx(m.coef[0] + m.coef[1] * step)
    assert fc[1].sd == pytest.approx(math.sqrt(m.sigma2 * (1 + m.coef[1] ** 2)))


def test_arima_differences_a_walk(spark):
    rng = np.random.default_rng(4)
    p = panel_of(spark, {"a": np.cumsum(rng.normal(0.5, 1, 300)), "b": rng.normal(0, 1, 300)})
    models, designed = arima.fit_arima(p, "y", arima.Orders(2, 2, 0, 0), period=1)
    d = {r.k: r.order_d for r in models.collect()}
    assert d == {"a": 1, "b": 0}
    fc = arima.forecast_arima(models, designed, "y", 5, arima.Orders(2, 2, 0, 0), period=1)
    assert fc.where("mean IS NULL").count() == 0


def test_network_learns_a_cycle(spark):
    t = np.arange(120)
    s = splits.split_last_rows(panel_of(spark, {"a": 10 + np.sin(2 * np.pi * t / 8), "short": [1.0, 2.0, 3.0]}), 8)
    out = neural.forecast_nnet(s, "y", lags=8, seasonal_lags=0, networks=5, rounds=400)
    a = out.where("k = 'a'").collect()
    assert len(a) == 8 and math.sqrt(np.mean([(r.actual - r["mean"]) ** 2 for r in a])) < 0.25


def test_seasonal_difference_from_stl(spark):
    rng = np.random.default_rng(8)
    t = np.arange(96)
    p = panel_of(spark, {"season": 10 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, 96), "noise": rng.normal(0, 1, 96), "short": [1.0] * 20})
    orders = arima.Orders(1, 1, 1, 1, d=0, loess_season=True)
    df = arima.with_differencing(p, "y", orders, 12).df
    assert {r.k: r.order_ds for r in df.select("k", "order_ds").distinct().collect()} == {"season": 1, "noise": 0, "short": 0}


def test_network_settings_of_each_series(spark):
    rng = np.random.default_rng(12)
    noise, two = rng.normal(0, 1, 400), [0.0, 0.0]
    for e in noise:
        two.append(0.5 * two[-1] + 0.4 * two[-2] + e)
    series = {"two": two, "white": rng.normal(0, 1, 400), "short": [1.0, 2.0], "flat": [3.0] * 50}
    p = panel_of(spark, series)
    got = {r.k: r.lags for r in neural.automatic_lags(p, "y", 8, period=1).collect()}
    assert got["two"] >= 2 and got["flat"] == got["short"] == 1 and all(1 <= v <= 8 for v in got.values())

    def brute(y):
        y = np.array(y) - np.mean(y)
        r = [float(y[k:] @ y[: len(y) - k]) for k in range(9)]
        best = []
        for k in range(1, 9):
            m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
            phi = np.linalg.solve(m, r[1 : k + 1])
            best.append((len(y) * np.log(1 - phi @ np.array(r[1 : k + 1]) / r[0]) + 2 * k, k))
        return min(best)[1]

    assert got["two"] == brute(two) and got["white"] == brute(series["white"])
    # A series with a negative value is not transformed; the automatic order is the given one.
    s = splits.split_last_rows(panel_of(spark, {"two": two}), 5)
    order = neural.automatic_lags(splits.train(s), "y", 8, period=1).first().lags
    opts = {"seasonal_lags": 0, "networks": 2, "rounds": 20, "period": 1}
    auto = neural.forecast_nnet(s, "y", lags=None, lag_max=8, lam="auto", **opts).orderBy("h").collect()
    given = neural.forecast_nnet(s, "y", lags=order, **opts).orderBy("h").collect()
    assert [r["mean"] for r in auto] == pytest.approx([r["mean"] for r in given])
    up = splits.split_last_rows(panel_of(spark, {"up": (100 + np.arange(60) ** 1.5 * (1 + 0.1 * np.cos(np.arange(60)))).tolist()}), 4)
    lam = features.guerrero(splits.train(up), "y", 2).first().lambda_guerrero
    pair = [[r["mean"] for r in neural.forecast_nnet(up, "y", lags=3, lam=x, **{**opts, "period": 2}).orderBy("h").collect()] for x in ("auto", lam)]
    assert pair[0] == pytest.approx(pair[1]) and np.isfinite(pair[0]).all()


@pytest.mark.parametrize("p,train", [(0.2, 8), (0.0, 10), (1.0, 0)])
def test_split_edges(spark, p, train):
    s = splits.split_by_share(panel_of(spark, {"a": range(10)}), p)
    assert splits.train(s).df.count() == train and splits.test(s).df.count() == 10 - train


def test_split_rejects_bad_shares(spark):
    with pytest.raises(ValueError):
        splits.split_by_share(panel_of(spark, {"a": [1]}), -0.1)


def test_split_last_rounds_half_to_even(spark):
    s = splits.split_last(panel_of(spark, {"a": range(50)}), 0.05)
    assert splits.test(s).df.count() == 2


def test_expanding_sums_match_the_running_form(spark, noise):
    p = panel_of(spark, {"a": noise["a"][:30]})
    folds = splits.expanding_sums(p, ["y"], 3, 1)
    want = {r.origin: r.sums[0] / r.n for r in folds.collect()}
    got = splits.expanding_one_step(p, "y", 3).where("model = 'mean'").collect()
    assert all(r.pred == pytest.approx(want[r.origin]) for r in got) and len(got) == 27
    # One row a fold, whatever the length.
    long = panel_of(spark, {"a": range(5000)})
    assert splits.expanding_sums(long, ["y"], 24, 12).count() == 415


def test_ols_keeps_columns_at_a_high_level(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 10, 400)
    rows = [("a", float(v), float(2 * (v - 1e6) + e)) for v, e in zip(x, rng.normal(0, 1, 400))]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    r = reg.fit_ols(df, ["k"], "y", ["x"]).first()
    slope, level = np.polyfit(x - 1e6, [v[2] for v in rows], 1)
    assert r["rank"] == 2 and r.coef[1] == pytest.approx(slope, rel=1e-6) and r.coef[0] + 1e6 * r.coef[1] == pytest.approx(level, abs=1e-3)


def test_kpss_of_a_long_series(spark):
    v = np.sin(np.arange(200_000) * 0.37) + np.arange(200_000) % 7
    got = features.kpss(panel_of(spark, {"a": v.tolist()}), "y").first()
    e = v - v.mean()
    n, width = len(e), int(4 * (len(e) / 100) ** 0.25)
    lrv = (e @ e + 2 * sum((1 - k / (width + 1)) * (e[k:] @ e[:-k]) for k in range(1, width + 1))) / n
    assert got.kpss_stat == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / lrv, rel=1e-6)


def test_differencing_takes_the_given_orders(spark):
    t = np.arange(80.0)
    cubic, m = t**3, 4
    p = panel_of(spark, {"a": cubic.tolist()})
    p = arima.with_differencing(p, "y", arima.fixed_order((1, 3, 0), (0, 0, 0)), m)
    w = [r.w for r in arima.design(p, "y", arima.fixed_order((1, 3, 0)), m).df.orderBy("t").collect() if r.w is not None]
    assert np.allclose(w, 6)
    q = panel_of(spark, {"a": (t**2 + t % 4).tolist()})
    q = arima.with_differencing(q, "y", arima.fixed_order((1, 0, 0), (0, 2, 0)), m)
    w = [r.w for r in arima.design(q, "y", arima.fixed_order((1, 0, 0), (0, 2, 0)), m).df.orderBy("t").collect() if r.w is not None]
    assert np.allclose(w, 32)


def test_seasonal_polynomials_multiply(spark):
    rng, m, n = np.random.default_rng(17), 12, 6000
    e = rng.normal(0, 1, n)
    ar, ma = np.zeros(n), np.zeros(n)
    for t in range(n):
        ar[t] = e[t] + (0.6 * ar[t - 1] if t else 0) + (0.5 * ar[t - m] if t >= m else 0) - (0.3 * ar[t - m - 1] if t > m else 0)
        ma[t] = e[t] + (0.8 * e[t - m] if t >= m else 0)
    p = panel_of(spark, {"a": ar.tolist()})
    model = arima.fit_arima(p, "y", arima.fixed_order((1, 0, 0), (1, 0, 0), constant=True), m)[0].first()
    assert model.coef[1] == pytest.approx(0.6, abs=0.05) and model.coef[2] == pytest.approx(0.5, abs=0.05)
    assert model.coef[3] == pytest.approx(-model.coef[1] * model.coef[2]) and model.sigma2 == pytest.approx(1, abs=0.05)
    q = panel_of(spark, {"a": ma.tolist()})
    model = arima.fit_arima(q, "y", arima.fixed_order((0, 0, 0), (0, 0, 1), constant=True), m)[0].first()
    # Two periods of long autoregression see most of a seasonal moving average.
    assert model.coef[1] == pytest.approx(0.8, abs=0.1)


def test_seasonal_random_walk_with_drift_has_a_closed_form(spark, noise):
    y, m = np.cumsum(noise["a"][:80]), 4
    orders = arima.fixed_order((0, 1, 0), (0, 1, 0), constant=False)
    models, designed = arima.fit_arima(panel_of(spark, {"a": y.tolist()}), "y", orders, m)
    got = [r["mean"] for r in arima.forecast_arima(models, designed, "y", 6, orders, m).orderBy("h").collect()]
    level = y.tolist()
    for _ in range(6):
        level.append(level[-1] + level[-m] - level[-m - 1])
    assert got == pytest.approx(level[80:])


def test_horizons_follow_the_test_rows(spark, noise):
    p = panel_of(spark, {"a": noise["a"][:60], "b": noise["a"][:40]})
    s = splits.split_by_share(p, 0.3)
    models, designed = arima.fit_arima(splits.train(s), "y", arima.fixed_order((1, 0, 0), constant=True))
    got = arima.forecast_arima(models, designed, "y", arima.horizons(s), arima.fixed_order((1, 0, 0), constant=True))
    counts = {tuple(r[:-1]): r[-1] for r in got.groupBy(*p.key).count().collect()}
    want = {tuple(r[:-1]): r[-1] for r in splits.test(s).df.groupBy(*p.key).count().collect()}
    assert counts == want


def test_accuracy_and_ties(spark):
    rows = [("m1", 1, 0.0, 1.0), ("m1", 2, 2.0, 1.0), ("m2", 1, 0.0, -1.0), ("m2", 2, 2.0, 3.0), ("m3", 1, 0.0, 5.0), ("m3", 2, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, h long, actual double, mean double").withColumn("k", F.lit("a"))
    acc = evaluate.accuracy(df, ["k", "model"])
    by = {r.model: r for r in acc.collect()}
    assert by["m1"].rmse == 1.0 and by["m1"].mape == 50.0 and by["m1"].me == 0.0
    assert {r.model for r in evaluate.best_models(acc, ["k"]).collect()} == {"m1", "m2"}


def test_crps_against_numeric_integral(spark):
    got = spark.range(1).select(evaluate.crps(F.lit(1.3), F.lit(0.4), F.lit(2.0)).alias("c")).first().c
    x = np.linspace(-20, 20, 400001)
    cdf = 0.5 * np.array([math.erfc(-(v - 0.4) / 2 / math.sqrt(2)) for v in x])
    assert got == pytest.approx(float((((x >= 1.3) - cdf) ** 2).sum() * (x[1] - x[0])), abs=1e-3)


def test_recode_levels_and_null_columns(spark):
    df = spark.createDataFrame([("a", None), ("z", 1)], "g string, v int")
    fam = shape.recode("g", {"First": ["a"]}, "Other")
    assert [r[0] for r in df.select(fam).collect()] == ["First", "Other"]
    assert [r[0] for r in df.select(shape.level_order("g", ["b", "a"])).collect()] == [2, None]
    assert shape.without_null_columns(df).columns == ["g"]


def test_guerrero_prefers_the_log_for_proportional_spread(spark):
    y = [10 * 1.05**b * (1 + 0.1 * math.sin(i)) for b in range(12) for i in range(12)]
    lam = features.guerrero(panel_of(spark, {"a": y}), "y", period=12).first().lambda_guerrero
    assert abs(lam) < 0.05


def test_dates_grain_shift(spark):
    p = Panel(spark.createDataFrame([("a", dt.date(2024, 1, 31), 1.0)], "k string, i date, y double"), ("k",), "i", "day")
    assert str(baseline.forecast_baselines(p, "y", 1, models=("naive",)).first().i) == "2024-02-01"


def test_stepwise_search_over_any_landscape():
    """Never worse than the first round, at a local best, and the whole grid on small limits."""
    rng = np.random.default_rng(12)
    for limits in ((3, 3, 1, 1), (2, 2, 1, 1), (1, 1, 0, 0), (2, 0, 1, 0), (0, 0, 0, 0)):
        orders = arima.Orders(*limits)
        for _ in range(20):
            value = {c: float(v) for c, v in zip(orders.candidates(), rng.normal(size=len(orders.candidates())))}
            fits = arima.searched(orders, lambda c: (None, 0.0, 0, value[c]), lambda c: True)
            best = min(fits, key=lambda c: fits[c][3])
            assert fits[best][3] <= min(value[c] for c in orders.first_round())
            assert all(value[c] >= value[best] for c in orders.neighbours(best))
            if limits == (1, 1, 0, 0):
                assert fits.keys() == value.keys()
        none = arima.searched(orders, lambda c: (None, 0.0, 0, 0.0), lambda c: c[4] == 0)
        assert all(c[4] == 0 for c in none)


def test_stepwise_orders_of_a_seasonal_series(spark):
    """A product model of lags 1 and 12: the search takes the seasonal order; on small limits it equals the full grid."""
    rng = np.random.default_rng(5)
    series = {}
    for k in "ab":
        e, y = rng.normal(size=460), np.zeros(460)
        for t in range(14, 460):
            y[t] = 0.5 * y[t - 1] + 0.7 * y[t - 12] - 0.35 * y[t - 13] + e[t]
        series[k] = 20 + y[60:]
    p = panel_of(spark, series)
    for limits, same in (((1, 1, 0, 0), True), ((2, 2, 1, 1), False)):
        found, grid = (
            {r.k: r for r in arima.fit_arima(p, "y", arima.Orders(*limits, d=0, D=0, stepwise=how), period=12)[0].collect()} for how in (True, False)
        )
        for k in "ab":
            assert found[k].aicc >= grid[k].aicc - 1e-9
            if same:
                assert found[k].aicc == pytest.approx(grid[k].aicc, abs=1e-9)
            else:
                assert found[k].order_ps == 1 and found[k].aicc < grid[k].aicc + 3


def test_unit_root_statistic_equals_numpy(spark):
    rng = np.random.default_rng(21)
    series = {"walk": np.cumsum(rng.normal(size=150)), "noise": rng.normal(5, 1, 90), "flat": np.ones(30), "one": [2.0], "two": [1.0, 2.0]}
    found = {r.k: r for r in features.phillips_perron(panel_of(spark, series), "y").collect()}
    for k in ("walk", "noise"):
        y, x = series[k][1:], series[k][:-1]
        n = len(y)
        design = np.column_stack([np.ones(n), x])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        u = y - design @ beta
        width = int(4 * (n / 100) ** 0.25)
        short = (u @ u) / n
        long = short + 2 / n * sum((1 - j / (width + 1)) * (u[j:] @ u[:-j]) for j in range(1, width + 1))
        se = np.sqrt(u @ u / (n - 2) / ((x - x.mean()) ** 2).sum())
        want = np.sqrt(short / long) * (beta[1] - 1) / se - (long - short) / 2 / np.sqrt(long) / np.sqrt(y.var() / n)
        assert found[k].pp_stat == pytest.approx(want, rel=1e-8)
    assert found["noise"].pp_pvalue == 0.01 and found["walk"].pp_pvalue > 0.05
    assert all(found[k].pp_stat is None and found[k].pp_pvalue is None for k in ("flat", "two") if k in found)


def test_features_of_short_flat_and_gappy_series(spark):
    """No error and NULL where a feature has no meaning; known values where it has."""
    rng = np.random.default_rng(22)
    jump = np.concatenate([rng.normal(0, 1, 40), rng.normal(9, 1, 40)])
    series = {"one": [1.0], "flat": np.full(64, 3.0), "jump": jump, "gaps": [None if k % 9 == 4 else float(v) for k, v in enumerate(jump)], "noise": rng.normal(size=2048)}
    p = panel_of(spark, series)
    kl = {r.k: r for r in features.kl_shift(p, "y", 12).collect()}
    level = {r.k: r for r in features.level_shifts(p, "y", 12).collect()}
    assert kl["one"].shift_kl_max is None and kl["flat"].shift_kl_max == 0
    assert abs(kl["jump"].shift_kl_index - 40) <= 1 and level["jump"].shift_level_index == 40
    entropy = {r.k: r.spectral_entropy for r in features.spectral_entropy(p, "y").collect()}
    assert entropy["one"] is None and entropy["flat"] is None and entropy["noise"] > 0.97 > entropy["jump"]
    slope = {r.k: r.coef_hurst for r in features.hurst(p, "y").collect()}
    assert slope["one"] is None and slope["flat"] is None and 0.45 < slope["noise"] < 0.7 and slope["jump"] > slope["noise"]
    blocked = {r.k: r for r in features.kl_shift(panel_of(spark, series, block=7), "y", 12).collect()}
    assert all(blocked[k].shift_kl_index == kl[k].shift_kl_index for k in ("jump", "gaps"))
