"""The full model battery over all splits of a panel, as one long forecast table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import arima, baseline, neural, regression as reg, shape, splits
from chronopanel.panel import Panel
from chronopanel.session import together, written

SHARES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)
FLAGS = ("home", "covid", "holiday", "ice_present")
# Covariates of the interaction model, whose trend differs by season.
INTER = ("home", "covid", "ice_present")

# The names under which results are reported.
FAMILIES = {
    "Neural Networks": ["nn_base", "nn_vars"],
    "ARIMA": ["arima_full", "arima_plain", "arima_sdif"],
    "Regression": ["tslm_base", "tslm_inter", "tslm_vars", "tslm_vars_no_comp"],
    "Baseline": ["drift", "naive", "snaive"],
}


def prepared(panel: Panel, shares: Sequence[float] = SHARES, period: int | None = None) -> Panel:
    """Every split of every series: key (p, key), with t, season, part and h."""
    return splits.split_sweep(panel, shares).with_season("season", period)


def _pairs(df: DataFrame, key: Sequence[str], model: str, actual: str = "actual") -> DataFrame:
    return df.select(
        *key, F.lit(model).alias("model"), F.col("h").cast("long").alias("h"),
        F.col(actual).cast("double").alias("actual"), F.col("mean").cast("double").alias("mean"),
    )


def baseline_pairs(split: Panel, y: str, period: int | None = None, models=("naive", "snaive", "drift")) -> DataFrame:
    key = list(split.key)
    rows = splits.test(split).df.select(*key, "h", F.col(y).cast("double").alias("actual"))
    fc = baseline.forecast_for(splits.train(split), y, rows, period, models)
    return fc.select(*key, "model", "h", "actual", "mean", "sd")


def regression_pairs(split: Panel, y: str, inter: Sequence[str] = INTER) -> DataFrame:
    key = list(split.key)
    train, test = splits.train(split).df, splits.test(split).df
    base = reg.predict_seasonal(test, reg.fit_seasonal(train, key, y, ["t"]), key, ["t"])
    some = list(inter)
    crossed = reg.predict_seasonal(
        test, reg.fit_seasonal(train, key, y, some, slope_on="t"), key, some, slope_on="t"
    )
    full = ["t", *FLAGS]
    flags = reg.predict_seasonal(test, reg.fit_seasonal(train, key, y, full), key, full)
    plain = reg.predict_ols(test, reg.fit_ols(train, key, y, list(FLAGS)), key, list(FLAGS))
    named = {"tslm_base": base, "tslm_inter": crossed, "tslm_vars": flags, "tslm_vars_no_comp": plain}
    return shape.bind_rows(*[_pairs(df, key, m, y) for m, df in named.items()])


def arima_pairs(split: Panel, y: str, orders: arima.Orders = arima.Orders(2, 2)) -> DataFrame:
    """Stepwise searches: seasonal orders for the plain and the full model, none where the season is in the regression.

    Series too short for seasonal lags are searched without them.  The three models
    store their lags and residuals on the way and do not depend on each other.
    """
    key = list(split.key)
    plain, full, sdif = together(
        lambda: _plain_arima(split, y, orders),
        lambda: arima.arima_regression(split, y, ["t", *FLAGS], orders),
        lambda: arima.arima_regression(split, y, ["t", "home", "covid", "holiday"], orders.nonseasonal()),
    )
    named = {"arima_plain": plain, "arima_full": full, "arima_sdif": sdif}
    return shape.bind_rows(*[_pairs(df, key, m) for m, df in named.items()])


def _plain_arima(split: Panel, y: str, orders: arima.Orders) -> DataFrame:
    key = list(split.key)
    test = splits.test(split).df.select(*key, "h", F.col(y).cast("double").alias("actual"))
    train = splits.train(split)
    models, designed = arima.fit_arima(train, y, orders)
    models = written(models, "models")
    plain = arima.forecast_arima(models, designed, y, arima.horizons(split), orders)
    short = train.df.select(*key).distinct().join(models, key, "left_anti")
    if not short.isEmpty():
        small = orders.nonseasonal()
        rest, lags = arima.fit_arima(train.on(train.df.join(short, key, "left_semi")), y, small)
        plain = plain.unionByName(arima.forecast_arima(rest, lags, y, arima.horizons(split), small))
    return plain.drop(split.index).join(test, [*key, "h"])


def neural_pairs(split: Panel, y: str, networks: int = 10, rounds: int = 150) -> DataFrame:
    key = list(split.key)
    # The splits are stored, so counting their series reads one column.
    nets = {"lags": 4, "networks": networks, "rounds": rounds, "series": split.df.select(*key).distinct().count()}
    base = neural.forecast_nnet(split, y, **nets)
    flags = neural.forecast_nnet(split, y, list(FLAGS), **nets)
    return shape.bind_rows(_pairs(base, key, "nn_base"), _pairs(flags, key, "nn_vars"))


def all_residuals(split: Panel, y: str, orders: arima.Orders = arima.Orders(2, 2), networks: int = 10, rounds: int = 150, inter: Sequence[str] = INTER) -> DataFrame:
    """(key, model, index, resid): one-step residuals of all twelve models on the training rows of every split."""
    key, index = list(split.key), split.index
    train = splits.train(split)
    some, full = list(inter), ["t", *FLAGS]
    base = baseline.fitted_baselines(train, y).where("model <> 'mean'").select(*key, "model", index, "resid")
    fits = {
        "tslm_base": reg.predict_seasonal(train.df, reg.fit_seasonal(train.df, key, y, ["t"]), key, ["t"]),
        "tslm_inter": reg.predict_seasonal(train.df, reg.fit_seasonal(train.df, key, y, some, slope_on="t"), key, some, slope_on="t"),
        "tslm_vars": reg.predict_seasonal(train.df, reg.fit_seasonal(train.df, key, y, full), key, full),
        "tslm_vars_no_comp": reg.predict_ols(train.df, reg.fit_ols(train.df, key, y, list(FLAGS)), key, list(FLAGS)),
    }
    named = {m: df.withColumn("resid", F.col(y) - F.col("mean")) for m, df in fits.items()}
    designed = arima.fit_arima(train, y, orders)[1]
    named["arima_plain"] = designed.df.withColumnRenamed("innov", "resid")
    named["arima_full"] = arima.arima_regression(split, y, ["t", *FLAGS], orders, residuals=True)
    named["arima_sdif"] = arima.arima_regression(split, y, ["t", "home", "covid", "holiday"], orders.nonseasonal(), residuals=True)
    nets = {"networks": networks, "rounds": rounds, "lags": 4, "residuals": True}
    named["nn_base"] = neural.forecast_nnet(split, y, **nets)
    named["nn_vars"] = neural.forecast_nnet(split, y, list(FLAGS), **nets)
    rows = [df.select(*key, F.lit(m).alias("model"), index, F.nanvl(F.col("resid"), F.lit(None)).alias("resid")) for m, df in named.items()]
    return shape.bind_rows(base, *rows).where("resid IS NOT NULL")


def all_pairs(split: Panel, y: str, inter: Sequence[str] = INTER) -> DataFrame:
    """Forecast and actual of every model, split and test row."""
    key = list(split.key)
    base = baseline_pairs(split, y).select(*key, "model", "h", "actual", "mean")
    return shape.bind_rows(base, regression_pairs(split, y, inter), arima_pairs(split, y), neural_pairs(split, y))


def result_table(scores: DataFrame) -> DataFrame:
    """Scores with the model family and the display order of families."""
    family = shape.recode("model", FAMILIES, "Other")
    out = scores.withColumn("family", family)
    return out.withColumn("family_order", shape.level_order("family", list(FAMILIES)))
