"""Closed-form benchmark forecasts: mean, naive, seasonal naive, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.tails import Z_LEVEL
from chronopanel.operators.windows import framed
from chronopanel.sources.noise import draw_bits
from chronopanel.panel import Panel, shift

MODELS = ("mean", "naive", "snaive", "drift")


def seasonal_tail(panel: Panel, x: str, m: int) -> DataFrame:
    """Map 0..m-1 -> one of the last ``m`` values of each series (NULL when shorter).

    Expects the position column ``t``.
    """
    n = F.max("t").over(panel.whole())
    df = panel.df.select(*panel.key, "t", x, n.alias("__n")).where(F.col("t") > F.col("__n") - m)
    slot = F.struct((F.col("t") - F.col("__n") + m - 1).cast("int"), F.col(x).cast("double"))
    return df.groupBy(*panel.key).agg(
        F.when(F.count(F.lit(1)) == m, F.map_from_entries(F.collect_list(slot))).alias("tail")
    )


def fit_baselines(panel: Panel, y: str, period: int | None = None) -> DataFrame:
    """One row per series with everything the four benchmark models need."""
    m = period or panel.period
    v = F.col(y).cast("double")
    p = panel.on(panel.df.select(*panel.key, panel.index, v.alias("__y")))
    p = framed(
        p.with_position("t"),
        {
            "__d1": lambda w: F.col("__y") - F.lag("__y").over(w),
            "__dm": lambda w: F.col("__y") - F.lag("__y", m).over(w),
        },
        m,
    )
    n = F.max("t").over(panel.whole())
    df = p.df.withColumn("__n", n)
    slot = F.struct((F.col("t") - F.col("__n") + m - 1).cast("int"), F.col("__y"))
    tail = F.map_from_entries(F.collect_list(F.when(F.col("t") > F.col("__n") - m, slot)))
    return df.groupBy(*panel.key).agg(
        F.count("__y").alias("n"),
        F.max(panel.index).alias("end"),
        F.avg("__y").alias("mean"),
        F.stddev_samp("__y").alias("sd"),
        F.min_by("__y", "t").alias("first"),
        F.max_by("__y", "t").alias("last"),
        F.stddev_samp("__d1").alias("sd1"),
        F.stddev_samp("__dm").alias("sdm"),
        F.when(F.max("__n") >= m, tail).alias("tail"),
    )


def _forecast_cells(m: int, models: Sequence[str]) -> Column:
    h, n = F.col("h"), F.col("n")
    slope = F.try_divide(F.col("last") - F.col("first"), n - 1)
    cells = {
        "mean": (F.col("mean"), F.col("sd") * F.sqrt(1 + 1 / n)),
        "naive": (F.col("last"), F.col("sd1") * F.sqrt(h)),
        "snaive": (
            F.col("tail")[F.pmod(h - 1, F.lit(m))],
            F.col("sdm") * F.sqrt(F.floor((h - 1) / m) + 1),
        ),
        "drift": (
            F.col("last") + h * slope,
            F.col("sd1") * F.sqrt(h * (1 + F.try_divide(h, n - 1))),
        ),
    }
    return F.array(
        *[F.struct(F.lit(k).alias("model"), cells[k][0].alias("mean"), cells[k][1].alias("sd")) for k in models]
    )


def forecast_baselines(
    panel: Panel, y: str, h: int, period: int | None = None, models: Sequence[str] = MODELS
) -> DataFrame:
    """Long forecast table (key, model, h, index, mean, sd) for horizons 1..h."""
    m = period or panel.period
    fit = fit_baselines(panel, y, m)
    rows = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return _forecast_rows(panel, rows, m, models)


def forecast_for(
    panel: Panel, y: str, horizon: DataFrame, period: int | None = None, models: Sequence[str] = MODELS
) -> DataFrame:
    """Forecasts for given rows: ``horizon`` holds the key, a horizon column ``h`` and
    columns to carry along (actual values, say)."""
    m = period or panel.period
    carried = [c for c in horizon.columns if c not in (*panel.key, "h", panel.index)]
    rows = horizon.drop(panel.index).join(fit_baselines(panel, y, m), list(panel.key))
    return _forecast_rows(panel, rows, m, models, carried)


def _forecast_rows(
    panel: Panel, rows: DataFrame, m: int, models: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    out = rows.withColumn("__c", F.explode(_forecast_cells(m, models)))
    return out.select(
        *panel.key,
        "__c.model",
        F.col("h").cast("long").alias("h"),
        shift("end", F.col("h"), panel.grain).alias(panel.index),
        "__c.mean",
        "__c.sd",
        *carried,
    )


def fitted_baselines(panel: Panel, y: str, period: int | None = None) -> DataFrame:
    """In-sample one-step values and residuals, long form."""
    m = period or panel.period
    v = F.col(y).cast("double")
    p = panel.on(panel.df.select(*panel.key, panel.index, v.alias("y")))
    p = framed(
        p.with_position("t"),
        {"__l1": lambda w: F.lag("y").over(w), "__lm": lambda w: F.lag("y", m).over(w)},
        m,
    )
    whole = panel.whole()
    first, last = F.min_by("y", "t").over(whole), F.max_by("y", "t").over(whole)
    slope = F.try_divide(last - first, F.max("t").over(whole) - 1)
    df = p.df.withColumns({"__mean": F.avg("y").over(whole), "__slope": slope})
    cells = {
        "mean": F.col("__mean"),
        "naive": F.col("__l1"),
        "snaive": F.col("__lm"),
        "drift": F.col("__l1") + F.col("__slope"),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("model"), c.alias("fitted")) for k, c in cells.items()])
    out = df.withColumn("__c", F.explode(arr))
    return out.select(
        *panel.key,
        "__c.model",
        panel.index,
        "t",
        "y",
        "__c.fitted",
        (F.col("y") - F.col("__c.fitted")).alias("resid"),
    )


def log_drift(panel: Panel, y: str, h: int) -> DataFrame:
    """Drift on log(y), returned as median and bias-adjusted mean on the scale of y."""
    p = panel.on(panel.df.withColumn("__log", F.log(F.col(y).cast("double"))))
    fc = forecast_baselines(p, "__log", h, models=("drift",))
    mu, var = F.col("mean"), F.col("sd") * F.col("sd")
    return fc.select(
        *panel.key, "h", panel.index, F.exp(mu).alias("median"), (F.exp(mu) * (1 + var / 2)).alias("mean")
    )


def hilo(fc: DataFrame, levels: Sequence[int] = (80, 95)) -> DataFrame:
    """Add one ``lower/upper`` struct per level of a normal forecast."""
    z = {lv: Z_LEVEL[lv] for lv in levels}
    return fc.withColumns(
        {
            f"hilo_{lv}": F.struct(
                (F.col("mean") - q * F.col("sd")).alias("lower"),
                (F.col("mean") + q * F.col("sd")).alias("upper"),
            )
            for lv, q in z.items()
        }
    )


def bootstrap_paths(panel: Panel, y: str, h: int, times: int, seed: int = 1) -> DataFrame:
    """Simulated naive paths (key, rep, h, sim) from resampled residuals.

    Residuals are numbered per series; a draw is a number from a hash of (seed,
    key, rep, h), joined to the residual of that number.  A recomputed task draws
    the same, and no series' residuals are gathered.
    """
    v, key = F.col(y).cast("double"), list(panel.key)
    p = panel.on(panel.df.select(*key, panel.index, v.alias("y")))
    p = framed(p.with_position("t"), {"__e": lambda w: F.col("y") - F.lag("y").over(w)}, 1)
    fit = p.df.groupBy(*key).agg(F.max_by("y", "t").alias("__last"), F.count("__e").alias("__n"), F.avg("__e").alias("__m"))
    fit = fit.where("__n > 0")
    known = p.df.where("__e IS NOT NULL").select(*key, "__e", F.col("t").alias("__t"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__t")) - 1
    residuals = known.select(*key, number.cast("long").alias("__at"), "__e")
    rows = fit.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
    drawn = rows.withColumn("__at", F.pmod(draw_bits(seed, *[F.col(k) for k in key], F.col("rep"), F.col("h")), F.col("__n")))
    run = Window.partitionBy(*key, "rep").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    out = drawn.join(residuals, [*key, "__at"])
    return out.select(
        *key, F.col("rep").cast("long"), F.col("h").cast("long"), (F.col("__last") + F.sum(F.col("__e") - F.col("__m")).over(run)).alias("sim")
    )


def bootstrap_forecast(
    panel: Panel, y: str, h: int, times: int = 1000, level: int = 80, seed: int = 1
) -> DataFrame:
    """Mean and interval per horizon of bootstrapped naive paths (``times`` draws a group)."""
    tail = (100 - level) / 200
    sims = bootstrap_paths(panel, y, h, times, seed)
    return sims.groupBy(*panel.key, "h").agg(
        F.avg("sim").alias("mean"),
        F.percentile("sim", F.lit(tail)).alias("lower"),
        F.percentile("sim", F.lit(1 - tail)).alias("upper"),
    )
