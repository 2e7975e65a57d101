"""Forecast accuracy, interval and distribution scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.tails import Z_LEVEL, normal_cdf, normal_pdf, normal_quantile
from chronopanel.operators.windows import framed
from chronopanel.panel import Panel


def accuracy(
    pairs: DataFrame,
    by: Sequence[str],
    actual: str = "actual",
    pred: str = "mean",
    order: str = "h",
    scale: DataFrame | None = None,
    scale_on: Sequence[str] = (),
) -> DataFrame:
    """ME RMSE MAE MPE MAPE ACF1 per group; MASE and RMSSE when a scale is given.

    Percentage errors leave zero actuals out.
    """
    e, a = F.col("__e"), F.col(actual)
    df = pairs.withColumn("__e", a - F.col(pred)).where(e.isNotNull())
    group = Window.partitionBy(*by)
    df = df.withColumn("__c", e - F.avg(e).over(group))
    df = df.withColumn("__cl", F.lag("__c").over(group.orderBy(order)))
    pct = F.try_divide(e * 100, a)
    out = df.groupBy(*by).agg(
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(pct).alias("mpe"),
        F.avg(F.abs(pct)).alias("mape"),
        F.try_divide(F.sum(F.col("__c") * F.col("__cl")), F.sum(F.col("__c") * F.col("__c"))).alias("acf1"),
    )
    if scale is None:
        return out
    out = out.join(scale, list(scale_on), "left")
    return out.withColumn("mase", F.try_divide("mae", "mean_abs")).withColumn(
        "rmsse", F.try_divide(F.col("rmse"), F.sqrt("mean_sq"))
    ).drop("mean_abs", "mean_sq")


def naive_scale(train: Panel, y: str, period: int | None = None) -> DataFrame:
    """Mean absolute and squared seasonal-naive error of the training rows."""
    m = period or train.period
    v = F.col(y).cast("double")
    p = framed(train, {"__d": lambda w: v - F.lag(v, m).over(w)}, m)
    d = F.col("__d")
    return p.df.groupBy(*train.key).agg(
        F.avg(F.abs(d)).alias("mean_abs"), F.avg(d * d).alias("mean_sq")
    )


def rmse(df: DataFrame, by: Sequence[str], actual: str, preds: Sequence[str]) -> DataFrame:
    """RMSE of several prediction columns; pairs with a NULL are left out."""
    def one(p: str) -> Column:
        return F.sqrt(F.avg(F.pow(F.col(actual) - F.col(p), 2))).alias(p)

    return df.groupBy(*by).agg(*[one(p) for p in preds])


def quantile_score(actual: Column, mean: Column, sd: Column, p: float) -> Column:
    """Twice the pinball loss of the p-quantile of a normal forecast."""
    q = mean + sd * normal_quantile(p)
    return 2 * F.when(actual < q, (1 - p) * (q - actual)).otherwise(p * (actual - q))


def winkler_score(actual: Column, mean: Column, sd: Column, level: int) -> Column:
    """Interval width plus a penalty for an actual outside it."""
    z, alpha = Z_LEVEL[level], 1 - level / 100
    lower, upper = mean - z * sd, mean + z * sd
    width = upper - lower
    return (
        F.when(actual < lower, width + 2 / alpha * (lower - actual))
        .when(actual > upper, width + 2 / alpha * (actual - upper))
        .otherwise(width)
    )


def crps(actual: Column, mean: Column, sd: Column) -> Column:
    """Continuous ranked probability score of a normal forecast."""
    z = (actual - mean) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def skill(scores: DataFrame, by: Sequence[str], score: str, benchmark: str) -> DataFrame:
    """1 - score / benchmark score within each group of models."""
    base = F.max(F.when(F.col("model") == benchmark, F.col(score))).over(Window.partitionBy(*by))
    return scores.withColumn("skill", 1 - F.try_divide(F.col(score), base))


def best_models(scores: DataFrame, by: Sequence[str], score: str = "rmse") -> DataFrame:
    """Models with the smallest score per group; ties are kept."""
    return scores.withColumn(
        "__r", F.rank().over(Window.partitionBy(*by).orderBy(score))
    ).where("__r = 1").drop("__r")


def top_models(scores: DataFrame, by: Sequence[str], n: int, score: str = "rmse") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(score, "model")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
