"""Exact order statistics without gathering a group in one task.

The value axis is cut into zones of equal ratio, ``STEPS`` to a factor of two, so a
value tells its zone without a look at the others.  The first scan counts and sums
per key and zone, on the map side first; this zone table has a few thousand rows a
key, however many rows the key has, and running counts over it tell in which zone a
rank lies.  The second scan takes only rows in such zones, counts equal values, and
ranks them inside their zone.

One zone table serves quantiles, trimmed sums and the median of distances from the
median: a zone's distances lie between two bounds even before the median is known,
which leaves the few zones that can hold their middle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.panel import Panel

#: Zones in a factor of two, and what keeps the numbers of positive zones positive.
STEPS, LIFT = 4096, 1100
NAN_ZONE = 1 << 40


def _zone(x: Column) -> Column:
    """Number of a value's zone: 0 for zero, negative for negative values; NaN comes last."""
    size = F.floor((F.least(F.log2(F.abs(x)), F.lit(float(LIFT))) + LIFT) * STEPS) + 1
    return F.when(F.isnan(x), F.lit(NAN_ZONE)).when(x == 0, F.lit(0)).when(x < 0, -size).otherwise(size).cast("long")


def _edges(zone: Column) -> tuple[Column, Column]:
    """Bounds of a zone's values, a little wide for rounding."""
    size = F.abs(zone)
    inner = F.pow(F.lit(2.0), (size - 1) / STEPS - LIFT) * (1 - 1e-9)
    outer = F.pow(F.lit(2.0), size / STEPS - LIFT) * (1 + 1e-9)
    none = F.lit(0.0)
    low = F.when(zone == 0, none).when(zone < 0, -outer).otherwise(inner)
    high = F.when(zone == 0, none).when(zone < 0, -inner).otherwise(outer)
    return low, high


def _distances(zone: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """Bounds of the distances between a zone's values and a middle from ``least`` to ``most``."""
    low, high = _edges(zone)
    return F.greatest(F.lit(0.0), low - most, least - high), F.greatest(high - least, most - low)


def _place(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Lower and upper rank of the linearly interpolated (type 7) quantile, and the share of the upper."""
    h = (n - 1) * F.lit(float(p))
    lower = (F.floor(h) + 1).cast("long")
    return lower, F.least(lower + 1, n), h - F.floor(h)


def _ranks(n: Column, probs: Sequence[float], trim: float | None) -> dict[str, Column]:
    """All ranks that are looked up, by name."""
    out = {}
    for i, p in enumerate(probs):
        out[f"l{i}"], out[f"u{i}"], _ = _place(n, p)
    if trim is not None:
        cut = F.floor(n * F.lit(trim)).cast("long")
        out |= {"cut": cut, "top": n - cut}
    return out


def order_statistics(
    df: DataFrame, key: Sequence[str], x: str, probs: Sequence[float], names: Sequence[str], trim: float | None = None, mad: str | None = None, few_keys: bool = False
) -> DataFrame:
    """Per key: ``n``, exact type-7 quantiles, with ``trim`` the mean ``trimmed``, with ``mad`` the median distance from the median.

    Two scans.  ``few_keys`` says that the keys are known to be few, so that what is
    looked up of them may be broadcast.
    """
    if mad and 0.5 not in probs:
        raise ValueError("the median distance needs the median among the probabilities")
    rows = df.where(F.col(x).isNotNull()).select(*key, F.col(x).cast("double").alias("__x")).withColumn("__z", _zone(F.col("__x")))
    own = Window.partitionBy(*key)
    upward = own.orderBy("__z").rowsBetween(Window.unboundedPreceding, 0)
    n, c, zone = F.col("n"), F.col("c"), F.col("__z")

    zones = rows.groupBy(*key, "__z").agg(F.count(F.lit(1)).alias("c"), F.sum("__x").alias("total"), F.min("__x").alias("least"), F.max("__x").alias("most"))
    zones = zones.select("*", F.sum("c").over(own).alias("n"), F.sum("c").over(upward).alias("hi"), F.sum("total").over(upward).alias("upto"))
    zones = zones.withColumn("lo", F.col("hi") - c + 1).withColumn("under", F.col("upto") - F.col("total"))

    def here(rank: Column) -> Column:
        return (F.col("lo") <= rank) & (rank <= F.col("hi"))

    looked = [F.max(F.when(here(r), F.struct(zone.alias("z"), "lo", "under"))).alias(name) for name, r in _ranks(n, probs, trim).items()]
    if mad:
        lower, upper, _ = _place(n, 0.5)
        zones = zones.withColumn("m_lo", F.max(F.when(here(lower), F.col("least"))).over(own)).withColumn("m_hi", F.max(F.when(here(upper), F.col("most"))).over(own))
        near, far = _distances(zone, F.col("m_lo"), F.col("m_hi"))
        zones = zones.withColumn("near", near).withColumn("far", far)
        by = {d: F.sum("c").over(own.orderBy(d).rangeBetween(Window.unboundedPreceding, 0)) for d in ("near", "far")}
        zones = zones.withColumns({f"{d}_upto": column for d, column in by.items()})
        zones = zones.withColumn("d_lo", F.min(F.when(F.col("near_upto") >= lower, F.col("near"))).over(own))
        zones = zones.withColumn("d_hi", F.min(F.when(F.col("far_upto") >= upper, F.col("far"))).over(own))
        looked += [F.max(d).alias(d) for d in ("m_lo", "m_hi", "d_lo", "d_hi")]
        looked.append(F.sum(F.when(F.col("far") < F.col("d_lo"), c).otherwise(0)).alias("closer"))
    brief = zones.groupBy(*key).agg(F.max("n").alias("n"), *looked)
    brief = brief.select(*key, F.struct(*[f for f in brief.columns if f not in key]).alias("b"))

    n = F.col("b.n")
    ranks = _ranks(n, probs, trim)
    wanted = F.array_contains(F.array(*[F.col(f"b.{name}.z") for name in ranks]), zone)
    middle = F.lit(False)
    if mad:
        near, far = _distances(zone, F.col("b.m_lo"), F.col("b.m_hi"))
        middle = (far >= F.col("b.d_lo")) & (near <= F.col("b.d_hi"))
    kept = rows.join(F.broadcast(brief) if few_keys else brief, list(key)).where(wanted | middle)
    kept = kept.groupBy(*key, "__z", "__x").agg(F.count(F.lit(1)).alias("c"), F.first("b").alias("b"))
    inside = Window.partitionBy(*key, "__z").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("__x")
    kept = kept.withColumn("upto", F.sum("c").over(inside)).withColumn("sum", F.sum(v * c).over(inside))

    def at(name: str) -> tuple[Column, Column]:
        """Whether a row holds the rank, and the rows before it."""
        before = F.col(f"b.{name}.lo") - 1 + F.col("upto") - c
        return (zone == F.col(f"b.{name}.z")) & (ranks[name] > before) & (ranks[name] <= before + c), before

    def value(name: str) -> Column:
        return F.max(F.when(at(name)[0], v))

    def sum_of_least(name: str) -> Column:
        hit, before = at(name)
        part = F.col(f"b.{name}.under") + F.col("sum") - v * c + v * (ranks[name] - before)
        # The rank 0 stands in no zone.
        return F.coalesce(F.max(F.when(hit, part)), F.lit(0.0))

    def between(low: Column, high: Column, share: Column) -> Column:
        return low + share * (high - low)

    share = {name: F.max(_place(n, p)[2]) for name, p in zip(names, probs)}
    out = [between(value(f"l{i}"), value(f"u{i}"), share[name]).alias(name) for i, name in enumerate(names)]
    if trim is not None:
        size = F.max(ranks["top"] - ranks["cut"])
        out.append(((sum_of_least("top") - sum_of_least("cut")) / size).alias("trimmed"))
    if mad:
        i = list(probs).index(0.5)
        median = between(value(f"l{i}").over(own), value(f"u{i}").over(own), F.max(_place(n, 0.5)[2]).over(own))
        kept = kept.withColumn("away", F.when(middle, F.abs(v - median)))
        closer = own.orderBy("away").rangeBetween(Window.unboundedPreceding, 0)
        kept = kept.withColumn("rank", F.sum(F.when(middle, c).otherwise(0)).over(closer) + F.col("b.closer"))
        lower, upper, part = _place(n, 0.5)
        held = [F.min(F.when(middle & (F.col("rank") >= r), F.col("away"))) for r in (lower, upper)]
        out.append(between(*held, F.max(part)).alias(mad))
    return kept.groupBy(*key).agg(F.max(n).alias("n"), *out)


def quantiles(
    df: DataFrame, key: Sequence[str], x: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact type-7 quantiles of ``x`` per key, one column each."""
    return order_statistics(df, key, x, probs, names).drop("n")


def describe(df: DataFrame, columns: Sequence[str], trim: float = 0.1) -> DataFrame:
    """One row of summary statistics per numeric column.

    Three scans: moments, zones, and the rows of the zones that hold a wanted rank.
    Moments have their own pass, as generated code over the columns side by side.
    Per-column tables have one row per column, which is what makes broadcasting
    them safe.
    """

    def moments(c: str) -> Column:
        x = F.col(c).cast("double")
        n = F.count(x)
        shrink = (n - 1) / n
        return F.struct(
            F.lit(c).alias("variable"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("sd"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            (F.max(x) - F.min(x)).alias("range"),
            (F.skewness(x) * F.pow(shrink, 1.5)).alias("skew"),
            ((F.kurtosis(x) + 3) * F.pow(shrink, 2) - 3).alias("kurtosis"),
            (F.stddev_samp(x) / F.sqrt(n)).alias("se"),
        )

    stats = df.agg(F.array(*[moments(c) for c in columns]).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.variable", "p.x")
    order = order_statistics(long, ["variable"], "x", [0.5, 0.25, 0.75], ["median", "q25", "q75"], trim, "__mad", few_keys=True)
    out = stats.join(F.broadcast(order), "variable")
    return out.withColumn("mad", F.col("__mad") * 1.4826).drop("__mad")


def winsorise(panel: Panel, x: str, d: float) -> Panel:
    """Clamp to the (d, 1-d) quantiles of each key; adds ``clamped`` and ``clipped_off``."""
    bounds = quantiles(panel.df, panel.key, x, [d, 1 - d], ["__lb", "__ub"])
    df = panel.df.join(bounds, list(panel.key))
    df = df.withColumn(
        "clamped",
        F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x).cast("double"), "__lb"), "__ub")),
    )
    return panel.on(df.withColumn("clipped_off", F.col(x) - F.col("clamped")).drop("__lb", "__ub"))


def log_excess(panel: Panel, clipped: str = "clipped_off") -> DataFrame:
    """log(|difference| + 1) of the clamped values that did change."""
    out = panel.df.select(
        *panel.key, panel.index, F.log(F.abs(F.col(clipped)) + 1).alias("log_diff")
    )
    return out.where(F.col("log_diff") != 0)
