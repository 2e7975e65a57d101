"""Ordered train/test splits and expanding-window validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.shape import over_proportions
from chronopanel.panel import Panel


def _parts(panel: Panel, k) -> Panel:
    df = panel.df.withColumn("__k", k.cast("long"))
    df = df.withColumn("part", F.when(F.col("t") > F.col("__k"), "test").otherwise("train"))
    return panel.on(df.withColumn("h", F.when(F.col("part") == "test", F.col("t") - F.col("__k"))).drop("__k"))


def _with_size(panel: Panel) -> Panel:
    """Adds ``t`` and the series length ``__n``."""
    p = panel.with_position("t")
    if panel.block is None:
        return p.on(p.df.withColumn("__n", F.count(F.lit(1)).over(panel.whole())))
    sizes = panel.df.groupBy(*panel.key).agg(F.count(F.lit(1)).alias("__n"))
    return p.on(p.df.join(sizes, list(panel.key)))


def split_by_share(panel: Panel, p: float) -> Panel:
    """The last share ``p`` of each series is the test part; floor((1-p)n) rows train.

    Adds position ``t``, ``part`` and the test horizon ``h``.  Shares of 0 and 1
    leave one side empty.
    """
    if not 0 <= p <= 1:
        raise ValueError("the test share must lie in [0, 1]")
    q = _with_size(panel)
    out = _parts(q, F.floor((1 - F.lit(float(p))) * F.col("__n")))
    return out.on(out.df.drop("__n"))


def split_last(panel: Panel, d: float) -> Panel:
    """The last round(n d) rows are the test part, halves rounded to even."""
    q = _with_size(panel)
    out = _parts(q, F.col("__n") - F.bround(F.col("__n") * F.lit(float(d))))
    return out.on(out.df.drop("__n"))


def split_last_rows(panel: Panel, k: int) -> Panel:
    """The last ``k`` rows are the test part."""
    q = _with_size(panel)
    out = _parts(q, F.col("__n") - F.lit(k))
    return out.on(out.df.drop("__n"))


def split_sweep(panel: Panel, ps: Sequence[float]) -> Panel:
    """One split per proportion; ``p`` becomes part of the key, so nothing loops."""
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("the test share must lie in [0, 1]")
    q = _with_size(panel)
    wide = q.on(over_proportions(q.df, ps, "p"), key=("p", *panel.key))
    out = _parts(wide, F.floor((1 - F.col("p")) * F.col("__n")))
    return out.on(out.df.drop("__n"))


def train(split: Panel) -> Panel:
    return split.on(split.df.where("part = 'train'").drop("h"))


def test(split: Panel) -> Panel:
    return split.on(split.df.where("part = 'test'"))


def date_window(panel: Panel, in_train, in_test) -> Panel:
    """Split by date predicates; rows in neither window are dropped."""
    part = F.when(in_train, "train").when(in_test, "test")
    return panel.on(panel.df.withColumn("part", part).where(F.col("part").isNotNull()))


def expanding_one_step(panel: Panel, y: str, init: int = 3) -> DataFrame:
    """One-step forecasts of every expanding fold, without building the folds.

    A fold that ends at row r needs only the first value, the value at r and
    the running mean, so each fold costs one row.
    """
    p = panel.with_position("t")
    w = panel.window()
    v = F.col(y).cast("double")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    origin = F.col("t") - 1
    df = p.df.select(
        *panel.key,
        panel.index,
        "t",
        v.alias("actual"),
        F.lag(v).over(w).alias("naive"),
        F.avg(v).over(past).alias("mean"),
        F.first(v).over(past).alias("__first"),
    ).where(origin >= init)
    drift = F.col("naive") + (F.col("naive") - F.col("__first")) / (origin - 1)
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("model"), c.alias("pred"))
            for m, c in {"mean": F.col("mean"), "naive": F.col("naive"), "drift": drift}.items()
        ]
    )
    out = df.withColumn("__c", F.explode(cells))
    return out.select(*panel.key, origin.alias("origin"), "__c.model", "actual", "__c.pred")


def expanding_sums(panel: Panel, columns: Sequence[str], init: int, step: int) -> DataFrame:
    """Running sums at every fold's last row: (key, origin, n, sums, products).

    A fold's rows are all rows up to its origin, so its count, sums and products
    (upper triangle) are running sums read at the origin: one row a fold, and a
    model on them costs what its sums cost.  Rows with a NULL column count for nothing.
    """
    p = panel.with_position("t")
    upto = p.window().rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.col(c).cast("double") for c in columns]
    full = cols[0].isNotNull()
    for c in cols[1:]:
        full = full & c.isNotNull()

    def running(value):
        return F.coalesce(F.sum(F.when(full, value)).over(upto), F.lit(0.0))

    products = [running(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = p.df.select(
        *panel.key, F.col("t").cast("long").alias("origin"), F.count(F.when(full, 1)).over(upto).alias("n"),
        F.array(*map(running, cols)).alias("sums"), F.array(*products).alias("products"),
    )
    return sums.where((F.col("origin") >= init) & ((F.col("origin") - init) % step == 0))
