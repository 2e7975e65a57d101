"""Panels: many series (key) observed on a calendar or integer index.

A panel is usually the result of a roll-up, so one series has at most one row
per calendar step and its length is bounded by the calendar, however many raw
rows a hot key holds.  For series that stay long after that (raw-grain
indices), set ``block``: the window operators then cut each series into blocks
of that many rows, copy the few rows a frame needs across block edges, and
never gather a whole series in one task.  Blocks are cut by row position, so
gaps in the index change nothing; operators that need a whole series refuse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronopanel.session import written

# Rows per season cycle at each grain: fixed values.
PERIODS = {"hour": 24, "day": 7, "week": 52, "month": 12, "quarter": 4, "year": 1}

_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_DAYS = {"day": 1, "week": 7}
_STEP = {
    "hour": "interval 1 hour",
    "day": "interval 1 day",
    "week": "interval 7 days",
    "month": "interval 1 month",
    "quarter": "interval 3 months",
    "year": "interval 1 year",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_to(ts: Column | str, grain: str) -> Column:
    """Start of the grain that holds ``ts``; weeks start on Monday (ISO)."""
    if grain == "step":
        return _c(ts)
    start = F.date_trunc(grain, _c(ts))
    return start if grain == "hour" else start.cast("date")


def shift(index: Column | str, n: Column | int, grain: str) -> Column:
    """The index value ``n`` steps later."""
    n = F.lit(n) if isinstance(n, int) else n
    if grain == "step":
        return _c(index) + n
    if grain == "hour":
        return F.timestamp_add("HOUR", n.cast("int"), _c(index))
    if grain in _DAYS:
        return F.date_add(_c(index), (n * _DAYS[grain]).cast("int"))
    return F.add_months(_c(index), (n * _MONTHS[grain]).cast("int"))


def steps(start: Column | str, end: Column | str, grain: str) -> Column:
    """Number of grain steps from ``start`` to ``end``."""
    a, b = _c(start), _c(end)
    if grain == "step":
        return (b - a).cast("long")
    if grain == "hour":
        return F.timestamp_diff("HOUR", a, b).cast("long")
    if grain in _DAYS:
        return F.floor(F.datediff(b, a) / _DAYS[grain]).cast("long")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return F.floor(months / _MONTHS[grain]).cast("long")


def index_range(start: Column | str, end: Column | str, grain: str) -> Column:
    """Array of every index value from ``start`` to ``end``, both included."""
    if grain == "step":
        return F.sequence(_c(start), _c(end))
    return F.sequence(_c(start), _c(end), F.expr(_STEP[grain]))


def slot(index: Column | str, grain: str) -> Column:
    """Absolute step number of an index value: consecutive steps differ by 1 in every series."""
    if grain == "step":
        return _c(index).cast("long")
    origin = F.lit("1969-12-29")  # a Monday
    start = origin.cast("timestamp") if grain == "hour" else origin.cast("date")
    if grain in _MONTHS:
        return F.floor((F.year(_c(index)) * 12 + F.month(_c(index)) - 1) / _MONTHS[grain]).cast("long")
    return steps(start, index, grain)


@dataclass(frozen=True)
class Panel:
    """A DataFrame with a declared key, index and grain.

    ``position`` names a column that numbers the rows of each series 1, 2, …; a
    panel with blocks and without it numbers its rows where it needs to.
    """

    df: DataFrame
    key: tuple[str, ...]
    index: str
    grain: str = "step"
    block: int | None = None
    position: str | None = None

    @property
    def period(self) -> int:
        return PERIODS.get(self.grain, 1)

    def on(self, df: DataFrame, **changes) -> Panel:
        """The same declaration on another table; a position that the table lacks is forgotten."""
        out = replace(self, df=df, **changes)
        return replace(out, position=None) if out.position and out.position not in df.columns else out

    def window(self) -> WindowSpec:
        self.need_whole("a window over one series")
        return Window.partitionBy(*self.key).orderBy(self.index)

    def whole(self) -> WindowSpec:
        self.need_whole("an aggregate over one series in a window")
        return Window.partitionBy(*self.key)

    def written(self, label: str) -> Panel:
        """The same panel, stored once in the shared folder."""
        return self.on(written(self.df, label))

    def duplicates(self) -> DataFrame:
        """(key, index) pairs that occur more than once; empty for a valid panel."""
        return self.df.groupBy(*self.key, self.index).count().filter("count > 1")

    def require_unique(self) -> Panel:
        """Raise when a (key, index) pair is repeated."""
        bad = self.duplicates().take(1)
        if bad:
            raise ValueError(f"panel index is not unique: {bad[0].asDict()}")
        return self

    def placed(self, name: str = "__row") -> Panel:
        """The panel with a column of row positions, which later blocks share."""
        if self.position:
            return self
        return self.on(numbered(self.df, self.key, [self.index], name), position=name)

    def need_whole(self, operator: str) -> None:
        """Raise when the panel asks for blocks and the operator needs whole series."""
        if self.block is not None:
            raise ValueError(f"{operator} needs whole series and cannot work in blocks")

    def with_position(self, name: str = "t") -> Panel:
        """Add the 1-based row position of each row in its series."""
        if self.position:
            return self.on(self.df.withColumn(name, F.col(self.position).cast("long")))
        if self.block is not None:
            return self.on(numbered(self.df, self.key, [self.index], name), position=name)
        return self.on(self.df.withColumn(name, F.row_number().over(self.window()).cast("long")))

    def with_season(self, name: str = "season", period: int | None = None, t: str = "t") -> Panel:
        """Add the 0-based season position of a column of positions."""
        m = period or self.period
        return self.on(self.df.withColumn(name, F.pmod(F.col(t) - 1, F.lit(m)).cast("long")))


FrameExpr = Callable[[WindowSpec], Column]


def framed(panel: Panel, exprs: dict[str, FrameExpr], before: int = 0, after: int = 0) -> Panel:
    """Add columns that look at most ``before`` rows back and ``after`` ahead.

    With blocks, each row is copied to the blocks whose frames reach it, by row
    position; the copies go once the frames are computed.
    """
    if panel.block is None:
        w = panel.window()
        return panel.on(panel.df.withColumns({n: f(w) for n, f in exprs.items()}))
    p = panel.placed()
    size, t = F.lit(panel.block), F.col(p.position)

    def block_of(t: Column) -> Column:
        return F.floor((t - 1) / size)

    df = p.df.withColumn("__b", F.explode(F.sequence(block_of(t - after), block_of(t + before))))
    w = Window.partitionBy(*panel.key, "__b").orderBy(p.position)
    df = df.withColumns({n: f(w) for n, f in exprs.items()})
    df = df.where(F.col("__b") == block_of(t)).drop("__b")
    return panel.on(df if panel.position else df.drop(p.position))


def fill_gaps(panel: Panel, fill: dict[str, object] | None = None) -> Panel:
    """Insert the missing index values between each key's first and last row.

    Each row is stretched up to its successor, so no calendar table and no join
    is needed, and the key partitioning is the one later windows use.  Positions
    known before do not hold afterwards.
    """
    idx, grain = panel.index, panel.grain
    measures = [c for c in panel.df.columns if c not in (*panel.key, idx, panel.position)]
    last = F.coalesce(shift("__next", -1, grain), F.col(idx))
    out = framed(panel, {"__next": lambda w: F.lead(idx).over(w)}, after=1).df.select(
        *panel.key,
        F.explode(index_range(idx, last, grain)).alias("__index"),
        F.col(idx).alias("__from"),
        *measures,
    )
    seen = F.col("__index") == F.col("__from")
    out = out.select(
        *panel.key,
        F.col("__index").alias(idx),
        *[F.when(seen, F.col(m)).alias(m) for m in measures],
    )
    if fill:
        out = out.fillna(fill)
    return panel.on(out, position=None)


def reindex(panel: Panel, name: str, spread: bool = False) -> Panel:
    """Replace an irregular index by 1..n per key.

    ``spread`` numbers the rows of a key in many tasks, for raw rows whose keys
    may be hot; otherwise one window numbers a series in one task.
    """
    if spread or panel.block is not None:
        df = numbered(panel.df, panel.key, [panel.index], name)
    else:
        df = panel.df.withColumn(name, F.row_number().over(panel.window()).cast("long"))
    return panel.on(df, index=name, grain="step", position=name)


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row numbers 1, 2, … per key in ``order``, nulls first, whatever a key or a value of the order holds.

    Rows are dealt to ranges of (key, order) with about as many rows each and
    stored once, so that ranges and their row ids hold for good.  A row's place is
    its id within the range, plus the rows that earlier ranges have of its key: one
    count for each key and range.  A hot key spreads over as many ranges as its rows
    fill; no window sees more than one row for each range of a key.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = [*key, *order]
    ranged = df.repartitionByRange(parts, *places).sortWithinPartitions(*places)
    ranged = written(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    # The upper bits of an id are the range, the lower ones the row in it.
    ranged = ranged.withColumn("__range", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy(*key, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1)
    offsets = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__range").alias("__in"), "__off")
    # A null key is a series too.
    same = F.col("__range") == F.col("__in")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = ranged.join(offsets, same)
    return out.select(*df.columns, (F.col("__place") + F.col("__off")).alias(name))


def future_rows(panel: Panel, n: int) -> DataFrame:
    """The next ``n`` empty rows of every key, with the horizon ``h``."""
    ends = panel.df.groupBy(*panel.key).agg(F.max(panel.index).alias("__end"))
    out = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return out.select(
        *panel.key,
        F.col("h").cast("long").alias("h"),
        shift("__end", F.col("h"), panel.grain).alias(panel.index),
    )
