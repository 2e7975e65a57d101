"""The panels the queries work on, over the star-schema tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import aggregate, joins
from chronopanel.panel import Panel, fill_gaps, floor_to
from chronopanel.session import dealt, written
from chronopanel.sources.calendar import holiday_calendar

Tables = Callable[[str], DataFrame]


def _filled(name: str, table_sql: str, keys: str, idx: str, step: str, cast: str = "DATE") -> str:
    using = f"{keys}, {idx}"
    return f"""
{name}_raw AS ({table_sql}),
{name}_rng AS (SELECT {keys}, CAST(unnest(generate_series(CAST(min({idx}) AS TIMESTAMP), CAST(max({idx}) AS TIMESTAMP),
  INTERVAL {step})) AS {cast}) AS {idx} FROM {name}_raw GROUP BY {keys}),
{name}_fill AS (SELECT * FROM {name}_rng LEFT JOIN {name}_raw USING ({using})),
{name} AS (SELECT {using}, coalesce(y, 0) AS y,
  row_number() OVER (PARTITION BY {keys} ORDER BY {idx}) AS t,
  count(*) OVER (PARTITION BY {keys}) AS n FROM {name}_fill)"""


def raw_weekly(t: Tables) -> Panel:
    """Orders per priority and ISO week."""
    return aggregate.roll_up(
        t("orders"), "o_orderdate", "week", ["o_orderpriority"], "week", y=F.count(F.lit(1))
    )


def weekly(t: Tables) -> Panel:
    return fill_gaps(raw_weekly(t), {"y": 0})


OW_RAW = (
    "SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS y "
    "FROM orders GROUP BY 1, 2"
)
OW = _filled("ow", OW_RAW, "o_orderpriority", "week", "7 DAY")


def daily(t: Tables) -> Panel:
    """Orders per status and day."""
    raw = aggregate.roll_up(
        t("orders"), "o_orderdate", "day", ["o_orderstatus"], "day", y=F.count(F.lit(1))
    )
    return fill_gaps(raw, {"y": 0})


OD = _filled(
    "od",
    "SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS y FROM orders GROUP BY 1, 2",
    "o_orderstatus",
    "day",
    "1 DAY",
)


def monthly(t: Tables) -> Panel:
    """Shipped quantity per return flag and line status, by month."""
    raw = aggregate.roll_up(
        t("lineitem"),
        "l_shipdate",
        "month",
        ["l_returnflag", "l_linestatus"],
        "month",
        y=F.sum("l_quantity"),
    )
    return fill_gaps(raw, {"y": 0.0})


LM = _filled(
    "lm",
    "SELECT l_returnflag, l_linestatus, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, "
    "sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2, 3",
    "l_returnflag, l_linestatus",
    "month",
    "1 MONTH",
)


def raw_hourly(t: Tables) -> Panel:
    return aggregate.roll_up(t("events"), "ts", "hour", ["event_type"], "hour", y=F.count(F.lit(1)))


def hourly(t: Tables) -> Panel:
    """Events per type and hour."""
    return fill_gaps(raw_hourly(t), {"y": 0})


EH_RAW = "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS y FROM events GROUP BY 1, 2"
EH = _filled("eh", EH_RAW, "event_type", "hour", "1 HOUR", "TIMESTAMP")


def parts_monthly(t: Tables) -> Panel:
    """Shipped quantity per part and month: many short, gappy series.

    Both the rolled up and the gap-free rows are dealt by their number, the latter
    stored once, so that a task holds the same number of series' rows at any size.
    """
    raw = aggregate.roll_up(
        t("lineitem"), "l_shipdate", "month", ["l_partkey"], "month", y=F.sum("l_quantity")
    )
    # A roll-up has no more rows than its table, whose files tell their number.
    raw = raw.on(dealt(raw.df, raw.key, t("lineitem").count()))
    p = fill_gaps(raw, {"y": 0.0}).written("parts")
    return p.on(dealt(p.df, p.key, p.df.count()))


PM = _filled(
    "pm",
    "SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS y "
    "FROM lineitem GROUP BY 1, 2",
    "l_partkey",
    "month",
    "1 MONTH",
)


def weekly_classes(t: Tables) -> Panel:
    """Weekly counts per priority with sub-counts and a flag made from a summed one."""
    winter = F.month("o_orderdate").isin(12, 1, 2)
    p = aggregate.roll_up(
        t("orders"),
        "o_orderdate",
        "week",
        ["o_orderpriority"],
        "week",
        y=F.count(F.lit(1)),
        large=F.sum(F.when(F.col("o_totalprice") > 300000, 1).otherwise(0)),
        failed=F.sum((F.col("o_orderstatus") == "F").cast("int")),
        ice=F.sum(F.when((F.col("o_orderstatus") == "P") & winter, 1).otherwise(0)),
    )
    return p.on(p.df.withColumn("ice_present", F.when(F.col("ice") > 0, 1).otherwise(0).cast("long")))


CLASSES = """
cls AS (SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS y,
  CAST(sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS BIGINT) AS large,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CASE WHEN o_orderstatus = 'P' AND month(o_orderdate) IN (12, 1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS ice,
  CAST(CASE WHEN sum(CASE WHEN o_orderstatus = 'P' AND month(o_orderdate) IN (12, 1, 2) THEN 1 ELSE 0 END) > 0
    THEN 1 ELSE 0 END AS BIGINT) AS ice_present
  FROM orders GROUP BY 1, 2)"""


def calendar_days(t: Tables) -> DataFrame:
    """One row per day of the order span and four weeks beyond: holiday, home game and policy flags."""
    span = t("orders").agg(
        F.min("o_orderdate").cast("date").alias("first"), F.date_add(F.max("o_orderdate").cast("date"), 28).alias("last")
    )
    days = holiday_calendar(span, "first", "last")
    autumn_saturday = (F.weekday("date") == 5) & F.month("date").between(9, 11)
    closed = F.col("date").between(F.lit("1998-05-04").cast("date"), F.lit("1999-06-30").cast("date"))
    return days.withColumns({"home": autumn_saturday.cast("int"), "covid": closed.cast("int")})


def weekly_covariates(t: Tables) -> list[DataFrame]:
    """Three covariate tables per week: home games, a policy period, holidays."""
    # A few thousand rows that three tables share: stored once.
    days = written(calendar_days(t).withColumn("week", floor_to("date", "week")), "calendar")
    return [
        days.groupBy("week").agg(F.sum("home").alias("home")),
        days.where("covid = 1").groupBy("week").agg(F.max("covid").cast("long").alias("covid")),
        days.groupBy("week").agg(F.max("holiday").cast("long").alias("holiday")),
    ]


CAL = """
span AS (SELECT CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) + 28 AS last FROM orders),
dd AS (SELECT CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
yy AS (SELECT DISTINCT year(date) AS yr FROM dd),
e1 AS (SELECT yr, yr % 19 AS a, yr // 100 AS b, yr % 100 AS c FROM yy),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
easter AS (SELECT yr, make_date(yr, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS sunday FROM e4),
cal AS (SELECT date, CAST(CASE
    WHEN (month(date) = 1 AND day(date) = 1) OR (month(date) = 7 AND day(date) = 4) OR (month(date) = 12 AND day(date) = 25) THEN 1
    WHEN month(date) = 1 AND isodow(date) = 1 AND day(date) BETWEEN 15 AND 21 THEN 1
    WHEN month(date) = 5 AND isodow(date) = 1 AND day(date) >= 25 THEN 1
    WHEN month(date) = 9 AND isodow(date) = 1 AND day(date) <= 7 THEN 1
    WHEN month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28 THEN 1
    WHEN date = sunday - 47 OR date = sunday - 2 THEN 1 ELSE 0 END AS BIGINT) AS holiday,
  CAST(CASE WHEN isodow(date) = 6 AND month(date) BETWEEN 9 AND 11 THEN 1 ELSE 0 END AS BIGINT) AS home,
  CAST(CASE WHEN date BETWEEN DATE '1998-05-04' AND DATE '1999-06-30' THEN 1 ELSE 0 END AS BIGINT) AS covid
  FROM dd JOIN easter ON year(date) = yr)"""

COV = """
cov AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(home) AS BIGINT) AS home,
  max(holiday) AS holiday, max(covid) AS covid FROM cal GROUP BY 1)"""


def model_panel(t: Tables) -> Panel:
    """Weekly counts per priority, gap-free, with the covariates joined."""
    p = weekly_classes(t)
    p = p.on(p.df.select("o_orderpriority", "week", "y", "ice_present"))
    base = fill_gaps(p, {"y": 0, "ice_present": 0})
    df = joins.with_covariates(base.df, weekly_covariates(t), "week")
    return base.on(df)


MODEL = "\n,".join(
    [
        CLASSES,
        CAL,
        COV,
        """
mp_rng AS (SELECT o_orderpriority, CAST(unnest(generate_series(CAST(min(week) AS TIMESTAMP), CAST(max(week) AS TIMESTAMP),
  INTERVAL 7 DAY)) AS DATE) AS week FROM cls GROUP BY 1),
mp AS (SELECT o_orderpriority, week, coalesce(y, 0) AS y, coalesce(ice_present, 0) AS ice_present,
  coalesce(home, 0) AS home, coalesce(covid, 0) AS covid, coalesce(holiday, 0) AS holiday,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY week) AS t,
  count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM mp_rng LEFT JOIN cls USING (o_orderpriority, week) LEFT JOIN cov USING (week))""",
    ]
)
