"""Joins, roll-ups, reshaping, sorting and binding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.operators import aggregate, joins, quantiles, shape
from chronopanel.operators.windows import difference
from chronopanel.panel import Panel, floor_to, future_rows
from chronopanel.plans.inputs import (
    CAL, CLASSES, COV, EH, LM, OD, OW, calendar_days, daily, hourly, monthly, weekly,
    weekly_classes, weekly_covariates,
)
from chronopanel.plans.registry import d, query, r, with_ctes

rounded = r
WEEK_COLS = "y, large, failed, ice, ice_present"


@query(
    "J1_covariate_join",
    with_ctes(CLASSES, CAL, COV, select=f"""SELECT o_orderpriority, {d('week')} AS week, {WEEK_COLS},
    coalesce(home, 0) AS home, coalesce(covid, 0) AS covid, coalesce(holiday, 0) AS holiday FROM cls LEFT JOIN cov USING (week)"""),
)
def j1(t):
    """Weekly fact panel with three covariate tables, missing values as 0."""
    return joins.with_covariates(weekly_classes(t).df, weekly_covariates(t), "week")


@query(
    "J2_full_outer_merge",
    with_ctes(CLASSES, CAL, COV,
              select=f"""SELECT coalesce(o_orderpriority, '0') AS o_orderpriority, {d('coalesce(l.week, c.week)')} AS week, coalesce(y, 0) AS y,
    coalesce(home, 0) AS home, CASE WHEN covid = 1 THEN 1 ELSE 0 END::BIGINT AS covid, coalesce(holiday, 0) AS holiday
    FROM cls l FULL OUTER JOIN cov c ON l.week = c.week"""),
)
def j2(t):
    """Full outer merge: the weeks after the last order, which only the covariates have, become the phantom series '0'."""
    facts = weekly_classes(t).df.select("o_orderpriority", "week", "y")
    return joins.outer_merge(facts, weekly_covariates(t), "week", "o_orderpriority")


@query(
    "J2_without_phantom",
    with_ctes(CLASSES, CAL, COV,
              select=f"""SELECT o_orderpriority, {d('week')} AS week, y, coalesce(home, 0) AS home,
    coalesce(covid, 0) AS covid, coalesce(holiday, 0) AS holiday FROM cls LEFT JOIN cov USING (week)"""),
)
def j2b(t):
    facts = weekly_classes(t).df.select("o_orderpriority", "week", "y")
    return joins.outer_merge(facts, weekly_covariates(t), "week", "o_orderpriority", drop_phantom=True)


YEARLY = """
yl AS (SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS BIGINT) AS year, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3),
yo AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS orders FROM orders GROUP BY 1)"""


@query(
    "J3_rolled_index_join",
    with_ctes(YEARLY, select=f"SELECT l_returnflag, l_linestatus, year, {r('qty')} AS qty, orders, {r('qty / orders * 100')} AS adjusted FROM yl LEFT JOIN yo USING (year)"),
)
def j3(t):
    """Yearly roll-up joined with a yearly reference table and deflated by it."""
    years = t("lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("qty"))
    ref = t("orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return years.join(ref, "year", "left").withColumn("adjusted", F.col("qty") / F.col("orders") * 100)


@query(
    "J4_drill_back",
    """WITH a AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2),
    s AS (SELECT * FROM a WHERE m = (SELECT max(m) FROM a))
    SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM s JOIN lineitem USING (l_returnflag, l_linestatus)""",
)
def j4(t):
    """Selected series joined back to all of their observations."""
    li = t("lineitem")
    key = ["l_returnflag", "l_linestatus"]
    a = li.groupBy(*key).agg(F.avg("l_quantity").alias("m"))
    top = a.where(F.col("m") == a.agg(F.max("m")).scalar()).drop("m")
    return joins.drill_back(top, li.select(*key, "l_orderkey", "l_linenumber"), key)


@query(
    "J5_attach_residuals",
    with_ctes(LM, select=f"""SELECT l_returnflag, l_linestatus, {d('month')} AS month, {r('y')} AS y,
    {r('y - lag(y) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY month)')} AS resid FROM lm"""),
)
def j5(t):
    p = monthly(t)
    res = difference(p, "y", [1], "resid").df.select(*p.key, p.index, "resid")
    return p.df.join(res, [*p.key, p.index], "left")


@query(
    "J7_scenarios",
    with_ctes(OW, """fut AS (SELECT o_orderpriority, max(week) AS w FROM ow GROUP BY 1)""",
              select=f"""SELECT o_orderpriority, CAST(h AS BIGINT) AS h, {d('w + CAST(7 * h AS INTEGER)')} AS week, scenario, home, holiday
    FROM fut, range(1, 5) g(h), (VALUES ('up', 1.0::DOUBLE, 1.0::DOUBLE), ('down', 0.0::DOUBLE, 0.5::DOUBLE)) s(scenario, home, holiday)"""),
)
def j7(t):
    """Four future weeks under two covariate scenarios."""
    cases = {"up": {"home": 1, "holiday": 1}, "down": {"home": 0, "holiday": 0.5}}
    return shape.scenarios(future_rows(weekly(t), 4), cases)


@query(
    "J8_bind_by_position",
    with_ctes(OW, select=f"""SELECT a.o_orderpriority, a.t, a.y AS left_y, b.y AS right_y FROM ow a JOIN ow b
    ON a.o_orderpriority = b.o_orderpriority AND b.t = a.t + 52"""),
)
def j8(t):
    """Columns aligned by position inside each series."""
    p = weekly(t).with_position("t")
    a = p.df.select("o_orderpriority", "t", F.col("y").alias("left_y"))
    b = p.df.select("o_orderpriority", (F.col("t") - 52).alias("t"), F.col("y").alias("right_y"))
    return a.join(b, ["o_orderpriority", "t"])


@query(
    "A1_daily_extract",
    f"""SELECT {d('l_shipdate')} AS day, l_returnflag, count(*) AS n, CAST(sum(CAST(l_linestatus = 'F' AS INTEGER)) AS BIGINT) AS failed,
    CAST(sum(CAST(l_discount > 0.05 AS INTEGER)) AS BIGINT) AS cut, CAST(sum(CASE WHEN l_linenumber IN (1, 4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS ice
    FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2001 AND l_tax <= 0.06 GROUP BY CAST(l_shipdate AS DATE), l_returnflag""",
)
def a1(t):
    """Facts by day and class with flag sums, over a range of years."""
    from chronopanel.functions.dates import in_span

    li = t("lineitem").where(in_span("l_shipdate", "1996", "2001") & (F.col("l_tax") <= 0.06))
    out = li.groupBy(F.to_date("l_shipdate").alias("day"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("l_linestatus") == "F").cast("int")).alias("failed"),
        F.sum((F.col("l_discount") > 0.05).cast("int")).alias("cut"),
        F.sum(F.when(F.col("l_linenumber").isin(1, 4, 5), 1).otherwise(0)).alias("ice"),
    )
    return out.orderBy("day", "l_returnflag")


@query(
    "A2_monthly_extract",
    """SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month, l_linenumber::BIGINT AS l_linenumber, count(*) AS n,
    CAST(sum(CAST(l_linestatus = 'F' AS INTEGER)) AS BIGINT) AS failed FROM lineitem
    WHERE year(l_shipdate) BETWEEN 1998 AND 2000 GROUP BY 1, 2, 3""",
)
def a2(t):
    from chronopanel.functions.dates import in_span

    li = t("lineitem").where(in_span("l_shipdate", "1998", "2000"))
    out = li.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("l_linestatus") == "F").cast("int")).alias("failed")
    )
    return out.orderBy("year", "month", F.col("l_linenumber").cast("int"))


@query("A3_weekly_rollup", with_ctes(CLASSES, select=f"SELECT o_orderpriority, {d('week')} AS week, y, large, failed, ice FROM cls"))
def a3(t):
    return weekly_classes(t).df.drop("ice_present")


@query("A4_flag_from_sum", with_ctes(CLASSES, select=f"SELECT o_orderpriority, {d('week')} AS week, ice, ice_present FROM cls"))
def a4(t):
    """The flag looks at the summed value of the same summary."""
    return weekly_classes(t).df.select("o_orderpriority", "week", "ice", "ice_present")


@query(
    "A5_monthly_rollup",
    f"""SELECT o_orderstatus, {d("date_trunc('month', o_orderdate)")} AS month, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total
    FROM orders GROUP BY o_orderstatus, date_trunc('month', o_orderdate)""",
    digits=2,
)
def a5(t):
    return aggregate.roll_up(t("orders"), "o_orderdate", "month", ["o_orderstatus"], "month", n=F.count(F.lit(1)), total=F.sum("o_totalprice"))


@query("A6_conditional_count", with_ctes(CAL, COV, select=f"SELECT {d('week')} AS week, home FROM cov"))
def a6(t):
    days = calendar_days(t)
    return days.groupBy(floor_to("date", "week").alias("week")).agg(F.count_if(F.col("home") == 1).alias("home"))


@query("A7_any_in_week", with_ctes(CAL, COV, select=f"SELECT {d('week')} AS week, covid, holiday FROM cov"))
def a7(t):
    days = calendar_days(t)
    return days.groupBy(floor_to("date", "week").alias("week")).agg(F.max("covid").alias("covid"), F.max("holiday").alias("holiday"))


@query(
    "A8_coarser_index",
    with_ctes(EH, select=f"SELECT event_type, {d('hour')} AS day, CAST(sum(y) AS BIGINT) AS total, max(y) AS top FROM eh GROUP BY event_type, CAST(hour AS DATE)"),
)
def a8(t):
    """Hours to days: sum and maximum per key."""
    return aggregate.coarsen(hourly(t), "day", "day", total=F.sum("y"), top=F.max("y"))


@query("A9_implicit_index_group", with_ctes(LM, select=f"SELECT l_returnflag, {d('month')} AS month, {r('sum(y)')} AS y FROM lm GROUP BY l_returnflag, month"))
def a9(t):
    """Collapsing one key column keeps the index."""
    return aggregate.collapse(monthly(t), ["l_returnflag"], y=F.sum("y"))


@query("A10_total_per_category", f"SELECT l_returnflag, {r('sum(l_quantity)')} AS qty, count(*) AS n FROM lineitem GROUP BY 1")
def a10(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")).orderBy("qty")


def _describe_sql(table: str, columns: list[str]) -> str:
    def r(expr: str) -> str:
        return rounded(expr, 8)

    parts = []
    for c in columns:
        parts.append(f"""
    (WITH x AS (SELECT CAST({c} AS DOUBLE) AS x FROM {table}),
    m AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.5) AS med,
      quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75 FROM x),
    rk AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM x)
    SELECT '{c}' AS variable, n, {r('mean')} AS mean, {r('sd')} AS sd, {r('med')} AS median,
      {r('(SELECT avg(x) FROM rk WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1))')} AS trimmed,
      {r('(SELECT quantile_cont(abs(x - med), 0.5) FROM x) * 1.4826')} AS mad, {r('lo')} AS min, {r('hi')} AS max, {r('hi - lo')} AS range,
      {r('(SELECT avg(pow(x - mean, 3)) FROM x) / pow(sd, 3)')} AS skew, {r('(SELECT avg(pow(x - mean, 4)) FROM x) / pow(sd, 4) - 3')} AS kurtosis,
      {r('sd / sqrt(n)')} AS se, {r('q25')} AS q25, {r('q75')} AS q75 FROM m)""")
    return " UNION ALL ".join(parts)


@query("A11_describe", _describe_sql("lineitem", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]), digits=8)
def a11(t):
    """Summary statistics of the raw columns, exact order statistics included."""
    return quantiles.describe(t("lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


@query(
    "A12_quantiles",
    f"""SELECT event_type, {r('quantile_cont(value, 0.0)')} AS q0, {r('quantile_cont(value, 0.25)')} AS q25,
    {r('quantile_cont(value, 0.5)')} AS q50, {r('quantile_cont(value, 0.75)')} AS q75, {r('quantile_cont(value, 1.0)')} AS q100 FROM events GROUP BY 1""",
)
def a12(t):
    """Five quantiles of the raw values per event type."""
    return quantiles.quantiles(t("events"), ["event_type"], "value", [0.0, 0.25, 0.5, 0.75, 1.0], ["q0", "q25", "q50", "q75", "q100"])


@query("A13_mean_feature", f"SELECT l_partkey, {r('avg(l_quantity)')} AS mean FROM lineitem GROUP BY 1")
def a13(t):
    return t("lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("mean"))


@query(
    "A14_mean_and_error",
    f"""SELECT l_returnflag, {r('avg(l_quantity)')} AS mean, {r('stddev_samp(l_quantity) / sqrt(count(l_quantity))')} AS se,
    {r('sqrt(avg(l_quantity * l_quantity))')} AS rms FROM lineitem GROUP BY 1""",
)
def a14(t):
    return aggregate.mean_and_error(t("lineitem"), ["l_returnflag"], "l_quantity")


@query("A15_argmax", with_ctes(OW, select=f"SELECT o_orderpriority, {d('arg_max(week, struct_pack(y := y, w := week))')} AS week FROM ow GROUP BY 1"))
def a15(t):
    """Week of the largest count; the latest one on ties."""
    return weekly(t).df.groupBy("o_orderpriority").agg(F.max_by("week", F.struct("y", "week")).alias("week"))


@query(
    "A16_row_means",
    with_ctes(LM, select=f"""SELECT l_returnflag, l_linestatus, {d('month')} AS month,
    {r('(y + lag(y) OVER w) / 2')} AS pair, {r('(y + lag(y) OVER w + lag(y, 2) OVER w + lag(y, 3) OVER w) / 4')} AS four
    FROM lm WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY month)"""),
)
def a16(t):
    """Row-wise means; any NULL gives NULL."""
    p = monthly(t)
    w = p.window()
    y = F.col("y")
    lags = [F.lag("y", k).over(w) for k in (1, 2, 3)]
    return p.df.select(*p.key, p.index, ((y + lags[0]) / 2).alias("pair"), ((y + lags[0] + lags[1] + lags[2]) / 4).alias("four"))


@query(
    "A17_pivot_longer",
    with_ctes(CLASSES, select=f"SELECT o_orderpriority, {d('week')} AS week, name, value FROM (UNPIVOT cls ON large, failed, ice INTO NAME name VALUE value)"),
)
def a17(t):
    return shape.longer(weekly_classes(t).df, ["o_orderpriority", "week"], ["large", "failed", "ice"], "name", "value")


@query(
    "A18_pivot_wider",
    f"""SELECT {d("date_trunc('month', o_orderdate)")} AS month, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F,
    nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY date_trunc('month', o_orderdate)""",
)
def a18(t):
    o = t("orders").select(floor_to("o_orderdate", "month").alias("month"), "o_orderstatus")
    return shape.wider(o, ["month"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@query(
    "A19_correlations",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})')} AS corr FROM lineitem GROUP BY 1"
        for a, b in [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax")]
    ),
)
def a19(t):
    return aggregate.correlations(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])


@query(
    "A20_histogram",
    f"""WITH l AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem GROUP BY 1),
    b AS (SELECT l_returnflag, CAST(least(floor((l_quantity - lo) / ((hi - lo) / 12)) + 1, 12) AS BIGINT) AS bin, lo, (hi - lo) / 12 AS w, n
      FROM lineitem JOIN l USING (l_returnflag))
    SELECT l_returnflag, bin, {r('max(lo + (bin - 1) * w)')} AS left, count(*) AS count, {r('count(*) / max(n * w)')} AS density FROM b GROUP BY 1, 2""",
)
def a20(t):
    return aggregate.histogram(t("lineitem"), ["l_returnflag"], "l_quantity", 12)


@query(
    "A21_kernel_density",
    f"""WITH l AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_samp(value) AS sd FROM events GROUP BY 1),
    c AS (SELECT event_type, least(floor((value - lo) / ((hi - lo) / 256)), 255) AS b, count(*) AS c FROM events JOIN l USING (event_type) GROUP BY 1, 2),
    g AS (SELECT *, lo + point * (hi - lo) / 63 AS grid, 1.06 * sd * pow(n, -0.2) AS bw FROM l, range(64) p(point))
    SELECT event_type, CAST(point AS BIGINT) AS point, {r('max(grid)')} AS grid,
    {r('sum(c * exp(-pow((grid - (lo + (b + 0.5) * (hi - lo) / 256)) / bw, 2) / 2)) / max(n * bw * sqrt(2 * pi()))')} AS density
    FROM g JOIN c USING (event_type) GROUP BY 1, 2""",
)
def a21(t):
    return aggregate.kernel_density(t("events"), ["event_type"], "value")


@query(
    "A22_line_per_group",
    f"""SELECT l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept,
    {r('regr_r2(l_extendedprice, l_quantity)', 4)} AS r2 FROM lineitem GROUP BY 1""",
    digits=4,
)
def a22(t):
    return aggregate.line_fit(t("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("L1_arrange", f"SELECT c_custkey, {r('c_acctbal', 2)} AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", digits=2)
def l1(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query(
    "L2_slice_min_ties",
    """WITH c AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, CAST(day AS VARCHAR) AS day, n FROM c QUALIFY rank() OVER (PARTITION BY o_orderstatus ORDER BY n) = 1""",
)
def l2(t):
    """Days with the smallest count per status; ties stay."""
    c = t("orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    least = c.groupBy("o_orderstatus").agg(F.min("n").alias("n"))
    return c.join(least, ["o_orderstatus", "n"])


@query(
    "L3_two_best",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY n, c_mktsegment) AS rank FROM c QUALIFY rank <= 2""",
)
def l3(t):
    c = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c_nationkey").orderBy("n", "c_mktsegment")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


@query(
    "L4_tail_per_key",
    with_ctes(OD, select=f"SELECT o_orderstatus, {d('day')} AS day, y FROM od WHERE t > n - 20"),
)
def l4(t):
    """The last twenty rows of every series."""
    p = daily(t)
    w = p.whole().orderBy(F.desc("day"))
    return p.df.withColumn("k", F.row_number().over(w)).where("k <= 20").drop("k")


@query(
    "L5_random_series",
    with_ctes(LM, "pick AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lm ORDER BY md5(concat_ws('|', '7', l_returnflag, l_linestatus)) LIMIT 1)",
              select=f"SELECT l_returnflag, l_linestatus, {d('month')} AS month, y FROM lm JOIN pick USING (l_returnflag, l_linestatus)"),
)
def l5(t):
    """One series picked at random (hash order with a seed), with all its rows."""
    p = monthly(t)
    ids = p.df.select(*p.key).distinct()
    pick = ids.orderBy(F.md5(F.concat_ws("|", F.lit("7"), *p.key))).limit(1)
    return pick.join(p.df, list(p.key))


@query(
    "L6_bind_rows",
    """SELECT o_orderkey AS id, o_orderpriority AS tag, CAST(NULL AS VARCHAR) AS seg FROM orders
    UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""",
)
def l6(t):
    a = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tag"))
    b = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"))
    return shape.bind_rows(a, b)
