"""Scans, sinks, panel construction, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.functions import dates, transforms
from chronopanel.operators import shape
from chronopanel.panel import Panel, fill_gaps, numbered, reindex
from chronopanel.plans.inputs import (
    CAL, CLASSES, EH, EH_RAW, LM, OD, OW, calendar_days, daily, hourly, monthly, raw_hourly,
    raw_weekly, weekly, weekly_classes,
)
from chronopanel.plans.registry import d, query, r, with_ctes
from chronopanel.session import scratch_path
from chronopanel.sources import files
from chronopanel.sources.noise import noise_ctes, white_noise

ORDER_COLS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("o_orderdate", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


@query(
    "S1_read_csv",
    f"""SELECT o_orderpriority, count(*) AS n, {r("sum(o_totalprice)", 2)} AS total,
    {d("min(o_orderdate)")} AS first_day FROM orders GROUP BY 1""",
    digits=2,
)
def s1(t):
    """Orders written as CSV with M/d/yyyy dates and a row-number column, read with a fixed schema."""
    orders = t("orders")
    path = scratch_path(orders.sparkSession, "orders-csv")
    day = F.date_format("o_orderdate", "M/d/yyyy")
    files.write_csv(
        orders.select(
            F.monotonically_increasing_id().alias("row"), "o_orderkey", "o_orderpriority", day.alias("o_orderdate"), "o_totalprice"
        ),
        path,
    )
    df = files.read_csv(orders.sparkSession, path, ORDER_COLS, row_number=True)
    return df.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_totalprice").alias("total"),
        F.min(dates.parse_mdy("o_orderdate")).alias("first_day"),
    )


@query("S2_read_landed", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def s2(t):
    """Scan of a landed table; only the used column is read."""
    return t("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S3_cumulative_feed",
    f"""WITH x AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS c FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, {d("day")} AS day, CAST(sum(c) OVER (PARTITION BY o_orderstatus ORDER BY day) AS BIGINT) AS total FROM x""",
)
def s3(t):
    """Daily counts per status landed as a CSV folder, read with a schema and cumulated."""
    from chronopanel.operators.windows import cumulative

    days = t("orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    path = scratch_path(t.spark, "feed")
    files.write_csv(days, path)
    raw = files.read_csv(t.spark, path, T.StructType.fromDDL("o_orderstatus string, day date, c bigint"))
    p = cumulative(Panel(raw, ("o_orderstatus",), "day", "day"), "c", "total")
    return p.df.select("o_orderstatus", "day", "total")


@query(
    "S4_latest_snapshot",
    """WITH m AS (SELECT max(year(o_orderdate) * 100 + month(o_orderdate)) AS ym FROM orders)
    SELECT o_orderpriority, count(*) AS n FROM orders, m
    WHERE year(o_orderdate) * 100 + month(o_orderdate) = ym GROUP BY 1""",
)
def s4(t):
    """Monthly CSV snapshots named by date; the newest name wins and only its files are read."""
    orders, path = t("orders"), scratch_path(t.spark, "snapshots")
    named = orders.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "'raw'_M_1_yyyy").alias("name"))
    named.repartition("name").write.option("header", True).partitionBy("name").csv(path)
    newest = files.latest_snapshot(t.spark, path, T.StructType.fromDDL("o_orderkey bigint, o_orderpriority string"))
    return newest.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("S5_warehouse_table", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1")
def s5(t):
    """Named table with a year range written on the raw column."""
    orders = t("orders")
    orders.createOrReplaceTempView("fact_orders")
    fact = files.read_table(orders.sparkSession, "fact_orders")
    return fact.where(dates.in_span("o_orderdate", "1996", "1998")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S6_sample_tables",
    "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def s6(t):
    """Landed tables as views, used by name in SQL."""
    files.register_tables(t.spark, t.folder, ["region", "nation", "customer"])
    return t.spark.sql(
        "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"
    )


@query("S7_row_numbers", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row FROM events")
def s7b(t):
    """The row-number column some result files carry, numbered over ranges of time."""
    ev = t("events").select("event_id", "ts")
    return files.with_row_number(ev, ["ts", "event_id"]).drop("ts")


@query(
    "S7_write_csv",
    with_ctes(OW, select=f"SELECT o_orderpriority, {d('week')} AS week, y FROM ow"),
)
def s7(t):
    """Weekly panel written as CSV and read back."""
    p = weekly(t)
    spark = p.df.sparkSession
    path = scratch_path(spark, "weekly-csv")
    files.write_csv(p.df, path)
    schema = T.StructType(
        [
            T.StructField("o_orderpriority", T.StringType()),
            T.StructField("week", T.DateType()),
            T.StructField("y", T.LongType()),
        ]
    )
    return files.read_csv(spark, path, schema)


@query(
    "S8_partitioned_results",
    with_ctes(OW, select=f"""SELECT o_orderpriority, {d('week')} AS week, y, p,
    {d('(SELECT max(week) FROM ow)')} AS run_date FROM ow, (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) v(p)"""),
)
def s8(t):
    """Results stored per run date and share; rewriting one share leaves the other."""
    p = weekly(t)
    spark = p.df.sparkSession
    path = scratch_path(spark, "results")
    run = p.df.agg(F.max("week").alias("w"))
    base = p.df.withColumn("run_date", run.scalar())
    both = shape.over_proportions(base, [0.1, 0.2])
    files.write_results(both.withColumn("y", F.when(F.col("p") == 0.2, F.lit(-1)).otherwise(F.col("y"))), path)
    files.write_results(both.where("p = 0.2"), path)
    return spark.read.parquet(path)


@query(
    "S9_holiday_calendar",
    with_ctes(CAL, select=f"SELECT {d('date')} AS date, holiday, home, covid FROM cal"),
)
def s9(t):
    """Holiday flags for every day of the order span."""
    return calendar_days(t)


@query("S10_white_noise", with_ctes(OW, *noise_ctes("ow", 30, ["o_orderpriority"], "week"), select=f"SELECT o_orderpriority, {d('week')} AS week, y, {r('wn')} AS wn FROM noise"))
def s10(t):
    """One normal draw per row of the weekly panel."""
    return white_noise(weekly(t), "wn", seed=30)


@query(
    "S11_duplicate_index",
    """SELECT o_custkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS count
    FROM orders GROUP BY 1, 2, CAST(o_orderdate AS DATE) HAVING count(*) > 1""",
)
def s11(t):
    """Pairs of key and index that break a panel declaration."""
    raw = t("orders").select("o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    return Panel(raw, ("o_custkey", "o_orderstatus"), "day", "day").duplicates()


@query(
    "S12_reindex",
    "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events",
)
def s12(t):
    """Raw events renumbered 1..n per type, a type spread over many tasks."""
    ev = t("events").select("event_id", "event_type", "ts")
    return numbered(ev, ["event_type"], ["ts", "event_id"], "step").drop("ts")


@query(
    "S12_reindex_days",
    with_ctes(
        "x AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS y FROM orders GROUP BY 1, 2)",
        select=f"SELECT o_orderstatus, {d('day')} AS day, y, row_number() OVER (PARTITION BY o_orderstatus ORDER BY day) AS trading_day FROM x",
    ),
)
def s12b(t):
    """Days with orders become a regular integer index."""
    raw = t("orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("y"))
    return reindex(Panel(raw, ("o_orderstatus",), "day", "day"), "trading_day")


@query(
    "S13_fill_gaps",
    with_ctes(EH, select="SELECT event_type, CAST(hour AS VARCHAR) AS hour, y FROM eh_fill"),
)
def s13(t):
    """Missing hours of every event type as NULL rows."""
    return fill_gaps(raw_hourly(t))


@query(
    "S14_fill_gaps_zero",
    with_ctes(EH, select="SELECT event_type, CAST(hour AS VARCHAR) AS hour, y FROM eh"),
)
def s14(t):
    return hourly(t)


@query(
    "P1_mutate",
    f"""SELECT l_orderkey, l_linenumber, {r("l_extendedprice * (1 - l_discount)")} AS net,
    {r("l_extendedprice * (1 - l_discount) * (1 + l_tax)")} AS gross FROM lineitem""",
)
def p1(t):
    li = t("lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    li = li.withColumn("gross", F.col("net") * (1 + F.col("l_tax")))
    return li.select("l_orderkey", "l_linenumber", "net", "gross")


@query(
    "P2_ratio_measures",
    with_ctes(CLASSES, select=f"""SELECT o_orderpriority, {d('week')} AS week,
    {r("failed / nullif(y, 0)")} AS share_failed, {r("large / nullif(failed, 0) * 100")} AS large_per_failed FROM cls"""),
)
def p2(t):
    """Shares and deflated values; a zero base gives NULL."""
    return weekly_classes(t).df.select(
        "o_orderpriority",
        "week",
        transforms.ratio("failed", "y").alias("share_failed"),
        transforms.deflate("large", "failed").alias("large_per_failed"),
    )


@query("P3_select_drop", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def p3(t):
    return t("customer").drop("c_name", "c_acctbal")


@query("P4_column_range", f"SELECT s_name, s_nationkey, {r('s_acctbal', 2)} AS s_acctbal FROM supplier", digits=2)
def p4(t):
    s = t("supplier")
    return s.select(*shape.column_range(s, "s_name", "s_acctbal"))


@query("P5_columns_by_name", "SELECT DISTINCT p_brand, p_type, p_name FROM part")
def p5(t):
    p = t("part")
    cols = [c for part in ("brand", "type", "name") for c in shape.columns_containing(p, part)]
    return p.select(*cols).distinct()


@query(
    "P6_columns_without_null",
    with_ctes(
        "f AS (SELECT o_orderpriority, date_trunc('week', o_orderdate) AS week, count(*) AS y FROM orders GROUP BY 1, 2)",
        select=f"SELECT o_orderpriority, {d('week')} AS week, y FROM f",
    ),
)
def p6(t):
    """A lag column with NULL edges is dropped."""
    from chronopanel.operators.windows import difference

    p = difference(raw_weekly(t), "y", [1], "change")
    return shape.without_null_columns(p.df)


@query("P7_rename", "SELECT r_regionkey AS REGION_KEY, r_name AS REGION_NAME FROM region")
def p7(t):
    reg = t("region").withColumnsRenamed({"r_regionkey": "region_key", "r_name": "region_name"})
    return reg.toDF(*[c.upper() for c in reg.columns])


@query(
    "P8_filter",
    f"""SELECT l_orderkey, l_linenumber, {r('l_quantity', 2)} AS l_quantity FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_discount < 0.05 AND (l_tax <> 0 OR abs(l_extendedprice - 50000) < 10000)""",
    digits=2,
)
def p8(t):
    c = F.col
    keep = (c("l_returnflag") == "R") & (c("l_quantity") >= 30) & (c("l_discount") < 0.05)
    keep = keep & ((c("l_tax") != 0) | (F.abs(c("l_extendedprice") - 50000) < 10000))
    return t("lineitem").where(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "P9_in_list",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', 'NULL') AND o_orderstatus NOT IN ('P') GROUP BY 1, 2""",
)
def p9(t):
    o = t("orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "NULL") & ~F.col("o_orderstatus").isin("P")
    )
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P10_not_null",
    with_ctes(EH, select="SELECT event_type, CAST(hour AS VARCHAR) AS hour, y FROM eh_fill WHERE y IS NOT NULL"),
)
def p10(t):
    p = fill_gaps(raw_hourly(t))
    return p.df.where(F.col("y").isNotNull())


@query(
    "P11_filter_index",
    with_ctes(OW, select=f"""SELECT o_orderpriority, {d('week')} AS week, y FROM ow
    WHERE week >= DATE '1996-01-01' AND week <= DATE '1998-09-30'"""),
)
def p11(t):
    """Inclusive range from the first quarter of 1996 to the third of 1998."""
    return weekly(t).df.where(dates.in_span("week", "1996 Q1", "1998 Q3"))


@query("P11_open_end", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '2000-10-01' GROUP BY 1""")
def p11b(t):
    o = t("orders").where(dates.in_span("o_orderdate", "2000 Q4", None))
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P12_calendar_parts",
    """SELECT o_orderstatus, count(*) FILTER (year(o_orderdate) >= 1999) AS since_1999,
    count(*) FILTER (year(o_orderdate) = 2000 AND month(o_orderdate) = 2) AS feb_2000
    FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1""",
)
def p12(t):
    o = t("orders").where(dates.year_at_least("o_orderdate", 1999))
    return o.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("since_1999"), F.count_if(dates.in_month("o_orderdate", 2000, 2)).alias("feb_2000")
    )


@query(
    "P13_first_weeks",
    with_ctes(OW, select=f"SELECT o_orderpriority, {d('week')} AS week, y FROM ow WHERE weekofyear(week) = 1"),
)
def p13(t):
    """The first ISO week of every year."""
    return weekly(t).df.where(F.weekofyear("week") == 1)


@query(
    "P14_global_max",
    with_ctes(OW, select=f"SELECT o_orderpriority, {d('week')} AS week, y FROM ow WHERE y = (SELECT max(y) FROM ow)"),
)
def p14(t):
    df = weekly(t).df
    return df.where(F.col("y") == df.agg(F.max("y")).scalar())


@query(
    "P15_drop_last_fold",
    with_ctes(LM, select=f"SELECT l_returnflag, l_linestatus, {d('month')} AS month, y FROM lm WHERE month <> (SELECT max(month) FROM lm)"),
)
def p15(t):
    df = monthly(t).df
    return df.where(F.col("month") != df.agg(F.max("month")).scalar())


@query("P16_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def p16(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "P17_recode",
    """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Fast'
    WHEN o_orderpriority IN ('3-MEDIUM') THEN 'Normal' ELSE 'Other' END AS family, count(*) AS n FROM orders GROUP BY 1""",
)
def p17(t):
    fam = shape.recode("o_orderpriority", {"Fast": ["1-URGENT", "2-HIGH"], "Normal": ["3-MEDIUM"]}, "Other")
    return t("orders").groupBy(fam.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P18_if_else",
    """SELECT l_returnflag, CAST(sum(CASE WHEN l_linenumber IN (1, 4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS hits,
    CAST(sum(CASE WHEN l_quantity > 0 AND l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS cut FROM lineitem GROUP BY 1""",
)
def p18(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        F.sum(F.when(F.col("l_linenumber").isin(1, 4, 5), 1).otherwise(0)).alias("hits"),
        F.sum(F.when((F.col("l_quantity") > 0) & (F.col("l_discount") > 0.05), 1).otherwise(0)).alias("cut"),
    )


@query(
    "P19_level_order",
    """SELECT o_orderpriority, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS BIGINT) AS level,
    count(*) AS n FROM orders GROUP BY 1, 2""",
)
def p19(t):
    """Explicit level order; unlisted values have no level."""
    lv = shape.level_order("o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])
    return t("orders").groupBy("o_orderpriority", lv.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P20_null_to_zero",
    with_ctes(EH, select="SELECT event_type, CAST(hour AS VARCHAR) AS hour, coalesce(y, 0) AS y FROM eh_fill"),
)
def p20(t):
    return fill_gaps(raw_hourly(t)).df.fillna(0)


@query(
    "P21_outlier_injection",
    with_ctes(OD, select=f"SELECT o_orderstatus, {d('day')} AS day, CASE WHEN t = 1 THEN y + 300 ELSE y END AS y FROM od"),
)
def p21(t):
    p = daily(t).with_position("t")
    return p.df.select(
        "o_orderstatus", "day", F.when(F.col("t") == 1, F.col("y") + 300).otherwise(F.col("y")).alias("y")
    )


@query(
    "P22_pull_scalar",
    with_ctes(OD, select=f"SELECT o_orderstatus, {d('day')} AS day, {r('y - (SELECT avg(y) FROM od)')} AS above FROM od WHERE y <> 0"),
)
def p22(t):
    """One scalar taken from the panel and used on its non-zero rows."""
    df = daily(t).df
    mean = df.agg(F.avg("y")).scalar()
    return df.where("y <> 0").select("o_orderstatus", "day", (F.col("y") - mean).alias("above"))


@query(
    "F1_parse_dates",
    f"""SELECT o_orderkey, {d('o_orderdate')} AS mdy, {d('o_orderdate')} AS ymd, {d('o_orderdate')} AS token,
    {d("date_trunc('quarter', o_orderdate)")} AS quarter FROM orders""",
)
def f1(t):
    """Dates through three text forms and back."""
    o = t("orders")
    quarter = dates.quarter_label("o_orderdate")
    return o.select(
        "o_orderkey",
        dates.parse_mdy(F.date_format("o_orderdate", "M/d/yyyy")).alias("mdy"),
        dates.parse_ymd(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ymd"),
        dates.first_token_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("token"),
        dates.parse_quarter(quarter).alias("quarter"),
    )


@query(
    "F2_date_parts",
    f"""SELECT DISTINCT {d('o_orderdate')} AS day, isoyear(o_orderdate) || ' W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week_label,
    isoyear(o_orderdate) AS week_year, strftime(o_orderdate, '%Y %b') AS month_label,
    year(o_orderdate) || ' Q' || quarter(o_orderdate) AS quarter_label,
    year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, {d("date_trunc('week', o_orderdate)")} AS week FROM orders""",
)
def f2(t):
    from chronopanel.panel import floor_to

    days = t("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    label = dates.week_label("day")
    return days.select(
        "day",
        label.alias("week_label"),
        F.split(label, " ")[0].cast("long").alias("week_year"),
        dates.month_label("day").alias("month_label"),
        dates.quarter_label("day").alias("quarter_label"),
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        floor_to("day", "week").alias("week"),
    )


@query(
    "F3_date_arithmetic",
    f"SELECT o_orderkey, {d('CAST(o_orderdate AS DATE) + 74')} AS later, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders",
)
def f3(t):
    day = F.to_date("o_orderdate")
    return t("orders").select(
        "o_orderkey", F.date_add(day, 74).alias("later"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("dd")
    )


@query(
    "F4_math",
    with_ctes(LM, select=f"""SELECT l_returnflag, l_linestatus, {d('month')} AS month, {r('ln(CASE WHEN y > 0 THEN y END)')} AS log_y, {r('sqrt(CASE WHEN y >= 0 THEN y END)')} AS sqrt_y,
    {r('y / 3')} AS third, {r('-1 / nullif(y, 0)')} AS inverse, {r('exp(y / 10000)')} AS exp_y, CAST(round_even(y / 2, 0) AS BIGINT) AS half_even,
    CAST(floor(y / 7) AS BIGINT) AS floor_y FROM lm"""),
)
def f4(t):
    df, y = monthly(t).df, F.col("y")
    positive = F.when(y > 0, y)
    return df.select(
        "l_returnflag", "l_linestatus", "month",
        F.log(positive).alias("log_y"), F.sqrt(F.when(y >= 0, y)).alias("sqrt_y"), (y / 3).alias("third"), F.try_divide(F.lit(-1), y).alias("inverse"),
        F.exp(y / 10000).alias("exp_y"), F.bround(y / 2).cast("long").alias("half_even"), F.floor(y / 7).alias("floor_y"),
    )


@query(
    "F5_box_cox",
    with_ctes(LM, select=f"""SELECT l_returnflag, l_linestatus, {d('month')} AS month, {r('(pow(p, 0.0895) - 1) / 0.0895')} AS bc,
    {r('ln(p)')} AS bc0, {r('p')} AS back FROM (SELECT *, CASE WHEN y > 0 THEN y END AS p FROM lm)"""),
)
def f5(t):
    df = monthly(t).df.withColumn("y", F.when(F.col("y") > 0, F.col("y")))
    bc = transforms.box_cox("y", 0.0895)
    return df.select(
        "l_returnflag", "l_linestatus", "month", bc.alias("bc"), transforms.box_cox("y", 0.0).alias("bc0"),
        transforms.inv_box_cox(bc, 0.0895).alias("back"),
    )


@query(
    "F6_strings",
    """SELECT p_partkey, p_brand || '/' || p_type AS joined, printf('%.2f', CAST(p_size AS DOUBLE)) AS size2, split_part(p_brand, '#', 2) AS tail,
    replace(p_type, ' ', '_') AS under, upper(p_name) AS up, regexp_matches(p_type, 'ST') AS has_st FROM part""",
)
def f6(t):
    return t("part").select(
        "p_partkey",
        F.concat("p_brand", F.lit("/"), "p_type").alias("joined"),
        F.format_string("%.2f", F.col("p_size").cast("double")).alias("size2"),
        F.coalesce(F.get(F.split("p_brand", "#"), F.lit(1)), F.lit("")).alias("tail"),
        F.regexp_replace("p_type", " ", "_").alias("under"),
        F.upper("p_name").alias("up"),
        F.col("p_type").rlike("ST").alias("has_st"),
    )


@query(
    "F7_casts",
    f"""SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) // 60 AS minutes, CAST(value > 50 AS INTEGER)::BIGINT AS flag,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def f7(t):
    return t("events").select(
        "event_id",
        F.floor(F.unix_timestamp("ts") / 60).alias("minutes"),
        (F.col("value") > 50).cast("int").alias("flag"),
        F.get_json_object("props", "$.k").try_cast("long").alias("k"),
    )
