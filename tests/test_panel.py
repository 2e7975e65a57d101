"""Panel construction on small hand-made fixtures."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.functions import dates
from chronopanel.operators import joins
from chronopanel.panel import Panel, fill_gaps, future_rows, numbered, reindex
from chronopanel.sources import files
from chronopanel.sources.calendar import holiday_calendar


def day(n):
    return dt.date(2024, 1, n)


@pytest.fixture(scope="module")
def gap(spark):
    rows = [("a", day(1), 1), ("a", day(2), 2), ("a", day(5), 5), ("b", day(3), 7), ("b", day(4), 8)]
    return Panel(spark.createDataFrame(rows, "k string, d date, y long"), ("k",), "d", "day")


def test_fill_gaps_uses_each_keys_own_range(gap):
    rows = {(r.k, r.d): r.y for r in fill_gaps(gap).df.collect()}
    assert rows == {
        ("a", day(1)): 1, ("a", day(2)): 2, ("a", day(3)): None, ("a", day(4)): None, ("a", day(5)): 5,
        ("b", day(3)): 7, ("b", day(4)): 8,
    }
    filled = fill_gaps(gap, {"y": 0}).df.where("y = 0").count()
    assert filled == 2


def test_duplicate_index_is_rejected(spark):
    rows = [("a", day(1), 1), ("a", day(1), 2)]
    p = Panel(spark.createDataFrame(rows, "k string, d date, y long"), ("k",), "d", "day")
    with pytest.raises(ValueError):
        p.require_unique()


def test_unique_panel_passes(gap):
    assert gap.require_unique() is gap


@pytest.mark.parametrize("block", [None, 2])
def test_position(gap, block):
    p = fill_gaps(gap)
    rows = p.on(p.df, block=block).with_position("t").df.collect()
    assert sorted((r.k, r.d.day, r.t) for r in rows) == [
        ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("a", 5, 5), ("b", 3, 1), ("b", 4, 2)
    ]


@pytest.mark.parametrize("block", [None, 1, 2])
def test_position_counts_rows_on_a_gapped_index(gap, block):
    rows = gap.on(gap.df, block=block).with_position("t").df.collect()
    assert sorted((r.k, r.d.day, r.t) for r in rows) == [("a", 1, 1), ("a", 2, 2), ("a", 5, 3), ("b", 3, 1), ("b", 4, 2)]


def test_gaps_filled_in_blocks(gap):
    assert sorted(fill_gaps(gap.on(gap.df, block=1)).df.collect()) == sorted(fill_gaps(gap).df.collect())


def test_spread_reindex_equals_one_window(gap):
    plain = {(r.k, r.d): r.i for r in reindex(gap, "i").df.collect()}
    assert {(r.k, r.d): r.i for r in reindex(gap, "i", spread=True).df.collect()} == plain


def test_numbered_on_a_hot_key_and_a_hot_hour(spark):
    """Nine of ten rows in one hour of one key: numbers are right, and no range holds more than its share."""
    hour = F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(3)
    df = spark.range(20_000).select(
        F.when(F.col("id") % 30 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("k"),
        hour.alias("hour"), F.xxhash64("id").alias("x"), "id",
    )
    out = numbered(df.repartition(7), ["k"], ["hour", "x"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("hour", "x")))
    assert out.columns == want.columns and out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, "k", "hour", "x").groupBy(F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in ranged.collect()) < 2 * 20_000 / parts
    whole = numbered(df, [], ["x"], "rn").agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(whole) == (1, 20_000, 20_000)
    assert numbered(df.limit(0), ["k"], ["x"], "rn").collect() == []


def test_iso_week_53(spark):
    rows = [(dt.date(2020, 12, 28),), (dt.date(2021, 1, 3),), (dt.date(2021, 1, 4),)]
    df = spark.createDataFrame(rows, "d date").select(dates.week_label("d").alias("w"))
    assert [r.w for r in df.collect()] == ["2020 W53", "2020 W53", "2021 W01"]


def test_span_texts():
    assert dates.grain_span("2004 Q4") == (dt.date(2004, 10, 1), dt.date(2004, 12, 31))
    assert dates.grain_span("2004") == (dt.date(2004, 1, 1), dt.date(2004, 12, 31))
    assert dates.grain_span("2004-02") == (dt.date(2004, 2, 1), dt.date(2004, 2, 29))


def test_future_rows(gap):
    rows = sorted((r.k, r.h, r.d.day) for r in future_rows(gap, 2).collect())
    assert rows == [("a", 1, 6), ("a", 2, 7), ("b", 1, 5), ("b", 2, 6)]


def test_holidays_of_six_years(spark):
    span = spark.sql("SELECT date'2018-01-01' AS a, date'2023-12-31' AS b")
    cal = holiday_calendar(span, "a", "b")
    assert cal.count() == 2191
    days = [r.date for r in cal.where("holiday = 1").orderBy("date").collect()]
    assert len(days) == 54
    of_2024 = holiday_calendar(spark.sql("SELECT date'2024-01-01' AS a, date'2024-12-31' AS b"), "a", "b")
    assert [str(r.date) for r in of_2024.where("holiday = 1").orderBy("date").collect()] == [
        "2024-01-01", "2024-01-15", "2024-02-13", "2024-03-29", "2024-05-27",
        "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
    ]


def test_left_join_and_outer_merge_differ_by_the_phantom(spark):
    facts = spark.createDataFrame([("a", 1, 5)], "k string, week int, y long")
    cov = spark.createDataFrame([(1, 1), (2, 1)], "week int, home long")
    assert joins.with_covariates(facts, [cov], "week").count() == 1
    merged = joins.outer_merge(facts, [cov], "week", "k").collect()
    assert {(r.k, r.week, r.y, r.home) for r in merged} == {("a", 1, 5, 1), ("0", 2, 0, 1)}
    assert joins.outer_merge(facts, [cov], "week", "k", drop_phantom=True).count() == 1


def test_csv_with_byte_order_mark_and_row_numbers(spark, tmp_path):
    bom = tmp_path / "bom.csv"
    bom.write_text("﻿day,n\n1/2/2021,32\n1/13/2021,NA\n", encoding="utf-8")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("day", StringType()), StructField("n", LongType())])
    df = files.read_csv(spark, str(bom), schema).select(dates.parse_mdy("day").alias("day"), "n")
    assert [(str(r.day), r.n) for r in df.collect()] == [("2021-01-02", 32), ("2021-01-13", None)]
    numbered_file = tmp_path / "rows.csv"
    numbered_file.write_text(",day,n\n0,x,1\n1,y,2\n")
    assert files.read_csv(spark, str(numbered_file), schema, row_number=True).columns == ["day", "n"]


def test_latest_snapshot_by_file_name(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("n", LongType())])
    for name, value in [("raw_1_5_2021", 1), ("raw_12_31_2020", 2), ("raw_1_2_2021", 3)]:
        (tmp_path / f"{name}.csv").write_text(f"n\n{value}\n")
    assert [r.n for r in files.latest_snapshot(spark, str(tmp_path), schema).collect()] == [1]
    folder = tmp_path / "name=raw_2_1_2021"
    folder.mkdir()
    (folder / "part-0.csv").write_text("n\n7\n")
    (folder / "part-1.csv").write_text("n\n8\n")
    assert sorted(r.n for r in files.latest_snapshot(spark, str(tmp_path), schema).collect()) == [7, 8]


def test_partitioned_results_replace_only_their_share(spark, tmp_path):
    path = str(tmp_path / "out")
    old = spark.createDataFrame([("2024-01-01", 0.1, 1), ("2024-01-01", 0.2, 1)], "run_date string, p double, v int")
    files.write_results(old, path)
    files.write_results(old.where("p = 0.2").withColumn("v", F.lit(9)), path)
    rows = {(r.p, r.v) for r in spark.read.parquet(path).collect()}
    assert rows == {(0.1, 1), (0.2, 9)}
