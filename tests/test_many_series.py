"""Many short series: tasks follow the number of rows, not their bytes, and no panel passes through the driver."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronopanel import session
from chronopanel.operators import joins
from chronopanel.plans import all_queries
from chronopanel.plans.inputs import parts_monthly

PARTS, MONTHS = 40, 30


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Every part is shipped in its first and last month and now and then between; one part is unknown."""
    folder = str(tmp_path_factory.mktemp("parts"))
    rows = []
    for part in [None, *range(PARTS - 1)]:
        for m in range(MONTHS):
            if m in (0, MONTHS - 1) or (m * 7 + (part or 0) * 3) % 5 == 0:
                rows.append((part, dt.datetime(2000 + m // 12, m % 12 + 1, 5), float(1 + (m * m + (part or 0)) % 11)))
    spark.createDataFrame(rows, "l_partkey long, l_shipdate timestamp, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_drill_back_never_broadcasts_observations(spark, tmp_path, capsys):
    spark.range(200_000).select((F.col("id") % 100).alias("k"), F.lit(0.0).alias("y")).sort("k").write.parquet(f"{tmp_path}/obs")
    obs = spark.read.parquet(f"{tmp_path}/obs")
    top = spark.createDataFrame([(3,), (7,), (1000,)], "k long")
    out = joins.drill_back(top, obs, ["k"])
    assert "Broadcast" not in plan(out, capsys)
    assert {r.k: r.n for r in out.groupBy("k").agg(F.count("y").alias("n")).collect()} == {3: 2000, 7: 2000, 1000: 0}


def test_tasks_of_the_parts_follow_their_rows(spark, tables, monkeypatch):
    def table(name):
        return spark.read.parquet(f"{tables}/{name}.parquet")

    whole = {tuple(r) for r in parts_monthly(table).df.collect()}
    assert len(whole) == PARTS * MONTHS
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    p = parts_monthly(table)
    assert p.df.rdd.getNumPartitions() == PARTS * MONTHS // 50
    assert {tuple(r) for r in p.df.collect()} == whole


def test_many_series_are_scored_in_the_tasks_of_their_rows(spark, tables, monkeypatch, capsys):
    def rows(name):
        return sorted(map(str, all_queries()[name](spark, tables).collect()))

    names = ["flagship_many_series", "A23_principal_scores", "A24_outliers_in_pc_space"]
    before = {n: rows(n) for n in names}
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    text = plan(all_queries()["flagship_many_series"](spark, tables), capsys)
    assert f", {PARTS * MONTHS // 50}), REPARTITION_BY_NUM" in text
    assert "Broadcast" not in text
    assert {n: rows(n) for n in names} == before
