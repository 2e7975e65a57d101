"""The battery's independent parts run side by side."""

import threading

import pytest
from pyspark.sql import functions as F

from chronopanel.panel import Panel
from chronopanel.plans import battery
from chronopanel.session import together


def test_arima_models_do_not_wait_for_each_other(spark, monkeypatch):
    rows = [("a", i, float(i), "test" if i > 6 else "train", i - 6 if i > 6 else None) for i in range(1, 11)]
    split = Panel(spark.createDataFrame(rows, "k string, i long, y double, part string, h long"), ("k",), "i")
    everyone = threading.Barrier(3, timeout=60)

    def model(split, y, *args):
        everyone.wait()
        return split.df.where("part = 'test'").select("k", "h", F.col(y).alias("actual"), F.lit(float(len(args))).alias("mean"))

    monkeypatch.setattr(battery, "_plain_arima", model)
    monkeypatch.setattr(battery.arima, "arima_regression", model)
    out = battery.arima_pairs(split, "y").collect()
    assert {(r.model, r["mean"]) for r in out} == {("arima_plain", 1.0), ("arima_full", 2.0), ("arima_sdif", 2.0)}
    assert len(out) == 12


def test_steps_keep_their_order_and_raise_their_errors(spark):
    assert together(lambda: 1, lambda: spark.range(5).count(), lambda: 3) == [1, 5, 3]
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1, lambda: 1 // 0)


def test_networks_start_no_task_without_a_series(spark):
    rows = [(k, i, float(i % 7), "test" if i > 36 else "train", i - 36 if i > 36 else None, 0) for k in "abc" for i in range(1, 41)]
    split = Panel(spark.createDataFrame(rows, "k string, i long, y double, part string, h long, home int").withColumns({f: F.col("home") for f in battery.FLAGS}), ("k",), "i")
    out = battery.neural_pairs(split, "y", networks=1, rounds=2)
    assert out.rdd.getNumPartitions() == 2 * 3
    assert out.count() == 2 * 3 * 4
