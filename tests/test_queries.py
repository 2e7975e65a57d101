"""Registered queries: contract, and a cross-section against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"

SAMPLE = [
    "S8_partitioned_results", "S9_holiday_calendar", "S12_reindex", "S13_fill_gaps", "J2_full_outer_merge",
    "A11_describe", "A20_histogram", "W1_blocked_series", "W6_seasonal_difference", "D2_classical_multiplicative",
    "D5_stl_robust", "D5_mstl", "D6_x11_filters", "D8_all_decompositions", "X3_ljung_box", "X5_kpss", "M3_snaive", "M9_trend_season_covariates", "M15_ar2_forecast", "M15_arima_401", "M16_regression_ar1_errors", "X7_nsdiffs_stl",
    "M22_leave_one_out", "EV3_share_sweep", "EV6_accuracy", "EV7_ensemble_rmse", "EV10_crps", "flagship_best_model",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 150


def test_entry_returns_the_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderpriority", "model", "rmse", "mae"]
    assert df.count() >= 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    _, close, message = compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name])
    assert close, message
