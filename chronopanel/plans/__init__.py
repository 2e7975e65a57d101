"""The registered queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from chronopanel.plans import registry

MODULES = ("q_panel", "q_tables", "q_windows", "q_features", "q_models", "q_evaluate")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"chronopanel.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_texts() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return registry.QUERIES["flagship_best_model"](spark, sf_dir)
