"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def get_session(cpus: int | str = "*", name: str = "chronopanel") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    parts = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "chronopanel-checkpoints"))
    return spark


# Applications whose workers have the package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "chronopanel.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage of a table several branches use, so a costly scan runs
    once and a lost executor only re-reads files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def together(*steps: Callable[[], T]) -> list[T]:
    """Results of independent steps, run side by side.

    For steps that store tables on their way: one step's small jobs leave most of a
    cluster idle, and the next step would wait for them.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        return list(pool.map(lambda step: step(), [inheritable_thread_target(s) for s in steps]))


# Rows of a large table that one task sorts or groups at a time.
TASK_ROWS = 250_000


def dealt(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Hash a large table by key over as many tasks as its ``rows`` rows fill.

    Adaptive execution merges partitions, and broadcasts a side of a join, by bytes.
    Gap-free rows take a byte each in files and some hundred in the sorts of a task, so
    neither measure bounds memory.  Here the number of tasks follows the rows; windows and
    groups on the key use this partitioning, and joins on the key merge inside it.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *key).hint("merge")


def spread(df: DataFrame, key: Sequence[str], groups: int | None = None) -> DataFrame:
    """Hash rows by key over all shuffle partitions, or as many as the ``groups`` if these are known to be fewer.

    Adaptive execution merges partitions by their bytes.  A kernel that computes
    long on few bytes needs them kept apart; the grouping that follows uses this
    partitioning, so it adds no shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts if groups is None else max(1, min(parts, groups)), *key)
