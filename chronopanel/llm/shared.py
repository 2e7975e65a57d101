"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast, at ROW_BYTES a row of a few short columns.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir, which the session must name."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(folder, f"{label}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a table once and read it back, so that a lost executor costs no more than re-reading files."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote; only once everything made from them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_within(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table of short rows, marked for broadcast if counting shows that it stays within the limit; else a shuffle joins it."""
    return F.broadcast(table) if table.count() * ROW_BYTES <= limit else table


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows apart by id and text."""
    return F.md5(F.concat_ws("\x1f", F.xxhash64(id_col, text_col).cast("string"), F.xxhash64(text_col, id_col).cast("string")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once a row: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def file_system(path: str):
    """(pyarrow file system, path in it) of a local path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path
