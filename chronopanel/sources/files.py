"""Reading landed tables and writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chronopanel.panel import numbered


def read_csv(spark: SparkSession, path: str, schema: StructType, row_number: bool = False) -> DataFrame:
    """CSV with a header and a fixed schema.

    Columns are matched by position, so a byte-order mark in front of the first
    header name does no harm.  ``row_number`` drops an unnamed first column.
    """
    if row_number:
        schema = StructType([StructField("__row", StringType()), *schema.fields])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "NA")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
    return df.drop("__row") if row_number else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A warehouse table or view by name."""
    return spark.table(name)


def latest_snapshot(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of the newest snapshot ``<name>_<month>_<day>_<year>``, a CSV file or a folder of CSV files.

    Names alone decide, from the folder listing; only the newest snapshot's files
    are read.  The score ``50 month + day + 1000 year`` keeps calendar order; the
    first name in order wins a tie.  A folder without snapshots gives no rows.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")
    parts = [F.regexp_extract("path", r"([^/]*)_(\d+)_(\d+)_(\d+)(\.csv)?(/[^/]*)?$", k) for k in range(1, 5)]
    name = F.regexp_extract("path", r"([^/]*_\d+_\d+_\d+)(\.csv)?(/[^/]*)?$", 1)
    files = listing.select("path", name.alias("name"), *[x.try_cast("long").alias(c) for x, c in zip(parts[1:], ("m", "d", "y"))]).where("name <> ''")
    best = files.groupBy((F.col("y") * 1000 + F.col("m") * 50 + F.col("d")).alias("score")).agg(F.min("name").alias("name"))
    top = best.agg(F.max_by("name", "score")).first()[0]
    if top is None:
        return spark.createDataFrame([], schema)
    paths = [r.path for r in files.where(F.col("name") == top).select("path").collect()]
    return spark.read.schema(schema).option("header", True).csv(paths)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, partitions: Sequence[str] = ("run_date", "p")) -> None:
    """Partitioned results; only the partitions present in ``df`` are replaced."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_latest(df: DataFrame, path: str) -> None:
    """Replace the undated copy of the newest results."""
    df.write.mode("overwrite").parquet(path)


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """Row numbers over a whole table, as some sinks want them; no task sorts the whole table."""
    return numbered(df, [], order, name)


def register_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Temporary views over landed parquet tables, for SQL by name."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
