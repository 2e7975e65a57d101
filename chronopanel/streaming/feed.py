"""A growing daily feed, rolled up as its files land.

The batch form re-reads the whole history on every run.  Here each run takes
only the files that arrived since the last one and adds finished weeks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_feed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def weekly_totals(
    feed: DataFrame, ts: str, key: Sequence[str], measures: dict[str, Column], late: str = "1 day"
) -> DataFrame:
    """Sums per key and Monday week; a week is final once the feed is ``late`` past its end."""
    # Tumbling windows start on Thursdays (the epoch day); four days make it Monday.
    week = F.window(ts, "7 days", startTime="4 days")
    feed = feed.withColumn(ts, F.col(ts).cast("timestamp"))  # event time needs a zoned type
    out = feed.withWatermark(ts, late).groupBy(week.alias("w"), *key).agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    return out.select(F.to_date("w.start").alias("week"), *key, *measures)


def append_finished(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, write the finished weeks, stop."""
    return (
        totals.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
