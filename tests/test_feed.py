"""The incremental roll-up equals the batch roll-up on the finished weeks."""

from pyspark.sql import functions as F

from chronopanel.operators.aggregate import roll_up
from chronopanel.streaming import feed

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_two_runs_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select("ts", "event_type", "value")
    landing, out, chk = (str(tmp_path / n) for n in ("landing", "out", "chk"))
    cut = F.lit("2024-01-15").cast("timestamp")
    measures = {"n": F.count(F.lit(1)), "total": F.sum("value")}
    for part in (events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)):
        part.coalesce(1).write.mode("append").parquet(landing)
        totals = feed.weekly_totals(feed.read_feed(spark, landing, events.schema), "ts", ["event_type"], measures)
        feed.append_finished(totals, out, chk).awaitTermination()
    got = {(str(r.week), r.event_type): (r.n, round(r.total, 6)) for r in spark.read.parquet(out).collect()}
    batch = roll_up(events, "ts", "week", ["event_type"], "week", **measures).df
    want = {(str(r.week), r.event_type): (r.n, round(r.total, 6)) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    weeks = sorted({k[0] for k in want})
    assert sorted({k[0] for k in got}) == weeks[:-1]
