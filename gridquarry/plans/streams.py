"""Incremental builds, run over all the events there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental as ops
from .registry import query
from .scores import tidy
from .sources import shared
from .tables import TRUTH, table


def events(spark, sf):
    """The events as a stream, with a zoned time stamp, which watermarks need."""
    schema = table(spark, sf, "events").schema
    return ops.stream_of(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("p01_append_only_build", "SELECT event_type AS feature, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def append_only(spark, sf):
    """Events appended by batch, in folders of 4,096 ids; a second run, and another stream of the same events, find nothing new."""
    folder, part = shared(spark), F.expr("event_id div 4096")
    ops.append_new(events(spark, sf), folder, ["event_id"], part)
    rows = ops.append_new(events(spark, sf), folder, ["event_id"], part)
    return rows.groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


#: Windows that end after the watermark (the latest event less the lateness) stay open.
OPEN = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("p02_tumbling_windows", f"SELECT * FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(avg(value)*{TRUTH}, 6) AS mean FROM events GROUP BY ALL) WHERE start + INTERVAL 6 HOUR <= {OPEN}")
def tumbling(spark, sf):
    rows = ops.run_once(ops.window_means(events(spark, sf), "ts", "value", ["event_type"], "6 hours", "1 hour"), shared(spark))
    return tidy(rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": F.col("mean") * TRUTH}), 6)


@query("p03_complete_days", f"SELECT * FROM (SELECT CAST(ts AS DATE) AS day, count(DISTINCT hour(ts))::INT AS hours, round(CASE WHEN count(DISTINCT hour(ts)) = 24 THEN avg(value)*{TRUTH} END, 6) AS mean FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= {OPEN}")
def complete_days(spark, sf):
    rows = ops.run_once(ops.complete_days(events(spark, sf), "ts", "value", "1 hour"), shared(spark))
    return tidy(rows.withColumn("mean", F.col("mean") * TRUTH), 6)


@query("p05_stateful_streaks", f"""WITH e AS (SELECT user_id, ts, value > 3 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    h AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY ts) AS island FROM e WHERE high), r AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, max(i) < any_value(n) AS ended FROM h GROUP BY user_id, island)
    SELECT user_id, first, last, n FROM r WHERE ended OR last + INTERVAL 1 DAY < {OPEN}""")
def streaks(spark, sf):
    """Runs of high values of each user, kept in state between batches."""
    rows = events(spark, sf).withColumn("high", F.col("value") > 3)
    rows = ops.run_once(ops.streaks(rows, "user_id", "ts", "high", "1 hour"), shared(spark))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("p06_order_free_writes", "SELECT event_id % 16 AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def order_free(spark, sf):
    """Rows written in any order; their key places them."""
    folder = shared(spark)
    rows = table(spark, sf, "events").withColumn("part", F.col("event_id") % 16)
    rows.repartition("part").write.partitionBy("part").parquet(folder)
    return tidy(spark.read.parquet(folder).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum("value").alias("total")))
