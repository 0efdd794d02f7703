"""The run log as a stream: an extra beside the batch operators, which alone are part of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_runs(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each run_id once, however often it is sent within the time allowed for late rows."""
    return runs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id"])


def daily_spend(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Cents and runs of each day, given out when the day can no longer change."""
    rows = runs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    cents = F.round(F.coalesce("cost", F.lit(0.0)) * 100).cast("long")
    days = rows.groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("runs"))
    return days.select(F.to_date("w.start").alias("day"), "cents", "runs")


def append(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of runs to the log by day, exactly once."""
    rows = distinct_runs(runs).withColumn("day", F.to_date("ts"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
