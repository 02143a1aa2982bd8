"""Streams of events: sums by day and sessions by gap, with watermarks. An extension: the batch operators are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import scratch_dir


def daily_sums(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n, value) of a stream of (ts, event_type, value); rows later than ``late`` are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): sessions that end after ``gap`` without events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now, into a table on shared storage: ``complete`` results replace each other, ``append``
    adds them up. State and result lie in scratch folders; nothing but progress reaches the driver."""
    if mode not in ("complete", "append"):
        raise ValueError("mode is complete or append")
    spark = stream.sparkSession
    where = scratch_dir(spark)
    spark.createDataFrame([], stream.schema).write.parquet(where)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(where)

    q = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", scratch_dir(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(where)
