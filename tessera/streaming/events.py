"""Structured Streaming over event and vintage streams; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; offsets are in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, width: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """Events and users per window and type."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def over_budget(events: DataFrame, budget: int, width: str = "10 minutes") -> DataFrame:
    """Users with more than ``budget`` events in a window."""
    return events.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > budget).select(F.col("w.start").alias("start"), "user_id", "n")


def sliding(events: DataFrame, width: str = "3 days", step: str = "1 day") -> DataFrame:
    """Mean value per sliding window."""
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "mean", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once_each(events: DataFrame, key: str = "event_id", watermark: str | None = None) -> DataFrame:
    """Repeated deliveries dropped: within the watermark in a stream, for good in a batch."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key]) if watermark else events.dropDuplicates([key])


def open_period(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Totals per window; the last one is preliminary."""
    days = events.groupBy(F.window("ts", width).alias("w")).agg(F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "total")
    last = days.agg(F.max("start").alias("last"))
    return days.join(F.broadcast(last)).select("start", "total", (F.col("start") == F.col("last")).alias("preliminary"))


def year_to_date(events: DataFrame) -> DataFrame:
    """Running total of a month's days, broken by the first day without events."""
    days = events.groupBy(F.date_trunc("month", "ts").alias("month"), F.dayofmonth("ts").cast("long").alias("day")).agg(F.sum("value").alias("v"))
    upto = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min("day").over(Window.partitionBy("month"))
    return days.withColumn("k", F.count(F.lit(1)).over(upto)).withColumn("first", first).withColumn("total", F.round(F.sum("v").over(upto), 4)).filter("k = day - first + 1").select("month", "day", "total")


def write_available(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Append what is there now to Parquet, exactly once, and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(partition) if partition else writer).start()
