"""The crawl log as a stream or a batch: active time, rates, outcomes, URLs seen once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def active_windows(log: DataFrame, ts: str = "ts", width: str = "10 minutes", late: str | None = None) -> DataFrame:
    """(start, n) of each window with rows. With `late`, rows may be that late and a stream appends closed windows."""
    held = log.withWatermark(ts, late) if late else log
    return held.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def activity(log: DataFrame, ts: str = "ts", minutes: int = 10) -> DataFrame:
    """One row: rows, windows with rows, and rows a second over that active time."""
    per = active_windows(log, ts, f"{minutes} minutes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("windows"))
    return per.select("events", "windows", F.try_divide(F.col("events").cast("double"), F.col("windows") * F.lit(60.0 * minutes)).alias("per_second"))


def rate(log: DataFrame, ts: str = "ts", seconds: int = 5, by: str | None = None) -> DataFrame:
    """(start, n, rate, change): rows a second of each window and the change from the one before, within a day."""
    per = active_windows(log, ts, f"{seconds} seconds")
    order = Window.partitionBy(F.to_date("start")).orderBy("start")
    return per.withColumn("rate", F.col("n") / F.lit(float(seconds))).withColumn("change", F.col("rate") - F.lag("rate").over(order))


def first_seen(log: DataFrame, url: str = "url", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each URL once within the watermark, in a stream; once at all in a batch."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark([url]) if log.isStreaming else log.dropDuplicates([url])
