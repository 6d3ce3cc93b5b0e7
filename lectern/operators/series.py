"""Sensor time series: loading, profiles, range statistics, buckets and trends, per tag in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOPE_DIGITS = 6
VALUE_DIGITS = 9  # beyond what means of measured values resolve, so that no value lies on a rounding border


def load_series(wide: DataFrame, time: str, tags: Sequence[str] | None = None) -> DataFrame:
    """Typed wide frame: unreadable times drop the row (the row of tag codes too), unreadable numbers become NULL."""
    tags = list(tags or [c for c in wide.columns if c != time])
    ts = F.try_to_timestamp(F.col(time)).cast("timestamp_ntz")
    values = [F.expr(f"try_cast(`{t}` AS double)").alias(t) for t in tags]
    return wide.select(ts.alias("ts"), *values).where(F.col("ts").isNotNull())


def to_long(wide: DataFrame, tags: Sequence[str], time: str = "ts") -> DataFrame:
    """(ts, tag, value) rows of the wide frame."""
    return wide.unpivot([time], list(tags), "tag", "value").withColumnRenamed(time, "ts")


def _stats() -> list[Column]:
    return [
        F.round(F.avg("value"), VALUE_DIGITS).alias("mean_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    ]


def series_profile(long: DataFrame) -> DataFrame:
    """Rows, time range, mean and extremes per tag."""
    return long.groupBy("tag").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *_stats())


def range_stats(long: DataFrame, start: Column, end: Column) -> DataFrame:
    """Statistics within [start, end], with the earliest time of each extreme."""
    rows = long.where((F.col("ts") >= start) & (F.col("ts") <= end))
    filled = rows.where(F.col("value").isNotNull())
    low = F.min_by("ts", F.struct("value", "ts"))
    # The earliest of the largest values: smallest (-value, ts).
    high = F.min_by("ts", F.struct((-F.col("value")).alias("v"), "ts"))
    return filled.groupBy("tag").agg(F.count("*").alias("n"), *_stats(), low.alias("min_at"), high.alias("max_at"))


def resample(long: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Mean, extremes and count per tag and time bucket; works on a stream as well."""
    return (
        long.groupBy("tag", F.window("ts", width).alias("w"))
        .agg(F.count("value").alias("n"), *_stats())
        .select("tag", F.col("w.start").alias("bucket"), "n", "mean_value", "min_value", "max_value")
    )


def trend(long: DataFrame, flat: float = 0.0) -> DataFrame:
    """Slope per hour and direction per tag, and the change from the first to the last value."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    rows = long.where(F.col("value").isNotNull()).withColumn("_h", hours)
    out = rows.groupBy("tag").agg(
        F.round(F.regr_slope("value", "_h"), SLOPE_DIGITS).alias("slope"),
        F.round(F.max_by("value", "ts") - F.min_by("value", "ts"), VALUE_DIGITS).alias("change"),
        F.count("*").alias("n"),
    )
    direction = F.when(F.col("slope") > flat, "up").when(F.col("slope") < -flat, "down").otherwise("flat")
    return out.withColumn("direction", direction)
