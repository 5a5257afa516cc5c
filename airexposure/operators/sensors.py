"""Cleaning of sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_range(readings: DataFrame, low: float = 0.0, high: float = 500.0) -> DataFrame:
    return readings.filter(F.col("pm").between(low, high))


def mad_filter(readings: DataFrame, k: float = 6.0) -> DataFrame:
    """Readings within k robust deviations of their sensor-day's median; days without spread keep all."""
    w = Window.partitionBy("sensor_index", "day")
    mid = readings.withColumn("_m", F.median("pm").over(w)).withColumn("_d", F.abs(F.col("pm") - F.col("_m")))
    scaled = mid.withColumn("_s", 1.4826 * F.median("_d").over(w))
    return scaled.filter("_s is null or _s = 0 or _d / _s <= %r" % k).drop("_m", "_d", "_s")


def step_filter(readings: DataFrame, most: float = 150.0) -> DataFrame:
    """Readings that differ from the sensor's previous one by at most ``most``; the first stays."""
    before = F.lag("pm").over(Window.partitionBy("sensor_index").orderBy("datetime_utc", "event_id"))
    return readings.withColumn("_b", before).filter(F.col("_b").isNull() | (F.abs(F.col("pm") - F.col("_b")) <= most)).drop("_b")


def with_readings(features: DataFrame, readings: DataFrame) -> DataFrame:
    """Features whose sensor has readings in the feature's region."""
    return features.join(readings.select("region", "sensor_index").distinct(), ["region", "sensor_index"], "left_semi")
