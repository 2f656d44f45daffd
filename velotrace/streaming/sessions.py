"""Gap sessions over a stream: trajectories and overtakes as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotrace.functions.clean import number


def cleaned(raw: DataFrame) -> DataFrame:
    """Readings of a stream (or table) with position, time and box, and value as a number or null."""
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("createdAt").isNotNull() & F.col("boxId").isNotNull()
    return raw.where(ok).withColumn("value", number(F.col("value")))


def trajectory_sessions(readings: DataFrame, gap: str = "10 minutes", late: str = "30 minutes", min_points: int = 5) -> DataFrame:
    """boxId, start, end (of the last reading), n_points, n_nonzero per trajectory; a gap strictly above `gap` parts two.

    Emitted once the watermark has passed the end (append mode); readings later than `late` are dropped. State per box is its open session.
    """
    s = F.session_window("createdAt", gap)
    hit = F.coalesce(F.col("value") > 0, F.lit(False))
    g = readings.withWatermark("createdAt", late).groupBy("boxId", s.alias("s")).agg(
        F.min("createdAt").alias("start"), F.max("createdAt").alias("end"), F.count(F.lit(1)).alias("n_points"), F.sum(hit.cast("long")).alias("n_nonzero")
    )
    return g.where(F.col("n_points") >= min_points).select("boxId", "start", "end", "n_points", "n_nonzero")


def overtake_sessions(readings: DataFrame, gap: str = "3 seconds", late: str = "30 minutes", close_cm: float = 150.0) -> DataFrame:
    """boxId, start, end, n_samples, min and mean clearance, is_close per burst of detections."""
    g = readings.where(F.col("value") > 0).withWatermark("createdAt", late).groupBy("boxId", F.session_window("createdAt", gap).alias("s")).agg(
        F.min("createdAt").alias("start"), F.max("createdAt").alias("end"), F.count(F.lit(1)).alias("n_samples"), F.min("value").alias("min_clearance_cm"), F.avg("value").alias("mean_clearance_cm")
    )
    return g.select("boxId", "start", "end", "n_samples", "min_clearance_cm", "mean_clearance_cm", (F.col("min_clearance_cm") < close_cm).alias("is_close"))
