"""Queries of problems 1 to 5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotrace.operators.orphans import event_orphans, event_references, orphan_report
from velotrace.operators.regions import edges_near_detections
from velotrace.operators.regular import missing_periods, regular_series
from velotrace.operators.spikes import strange_readings, strange_rides
from velotrace.operators.stops import found_slots, trips_and_stops
from velotrace.sources.tables import EDGES, READINGS, table

Query = Callable[[SparkSession, str], DataFrame]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ("matched_events", "matched_points", "retracted_points", "network_nodes", EDGES)
    return event_orphans(*(table(spark, d, n) for n in names))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("event_uid", "ref_field")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), event_references(table(spark, d, "matched_events"))).withColumn("orphan_share", F.round("orphan_share", 9))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return edges_near_detections(table(spark, d, READINGS), table(spark, d, EDGES)).select("row_seq", "u", "v", "edge_key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return missing_periods(regular_series(table(spark, d, READINGS)))


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    s = regular_series(table(spark, d, READINGS))
    return s.withColumn("mean_value", F.round("mean_value", 9))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    readings = strange_readings(table(spark, d, READINGS)).select(F.lit("reading").alias("kind"), F.col("row_seq").cast("string").alias("record_id"))
    ridden = strange_rides(table(spark, d, "trajectory_quality")).select(F.lit("trajectory").alias("kind"), F.col("traj_id").alias("record_id"))
    return readings.unionByName(ridden).distinct()


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    readings = strange_readings(table(spark, d, READINGS)).select(F.lit("reading").alias("kind"), F.col("row_seq").cast("string").alias("record_id"), "reason")
    ridden = strange_rides(table(spark, d, "trajectory_quality")).select(F.lit("trajectory").alias("kind"), F.col("traj_id").alias("record_id"), "reason")
    return readings.unionByName(ridden).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return found_slots(trips_and_stops(table(spark, d, READINGS)))


def p5_trips_stops(spark: SparkSession, d: str) -> DataFrame:
    return trips_and_stops(table(spark, d, READINGS))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p3_series, p4_found, p4_reasons, p5_found, p5_trips_stops)}
