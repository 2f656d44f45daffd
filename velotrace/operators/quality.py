"""Trajectory quality: measures, flags and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotrace.operators.points import Journeys


@dataclass(frozen=True)
class Limits:
    """Bounds of an ordinary trajectory."""

    speed_min_kmh: float = 3.0
    speed_max_kmh: float = 40.0
    nonzero_share_max: float = 0.40
    run_fraction_max: float = 0.30
    raw_per_km_max: float = 250.0
    min_points: int = 5
    min_length_km: float = 0.2


# Flags in the order in which reasons are listed, and the words for them.
REASONS = {"f_speed": "speed", "f_nz_share": "nz_share", "f_long_run": "long_run", "f_rate": "high_rate", "f_too_short": "too_short"}


def longest_run() -> Column:
    """Of a trajectory's cells: most detections in a row, 0 if there are none; a null value ends a run. A run over borders is told by what a cell takes over."""
    return F.max(F.greatest("longest", F.col("c_run") + F.col("head"))).cast("long")


def longest_runs(tours: Journeys) -> DataFrame:
    """boxId, traj_id, longest_nonzero_run."""
    return tours.cells.groupBy("boxId", "traj_id").agg(longest_run().alias("longest_nonzero_run"))


def trajectory_stats(tours: Journeys, min_length_km: float = 0.2) -> DataFrame:
    """Measures per trajectory. Null values count as points; value_max is null if any value is; no speed without duration, no rate under min_length_km."""
    hours = (F.col("t1") - F.col("t0")) / 3.6e9
    stats = tours.cells.groupBy("boxId", "traj_id").agg(
        F.min_by("name", "cell")["boxName"].alias("boxName"),
        F.sum("n").alias("n_points"),
        F.sum("n_hits").alias("n_nonzero"),
        (F.sum("n_hits") / F.sum("n")).alias("nonzero_share"),
        F.when(F.sum("n_known") == F.sum("n"), F.max("value_max")).alias("value_max"),
        (F.sum("path_m") / 1000).alias("length_km"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        longest_run().alias("longest_nonzero_run"),
    )
    long_enough = F.when(F.col("length_km") >= min_length_km, F.col("length_km"))
    return stats.withColumn("mean_speed_kmh", F.try_divide("length_km", F.nullif(hours, F.lit(0.0)))).withColumn("raw_per_km", F.try_divide(F.col("n_nonzero").cast("double"), F.nullif(long_enough, F.lit(0.0)))).drop("t0", "t1")


def quality_table(stats: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Flags, reasons and keep per trajectory; a null measure never flags."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    v = F.col("mean_speed_kmh")
    q = stats.withColumns(
        {
            "f_speed": flag((v < limits.speed_min_kmh) | (v > limits.speed_max_kmh)),
            "f_nz_share": flag(F.col("nonzero_share") > limits.nonzero_share_max),
            "f_long_run": flag(F.col("longest_nonzero_run") / F.col("n_points") > limits.run_fraction_max),
            "f_rate": flag(F.col("raw_per_km") > limits.raw_per_km_max),
            "f_too_short": flag((F.col("n_points") < limits.min_points) | (F.col("length_km") < limits.min_length_km)),
        }
    )
    n = sum((F.col(f).cast("int") for f in REASONS), F.lit(0))
    why = F.concat_ws(",", *[F.when(F.col(f), F.lit(r)) for f, r in REASONS.items()])
    q = q.withColumns({"n_flags": n, "flag_reasons": F.coalesce(F.nullif(why, F.lit("")), F.lit("ok")), "keep": n == 0})
    return q.select(
        "traj_id", "boxId", "boxName", "keep", "n_flags", "flag_reasons", "n_points", "length_km", "mean_speed_kmh", "nonzero_share", "longest_nonzero_run", "raw_per_km", "value_max", "n_nonzero", *REASONS
    )


def worst_first(quality: DataFrame) -> DataFrame:
    """The quality table as it is listed: bad trajectories first, those with most flags at the top."""
    return quality.orderBy("keep", F.col("n_flags").desc(), "traj_id")


def good_trajectories(quality: DataFrame) -> DataFrame:
    return quality.where("keep").select("traj_id")


def keep_summary(quality: DataFrame) -> DataFrame:
    return quality.agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("n_kept"), F.avg(F.col("keep").cast("int")).alias("kept_share"))


def flag_counts(quality: DataFrame) -> DataFrame:
    """flag, n: how many trajectories have each flag."""
    counts = quality.agg(*[F.count_if(f).alias(f) for f in REASONS])
    return counts.unpivot([], list(REASONS), "flag", "n")


def flag_histogram(quality: DataFrame) -> DataFrame:
    return quality.groupBy("n_flags").agg(F.count(F.lit(1)).alias("n")).orderBy("n_flags")


def box_keep_rates(quality: DataFrame, most: int = 15) -> DataFrame:
    """The boxes with the lowest share of kept trajectories: n, keep_rate rounded half-even to two places. Boxes with a null id or name are left out."""
    rates = quality.dropna(subset=["boxId", "boxName"]).groupBy("boxId", "boxName").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("keep").cast("int")).alias("rate"))
    return rates.select("boxId", "boxName", "n", F.bround("rate", 2).alias("keep_rate")).orderBy("keep_rate", "boxId", "boxName").limit(most)


def box_overview(tours: Journeys, share_max: float = 0.40) -> DataFrame:
    """Per box: points, trajectories, share and highest of detections, and whether the sensor looks stuck; boxes with most points first."""
    o = tours.cells.groupBy("boxId").agg(F.sum("n").alias("n_points"), F.count_distinct("traj_id").alias("n_trajectories"), (F.sum("n_hits") / F.sum("n")).alias("nonzero_share"), F.max("value_max").alias("value_max"))
    return o.withColumn("looks_stuck", F.col("nonzero_share") > share_max).orderBy(F.col("n_points").desc(), "boxId")
