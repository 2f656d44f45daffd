"""Irregular readings onto a regular grid (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velotrace.functions.clean import floor_div
from velotrace.operators.shards import SECOND, dedup, rides, sharded, usable
from velotrace.session import cut


def regular_series(readings: DataFrame, period_s: int = 10, gap_s: int = 600, min_readings: int = 5) -> DataFrame:
    """One row per ride and period from the period of its first to that of its last reading.

    Columns: box_id, ride_t0_us, cell_s (start of the period, epoch seconds), n_numbers, mean_value,
    last_value (both null without a number), filled_value (the last number of the ride up to this
    period, carried over shards; null before its first number), status: observed, filled or empty.

    Shards are as wide as the gap that ends a ride, so all readings of a shard are of one ride, and no
    shard inside a ride is empty. Each shard is summed up to one row, which is written once; a prefix scan over slim rows (times,
    count and last number of each shard) gives the rides and the number carried in; then the shards are filled on their own.

    Null box, time or position: not a reading. Text that is no number: a reading without a number.
    Copies (equal box and time): the lowest row_seq. No rows, or rides under min_readings: no rows.
    """
    if gap_s % period_s:
        raise ValueError("gap_s must be a multiple of period_s")
    gap = gap_s * SECOND
    rows = dedup(sharded(usable(readings), gap), ("num",)).withColumn("slot", floor_div(F.col("t"), period_s * SECOND))
    slots = rows.groupBy("box", "shard", "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("num").alias("n_numbers"),
        F.avg("num").alias("mean"),
        F.max_by("num", F.when(F.col("num").isNotNull(), F.col("t"))).alias("last"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
    )
    seen = F.when(F.col("n_numbers") > 0, F.struct("slot", "n_numbers", "mean", "last"))
    shards = cut(slots.groupBy("box", "shard").agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_sort(F.collect_list(seen)).alias("seen")))
    slim = rides(shards.select("box", "shard", "n", "t0", "t1", F.try_element_at("seen", F.lit(-1))["last"].alias("tail")), gap, min_readings)
    before = Window.partitionBy("box", "ride").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = slim.select("box", "shard", "ride_t0", "ride_t1", F.last("tail", ignorenulls=True).over(before).alias("carry"))
    per = gap_s // period_s
    first = F.greatest(F.col("shard") * per, floor_div(F.col("ride_t0"), period_s * SECOND))
    final = F.least(F.col("shard") * per + per - 1, floor_div(F.col("ride_t1"), period_s * SECOND))
    # joined by shard, so that what a source has is spread again before it grows
    spread = shards.select("box", "shard", "seen").join(carried, ["box", "shard"]).withColumn("slot", F.explode(F.sequence(first, final)))
    here = F.filter("seen", lambda s: s["slot"] <= F.col("slot"))
    spread = spread.withColumn("now", F.try_element_at(here, F.lit(-1)))
    hit = F.col("now")["slot"] == F.col("slot")
    filled = F.coalesce(F.col("now")["last"], F.col("carry"))
    return spread.select(
        F.col("box").alias("box_id"),
        F.col("ride_t0").alias("ride_t0_us"),
        (F.col("slot") * period_s).alias("cell_s"),
        F.when(hit, F.col("now")["n_numbers"]).otherwise(F.lit(0)).cast("long").alias("n_numbers"),
        F.when(hit, F.col("now")["mean"]).alias("mean_value"),
        F.when(hit, F.col("now")["last"]).alias("last_value"),
        filled.alias("filled_value"),
        F.when(hit, F.lit("observed")).when(filled.isNotNull(), F.lit("filled")).otherwise(F.lit("empty")).alias("status"),
    )


def missing_periods(series: DataFrame) -> DataFrame:
    """box_id, cell_s of the periods without a number."""
    return series.where(F.col("n_numbers") == 0).select("box_id", "cell_s")
