"""Runs of repeated consecutive events, each as one row (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotrace.operators.runlength import Alike, joined, pieces
from velotrace.operators.shards import SECOND, sharded, usable

NEAR = Alike(tolerance=3.0, gap_us=3 * SECOND, least=3, lowest=0.0)
SAME = Alike(tolerance=0.0, gap_us=20 * SECOND, least=2)


def collapse(events: DataFrame, alike: Alike, shard_s: int = 600, ride_gap_s: int | None = None, min_rows: int = 1, copies: bool = False) -> DataFrame:
    """entity, start_us, end_us, n, duration_us, v0, v1: maximal runs of alike successive events of an entity.

    events: entity, t, t_end (epoch microseconds), id (order of equal t), item (false: a row that counts for its
    ride but is no event), v. A state machine goes over each sorted time shard and compares every event with the
    one before, under the tolerance and time gap of alike; runs that reach a shard's border are joined with what the
    shard before it carries over. A null v is an event like no other, so it ends a run. ride_gap_s must be shard_s or None.

    Rows without entity or t are left out; a null t_end is t; repeated rows are repeated events unless copies is set; no rows give none.
    """
    if ride_gap_s not in (None, shard_s):
        raise ValueError("a shard must be as wide as the gap that ends a ride")
    rows = events.where(F.col("entity").isNotNull() & F.col("t").isNotNull()).withColumn("t_end", F.coalesce("t_end", "t"))
    gap = None if ride_gap_s is None else ride_gap_s * SECOND
    runs = joined(pieces(sharded(rows, shard_s * SECOND), alike, copies), alike, gap, min_rows)
    return runs.select("entity", F.col("t0").alias("start_us"), F.col("t1").alias("end_us"), "n", (F.col("t1") - F.col("t0")).alias("duration_us"), "v0", "v1")


def reading_runs(readings: DataFrame, alike: Alike = NEAR, gap_s: int = 600, min_readings: int = 5) -> DataFrame:
    """Runs of alike successive numbers of a box, within its rides; readings that are no numbers are passed over."""
    rows = usable(readings).select(
        F.col("box").alias("entity"), "t", F.col("t").alias("t_end"), F.col("row_seq").alias("id"), F.col("num").isNotNull().alias("item"), F.col("num").alias("v")
    )
    return collapse(rows, alike, shard_s=gap_s, ride_gap_s=gap_s, min_rows=min_readings, copies=True)


def overtake_runs(events: DataFrame, alike: Alike = SAME) -> DataFrame:
    """Runs of overtakes of a ride with equal n_samples; copies of an event (ride, start, event_id) count once."""
    t, end = F.unix_micros("start"), F.unix_micros("end")
    one = events.groupBy(F.col("traj_id").alias("entity"), t.alias("t"), F.col("event_id").alias("id")).agg(F.max(end).alias("t_end"), F.max(F.col("n_samples").cast("double")).alias("v"))
    return collapse(one.withColumn("item", F.lit(True)), alike)
