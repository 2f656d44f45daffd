"""Overtakes, trajectory summaries, and the linking of events to edges."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.operators.points import Journeys
from velotrace.operators.shards import SECOND

CLOSE_PASS_CM = 150.0
MERGE_GAP_S = 3.0
#: Stands for a load time that is not known.
LATEST = datetime(9999, 1, 1, tzinfo=timezone.utc)


def seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def overtake_events(tours: Journeys, merge_gap_s: float = MERGE_GAP_S, close_cm: float = CLOSE_PASS_CM) -> DataFrame:
    """Detections of a trajectory at most merge_gap_s apart, as one event each; points without detection between them don't part them.

    The closest point is the earliest of those with the least value. Detections are ordered per cell; the last
    detection and the number of events come over from the cells before (merge_gap_s must be that of journeys()). No detections give no rows, typed.
    """
    carried = tours.cells.select("boxId", "cell", "traj_id", "c_rows", "c_hit", "c_events")
    hits = tours.hits.join(carried, ["boxId", "cell"]).select("boxId", "cell", "traj_id", "c_rows", "c_hit", "c_events", F.explode("hits").alias("h"))
    here = Window.partitionBy("boxId", "cell").orderBy("h.i")
    before = F.coalesce(F.lag("h.t").over(here), F.col("c_hit"))
    new = hits.withColumn("_new", F.when(F.col("h.t") - before <= int(merge_gap_s * SECOND), 0).otherwise(1))
    numbered = new.select(
        "boxId", "traj_id", (F.col("c_events") + F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0))).alias("event_id"), F.timestamp_micros("h.t").alias("createdAt"), "h.row_seq", "h.value", "h.x", "h.y",
        F.concat("traj_id", F.lit("_p"), (F.col("c_rows") + F.col("h.i")).cast("string")).alias("point_id"),
    )
    at = F.struct("createdAt", "row_seq")
    events = numbered.groupBy("boxId", "traj_id", "event_id").agg(
        F.min("createdAt").alias("start"),
        F.max("createdAt").alias("end"),
        F.count(F.lit(1)).alias("n_samples"),
        F.min("value").alias("min_clearance_cm"),
        F.avg("value").alias("mean_clearance_cm"),
        F.min_by("point_id", at).alias("first_point_id"),
        F.max_by("point_id", at).alias("last_point_id"),
        F.min_by(F.struct("point_id", "x", "y"), F.struct("value", "createdAt", "row_seq")).alias("closest"),
    )
    return events.select(
        F.concat("traj_id", F.lit("_ev"), F.col("event_id").cast("string")).alias("event_uid"), "traj_id", "event_id", "boxId", "start", "end",
        seconds(F.col("start"), F.col("end")).alias("duration_s"), "n_samples", "min_clearance_cm", "mean_clearance_cm", (F.col("min_clearance_cm") < close_cm).alias("is_close"),
        "first_point_id", "last_point_id", F.col("closest.point_id").alias("closest_point_id"), F.col("closest.x").alias("x"), F.col("closest.y").alias("y"),
    )


def summarise(tours: Journeys, events: DataFrame, min_length_km: float = 0.2) -> DataFrame:
    """Per trajectory: extent in time and space, speed, and its overtakes; highest rates first, null rates last."""
    base = tours.cells.groupBy("boxId", "traj_id").agg(
        F.min_by("known_name", F.when(F.col("known_name").isNotNull(), F.col("cell"))).alias("boxName"), F.timestamp_micros(F.min("t0")).alias("start"), F.timestamp_micros(F.max("t1")).alias("end"),
        F.sum("n").alias("n_points"), (F.sum("path_m") / 1000).alias("length_km"),
    )
    per = events.groupBy("boxId", "traj_id").agg(
        F.count(F.lit(1)).alias("n_overtakes"), F.count_if("is_close").alias("n_close_passes"), F.min("min_clearance_cm").alias("min_overtake_cm"),
        F.avg("min_clearance_cm").alias("mean_overtake_cm"), F.avg("duration_s").alias("mean_event_duration_s"),
    )
    minutes = seconds(F.col("start"), F.col("end")) / 60
    s = base.join(per, ["boxId", "traj_id"], "left").withColumn("duration_min", minutes)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rate = F.try_divide(F.coalesce(F.col("n_overtakes"), F.lit(0)).cast("double"), F.nullif(F.when(F.col("length_km") >= min_length_km, F.col("length_km")), F.lit(0.0)))
    return s.select(
        "traj_id", "boxId", "boxName", "start", "end", "n_points", "length_km", "duration_min", F.try_divide("length_km", F.nullif(F.col("duration_min") / 60, F.lit(0.0))).alias("mean_speed_kmh"),
        zero("n_overtakes"), zero("n_close_passes"), "min_overtake_cm", "mean_overtake_cm", "mean_event_duration_s", rate.alias("overtake_rate_per_km"),
    ).orderBy(F.col("overtake_rate_per_km").desc_nulls_last(), "traj_id")


def top_summary(summary: DataFrame, most: int = 15) -> DataFrame:
    """The trajectories with the highest rates of overtakes, for a report."""
    return summary.orderBy(F.col("overtake_rate_per_km").desc_nulls_last(), "traj_id").limit(most)


def event_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_close").alias("n_close"))


def one_edge_per_point(matched: DataFrame) -> DataFrame:
    """point_id, _uv of placed points; of points loaded more than once the earliest load (then lowest u, v)."""
    p = matched.where(F.col("u").isNotNull() & F.col("point_id").isNotNull())
    order = ["loaded_at", "u", "v"] if "loaded_at" in matched.columns else ["u", "v"]
    return p.groupBy("point_id").agg(F.min_by(F.struct("u", "v"), F.struct(*order)).alias("_uv"))


def each_event_once(events: DataFrame) -> DataFrame:
    """One row per event_uid, the one loaded first (if there is a loaded_at), then the lowest in all columns; of rows without event_uid, those equal in all columns once."""
    cols = [F.col(f"`{c}`") for c in events.columns]
    whole = F.struct(*cols)
    order = F.struct(F.coalesce("loaded_at", F.lit(LATEST)), whole) if "loaded_at" in events.columns else F.struct(whole)
    first = events.groupBy("event_uid", F.when(F.col("event_uid").isNull(), whole).alias("_null")).agg(F.min_by(whole, order).alias("_e"))
    return first.select("_e.*")


def link_events(events: DataFrame, matched: DataFrame) -> DataFrame:
    """Events with u, v of their closest point, else of their first, else of their last: whichever is placed first; v is of the same point as u.

    One join: an event's points are put in a row by priority and the best placed one is taken. An event without
    event_uid is linked like any other; repeated events come out as often.
    """
    bare = events.drop("u", "v", "edge_class")
    ids = ("closest_point_id", "first_point_id", "last_point_id")
    keyed = bare.withColumn("_event", F.struct("event_uid", *ids))  # a struct is not null, whatever is in it
    wanted = keyed.select("_event", F.posexplode(F.array(*ids)).alias("_prio", "point_id")).where(F.col("point_id").isNotNull())
    best = wanted.join(one_edge_per_point(matched), "point_id").groupBy("_event").agg(F.min_by("_uv", "_prio").alias("_uv"))
    return keyed.join(best, "_event", "left").select(*bare.columns, F.col("_uv.u").alias("u"), F.col("_uv.v").alias("v"))


def pair(df: DataFrame) -> DataFrame:
    """Adds the undirected edge key a <= b; null if either end is."""
    both = F.col("u").isNotNull() & F.col("v").isNotNull()
    return df.withColumns({"_a": F.when(both, F.least("u", "v")), "_b": F.when(both, F.greatest("u", "v"))})


def class_of_pairs(edges: DataFrame) -> DataFrame:
    """One class per node pair: that of the lowest (u, v, key)."""
    e = pair(edges.select("u", "v", "key", "edge_class")).where(F.col("_a").isNotNull())
    return e.groupBy("_a", "_b").agg(F.min_by("edge_class", F.struct("u", "v", "key")).alias("edge_class"))


def join_edge_class(events: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Events with edge_class of their node pair in either direction; null if there is none, or without edges, or if these have no u, v."""
    bare = events.drop("edge_class")
    if edges is None or not {"u", "v"} <= set(edges.columns):
        return bare.withColumn("edge_class", F.lit(None).cast("string"))
    return pair(bare).join(class_of_pairs(edges), ["_a", "_b"], "left").select(*bare.columns, "edge_class")


def events_per_class(events: DataFrame) -> DataFrame:
    return events.where(F.col("edge_class").isNotNull()).groupBy("edge_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "edge_class")


def linked_share(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.count("u").alias("n_linked"), F.avg(F.col("u").isNotNull().cast("int")).alias("linked_share"))
