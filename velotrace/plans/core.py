"""Queries of the trajectory, quality, event, network and matching operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velotrace.functions.geo import point_segment_distance
from velotrace.operators import events as ev
from velotrace.operators import matching as mm
from velotrace.operators import network as nw
from velotrace.operators import points as pt
from velotrace.operators import quality as ql
from velotrace.plans import stages
from velotrace.sources.tables import EDGES, READINGS, table
from velotrace.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTERED[f.__name__] = f
    return f


def us(c: str) -> Column:
    return F.unix_micros(c).alias(f"{c}_us")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def decimetres(line: str) -> Column:
    """A line as text: its corners in whole decimetres."""
    corner = lambda p: F.concat_ws(" ", *[F.round(p[c] * 10).cast("long").cast("string") for c in "xy"])
    return F.array_join(F.transform(line, corner), ",")


def points(spark: SparkSession, d: str) -> DataFrame:
    return pt.load_points(table(spark, d, READINGS))


def traced(spark: SparkSession, d: str) -> DataFrame:
    return pt.trace(pt.segment(points(spark, d)))


def journeys(spark: SparkSession, d: str) -> pt.Journeys:
    return pt.journeys(points(spark, d))


def quality(spark: SparkSession, d: str) -> DataFrame:
    return ql.quality_table(ql.trajectory_stats(journeys(spark, d)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return nw.unique_edges(table(spark, d, EDGES))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return nw.classify_edges(edges(spark, d))


def chords(spark: SparkSession, d: str) -> DataFrame:
    return mm.straight_map(table(spark, d, EDGES), table(spark, d, "network_nodes"))


def linked(spark: SparkSession, d: str) -> DataFrame:
    return ev.link_events(ev.each_event_once(table(spark, d, "overtake_events")), table(spark, d, "matched_points"))


# scans and cleaning


@query
def bad_rows_dropped(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, READINGS).agg(F.count(F.lit(1)).alias("n_rows"))
    kept = points(spark, d).agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("value").isNull()).alias("n_null_value"))
    return raw.join(F.broadcast(kept), F.lit(True))  # one row each


@query
def utm_project(spark: SparkSession, d: str) -> DataFrame:
    return rounded(points(spark, d).select("row_seq", "x", "y"), x=2, y=2)


@query
def network_extent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pt.node_extent(table(spark, d, "network_nodes")), x_min=3, y_min=3, x_max=3, y_max=3)


@query
def clip_bbox(spark: SparkSession, d: str) -> DataFrame:
    return pt.load_points(table(spark, d, READINGS), pt.node_extent(table(spark, d, "network_nodes"))).select("row_seq", "boxId")


@query
def marker_sizes(spark: SparkSession, d: str) -> DataFrame:
    v = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(250.0))
    return points(spark, d).where("value > 0").select("row_seq", F.round(F.lit(3.0) + 50 * F.sqrt(v / 250), 6).alias("size"))


@query
def box_labels(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("boxId", "boxName").distinct()
    safe = F.substring(F.regexp_replace(F.coalesce("boxName", "boxId"), r"(?U)[^\w.-]+", "_"), 1, 60)
    return p.select("boxId", safe.alias("file_name"), F.concat(F.coalesce(F.col("boxName"), F.lit("")), F.lit(" ("), F.right("boxId", F.lit(6)), F.lit(")")).alias("label"))


# trajectories


@query
def traj_segment(spark: SparkSession, d: str) -> DataFrame:
    return pt.carried(points(spark, d)).groupBy("boxId", "traj_id").agg(F.sum("n").alias("n_points"), F.min("t0").alias("start_us"), F.max("t1").alias("end_us"))


@query
def traj_length(spark: SparkSession, d: str) -> DataFrame:
    return journeys(spark, d).cells.groupBy("boxId", "traj_id").agg(F.round(F.sum("path_m") / 1000, 4).alias("length_km")).drop("boxId")


@query
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return traced(spark, d).select("row_seq", "traj_id", "point_id")


@query
def bearings(spark: SparkSession, d: str) -> DataFrame:
    return traced(spark, d).select("row_seq", F.round("bearing", 2).alias("bearing"))


@query
def traj_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line of every trajectory, as text of its corners to the decimetre."""
    return pt.trajectory_lines(traced(spark, d)).select("traj_id", "n_points", decimetres("line").alias("line_dm"))


@query
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return pt.carried(points(spark, d)).agg(F.sum("n").alias("n_points"), F.count_distinct("traj_id").alias("n_trajectories"), F.count_distinct("boxId").alias("n_boxes"))


@query
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.trajectory_sessions(sessions.cleaned(table(spark, d, READINGS)))
    return s.select("boxId", us("start"), us("end"), "n_points", "n_nonzero")


@query
def overtake_windows(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.overtake_sessions(sessions.cleaned(table(spark, d, READINGS)))
    return s.select("boxId", us("start"), us("end"), "n_samples", "min_clearance_cm", F.round("mean_clearance_cm", 9).alias("mean_clearance_cm"), "is_close")


# quality


@query
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return ql.longest_runs(journeys(spark, d)).drop("boxId")


@query
def quality_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ql.worst_first(quality(spark, d)), length_km=4, mean_speed_kmh=3, nonzero_share=9, raw_per_km=4)


@query
def quality_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return ql.flag_counts(quality(spark, d))


@query
def nflag_hist(spark: SparkSession, d: str) -> DataFrame:
    return ql.flag_histogram(quality(spark, d))


@query
def keep_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ql.keep_summary(quality(spark, d)), kept_share=9)


@query
def box_keep_rate(spark: SparkSession, d: str) -> DataFrame:
    return ql.box_keep_rates(quality(spark, d))


@query
def box_overview(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ql.box_overview(journeys(spark, d)), nonzero_share=9)


@query
def good_scope_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the trajectories that passed, with their ids."""
    tours = journeys(spark, d)
    good = ql.good_trajectories(ql.quality_table(ql.trajectory_stats(tours)))
    return pt.trace(pt.segment(points(spark, d), among=tours.of(good))).select("row_seq", "traj_id", "point_id")


@query
def plot_one_box(spark: SparkSession, d: str) -> DataFrame:
    """A box's pages: its trajectories, longest first, with the end of their id as label."""
    q = quality(spark, d).select("boxId", "traj_id", F.right("traj_id", F.lit(4)).alias("label"), "n_points", "nonzero_share", "longest_nonzero_run", "value_max")
    rank = F.row_number().over(Window.partitionBy("boxId").orderBy(F.col("n_points").desc(), "traj_id"))
    whole = lambda c: F.coalesce(F.bround(c).cast("long").cast("string"), F.lit("nan"))
    title = F.concat("label", F.lit(" | "), F.col("n_points").cast("string"), F.lit(" pts | nz "), whole(F.round("nonzero_share", 9) * 100), F.lit("% | run "), F.col("longest_nonzero_run").cast("string"), F.lit(" | max "), whole(F.col("value_max")))
    return rounded(q.withColumns({"page_rank": rank, "title": title}), nonzero_share=9)


@query
def plot_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Lines per box for the legend: the fifteen largest by name, how many more there are."""
    n = pt.carried(points(spark, d)).groupBy("boxId", "traj_id").agg(F.sum("n").alias("n"))
    lines = n.where("n >= 2").groupBy("boxId").agg(F.count(F.lit(1)).alias("n_lines"))
    top = lines.orderBy(F.col("n_lines").desc(), "boxId").limit(15)
    return top.join(F.broadcast(lines.agg(F.count(F.lit(1)).alias("n_boxes"))), F.lit(True)).select(F.left("boxId", F.lit(12)).alias("label"), "boxId", "n_lines", (F.greatest(F.col("n_boxes") - 15, F.lit(0))).cast("long").alias("n_more"))


# overtakes


@query
def overtake_events(spark: SparkSession, d: str) -> DataFrame:
    e = ev.overtake_events(journeys(spark, d))
    return rounded(
        e.select(
            "event_uid", "traj_id", "event_id", "boxId", us("start"), us("end"), "duration_s", "n_samples", "min_clearance_cm", "mean_clearance_cm", "is_close", "first_point_id", "last_point_id", "closest_point_id", "x", "y"
        ),
        duration_s=6, mean_clearance_cm=9, x=2, y=2,
    )


@query
def traj_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(journeys(spark, d))


def summary(tours: pt.Journeys) -> DataFrame:
    s = ev.summarise(tours, ev.overtake_events(tours))
    s = s.select("traj_id", "boxId", "boxName", us("start"), us("end"), "n_points", "length_km", "duration_min", "mean_speed_kmh", "n_overtakes", "n_close_passes", "min_overtake_cm", "mean_overtake_cm", "mean_event_duration_s", "overtake_rate_per_km")
    return rounded(s, length_km=4, duration_min=9, mean_speed_kmh=3, mean_overtake_cm=9, mean_event_duration_s=9, overtake_rate_per_km=4)


@query
def top_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.top_summary(summary(journeys(spark, d)))


@query
def event_totals(spark: SparkSession, d: str) -> DataFrame:
    return ev.event_totals(ev.overtake_events(journeys(spark, d)))


@query
def link_events(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).select("event_uid", "u", "v")


@query
def event_edge_class(spark: SparkSession, d: str) -> DataFrame:
    return ev.join_edge_class(linked(spark, d), table(spark, d, EDGES)).select("event_uid", "u", "v", "edge_class")


@query
def events_per_class(spark: SparkSession, d: str) -> DataFrame:
    return ev.events_per_class(ev.join_edge_class(linked(spark, d), table(spark, d, EDGES)))


@query
def linked_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev.linked_share(linked(spark, d)), linked_share=9)


# network


@query
def edge_classes(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("u", "v", "key", "is_cycling_street", "has_track_tag", "has_lane_tag", "separate_geometry", "edge_class")


@query
def edges_written(spark: SparkSession, d: str) -> DataFrame:
    return nw.written(edges(spark, d).select("u", "v", "key", *[F.col(f"`{c}`") for c in nw.TAGS]))


@query
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    return nw.crosstab_margins(classified(spark, d))


@query
def crosstab_wide(spark: SparkSession, d: str) -> DataFrame:
    return nw.crosstab_wide(classified(spark, d)).withColumnRenamed("All", "all_classes")


@query
def multi_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nw.multi_match(classified(spark, d)), multi_share=9)


@query
def condition_overlap(spark: SparkSession, d: str) -> DataFrame:
    return nw.condition_overlap(classified(spark, d))


@query
def other_top(spark: SparkSession, d: str) -> DataFrame:
    return nw.other_top(classified(spark, d))


@query
def length_share(spark: SparkSession, d: str) -> DataFrame:
    return nw.length_share(classified(spark, d))


@query
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return nw.class_counts(classified(spark, d))


@query
def plot_large_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nw.large_classes(classified(spark, d)), km=3)


@query
def main_bearing(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("geometry is not null").select("u", "v", "key", F.round(nw.main_bearing(F.col("geometry")), 4).alias("bearing"))


@query
def nearest_road(spark: SparkSession, d: str) -> DataFrame:
    r = nw.nearest_roads(edges(spark, d))
    return r.select("u", "v", "key", F.col("road.u").alias("road_u"), F.col("road.v").alias("road_v"), F.col("road.key").alias("road_key"), F.round("dist_to_road", 4).alias("dist_to_road"), F.round("angle", 3).alias("angle"))


@query
def sidepath_flags(spark: SparkSession, d: str) -> DataFrame:
    return nw.flag_sidepaths(table(spark, d, EDGES)).select("u", "v", "key", "is_sidepath")


@query
def sidepath_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nw.sidepath_share(nw.flag_sidepaths(table(spark, d, EDGES))), share=9)


@query
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    """The network stage from tags and geometry alone: sidepaths by place, then regimes."""
    return nw.class_counts(nw.classify_edges(nw.flag_sidepaths(table(spark, d, EDGES))))


# matching


@query
def straight_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chords(spark, d), x0=3, y0=3, x1=3, y1=3)


@query
def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = mm.candidates(traced(spark, d).select("point_id", "x", "y"), chords(spark, d))
    return c.select("point_id", "u", "v", F.round("distance_m", 3).alias("distance_m"))


@query
def nearest_edge_match(spark: SparkSession, d: str) -> DataFrame:
    n = mm.nearest_edge(traced(spark, d).select("point_id", "x", "y"), chords(spark, d))
    return n.select("point_id", "u", "v", F.round("distance_m", 3).alias("distance_m"))


@query
def viterbi_match(spark: SparkSession, d: str) -> DataFrame:
    return mm.match_paths(traced(spark, d), chords(spark, d))


@query
def viterbi_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per trajectory what holds for every match: points, whether any is placed, points placed after one that isn't, and placed on an edge that isn't near."""
    t, c = traced(spark, d), chords(spark, d)
    m = mm.match_paths(t, c)
    at = t.select("traj_id", "point_id", "ordinal", "x", "y").join(m.drop("traj_id"), "point_id").join(c, ["u", "v"], "left")
    far = point_segment_distance(F.col("x"), F.col("y"), *[F.col(k) for k in ("x0", "y0", "x1", "y1")]) > F.when(F.col("ordinal") == 0, F.lit(mm.Matching.max_dist_init)).otherwise(F.lit(mm.Matching.max_dist)) + 1e-6
    on = F.col("u").isNotNull()
    return at.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.bool_or(on).alias("any_placed"), (F.count_if(on) - F.coalesce(F.max(F.when(on, F.col("ordinal"))) + 1, F.lit(0))).alias("n_after_null"), F.count_if(F.coalesce(far, on)).alias("n_far"),
    )


@query
def placed_share(spark: SparkSession, d: str) -> DataFrame:
    """Per trajectory how much of it is placed, with the title of its picture."""
    p = rounded(mm.placed_share(table(spark, d, "matched_points")), placed_share=9)
    percent = F.bround(F.col("placed_share") * 100).cast("long").cast("string")
    return p.withColumn("title", F.concat(F.right("traj_id", F.lit(4)), F.lit(" | "), F.col("n_points").cast("string"), F.lit(" pts | "), percent, F.lit("% placed")))


@query
def placed_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mm.placed_overall(mm.placed_share(table(spark, d, "matched_points"))), placed_share=9)


@query
def visited_edges(spark: SparkSession, d: str) -> DataFrame:
    return mm.visited_edges(table(spark, d, "matched_points")).select("traj_id", "u", "v", us("first_at"))


@query
def plot_match(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the edges that a trajectory was placed on, in the order of their first visit."""
    g = mm.visited_geometries(table(spark, d, "matched_points"), table(spark, d, EDGES))
    rank = F.row_number().over(Window.partitionBy("traj_id").orderBy("first_at", "u", "v"))
    return g.select("traj_id", "u", "v", rank.alias("visit"), decimetres("geometry").alias("line_dm"))


# maps


@query
def plot_network(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the network map: every edge with a geometry, its regime, how many edges the regime has, and its place among the regimes."""
    c = classified(spark, d)
    n = nw.class_counts(c).withColumn("legend", F.row_number().over(Window.partitionBy().orderBy(F.col("n").desc(), "edge_class")))  # 13 regimes at most
    return c.where("geometry is not null").join(F.broadcast(n), "edge_class").select("u", "v", "key", "edge_class", "n", "legend", decimetres("geometry").alias("line_dm"))


@query
def plot_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the trajectory map in pieces, a piece per stretch of ten minutes, which begins where the one before ended."""
    return pt.line_pieces(traced(spark, d)).select("boxId", "traj_id", "first", "n_points", decimetres("line").alias("line_dm"))


# stages


def staged(spark: SparkSession, d: str) -> stages.Trajectories:
    raw, nodes = table(spark, d, READINGS), table(spark, d, "network_nodes")
    return stages.trajectories(raw, nodes, stages.diagnostics(raw, nodes))


@query
def stage_network(spark: SparkSession, d: str) -> DataFrame:
    """The network stage: regimes from tags and geometry."""
    return stages.network(table(spark, d, EDGES)).edges.select("u", "v", "key", "is_sidepath", "is_cycling_street", "has_track_tag", "has_lane_tag", "separate_geometry", "edge_class")


@query
def stage_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The diagnostics stage over readings within the network's extent."""
    q = stages.diagnostics(table(spark, d, READINGS), table(spark, d, "network_nodes"))
    return q.select("traj_id", "keep", "n_flags", "flag_reasons", "n_points", F.round("length_km", 4).alias("length_km"), "longest_nonzero_run")


@query
def stage_points(spark: SparkSession, d: str) -> DataFrame:
    """The trajectory stage: points of the trajectories that diagnostics keeps."""
    return staged(spark, d).points.select("row_seq", "point_id", F.round("bearing", 2).alias("bearing"))


@query
def stage_events(spark: SparkSession, d: str) -> DataFrame:
    """The trajectory stage: overtakes of the trajectories that diagnostics keeps."""
    return staged(spark, d).events.select("event_uid", "n_samples", "min_clearance_cm", "is_close", "closest_point_id")


@query
def stage_matched_events(spark: SparkSession, d: str) -> DataFrame:
    """All stages, from readings to overtakes with the edge of their own match and its regime."""
    t = staged(spark, d)
    m = stages.matching(t.points, t.events, chords(spark, d), table(spark, d, EDGES))
    return m.events.select("event_uid", "u", "v", "edge_class")


def queries() -> dict[str, Query]:
    return dict(REGISTERED)
