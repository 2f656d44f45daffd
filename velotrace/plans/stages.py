"""The stages from raw readings and a street network to overtakes per riding regime, each with its tables and reports.

A stage takes and gives DataFrames; run_...() reads its inputs from files, writes its outputs and gives them back as read
from there. Order: network and diagnostics, then trajectories, then matching.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotrace.operators import events as ev
from velotrace.operators import matching as mm
from velotrace.operators import network as nw
from velotrace.operators import points as pt
from velotrace.operators import quality as ql
from velotrace.sources import files
from velotrace.sources.geopackage import read_gpkg, write_gpkg

POINTS = "createdAt timestamp, value double, lat double, lon double, boxId string, boxName string, traj_id string, bearing double, point_id string"
EVENTS = (
    "event_uid string, traj_id string, event_id bigint, boxId string, start timestamp, end timestamp, duration_s double, n_samples bigint, min_clearance_cm double, mean_clearance_cm double, "
    "is_close boolean, first_point_id string, last_point_id string, closest_point_id string"
)
EDGES = "u bigint, v bigint, key int, length double, " + ", ".join(f"`{t}` array<string>" for t in files.EDGE_TAGS if t != "is_sidepath") + ", is_sidepath boolean, is_cycling_street boolean, has_track_tag boolean, has_lane_tag boolean, separate_geometry boolean, edge_class string"


@dataclass(frozen=True)
class Network:
    edges: DataFrame
    highway_vs_label: DataFrame
    condition_overlap: DataFrame
    length_by_label: DataFrame


def network(edges: DataFrame) -> Network:
    """Sidepaths and regimes from tags and geometry, and how tags became regimes."""
    e = nw.classify_edges(nw.flag_sidepaths(edges))
    return Network(e, nw.crosstab_wide(e), nw.condition_overlap(e), nw.length_share(e))


def tours_within(raw: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, pt.Journeys]:
    """Points of raw readings inside the extent of the nodes, and their trajectories."""
    points = pt.load_points(raw, None if nodes is None else pt.node_extent(nodes))
    return points, pt.journeys(points)


def diagnostics(raw: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The quality table, worst trajectories first."""
    return ql.worst_first(ql.quality_table(ql.trajectory_stats(tours_within(raw, nodes)[1])))


@dataclass(frozen=True)
class Trajectories:
    points: DataFrame
    events: DataFrame
    summary: DataFrame


def trajectories(raw: DataFrame, nodes: DataFrame | None = None, quality: DataFrame | None = None) -> Trajectories:
    """Points, overtakes and summary of the trajectories that the quality table keeps; of all without one."""
    points, tours = tours_within(raw, nodes)
    if quality is not None:
        tours = tours.of(ql.good_trajectories(quality))
    events = ev.overtake_events(tours)
    return Trajectories(pt.trace(pt.segment(points, among=tours)), events, ev.summarise(tours, events))


@dataclass(frozen=True)
class Matched:
    points: DataFrame
    events: DataFrame


def matching(points: DataFrame, events: DataFrame, chords: DataFrame, edges: DataFrame | None) -> Matched:
    """Points with the edge they were ridden on, and overtakes with edge and regime.

    points: as trace() gives them, or read from a file, where the ordinal is the end of the point_id.
    """
    p = points if "ordinal" in points.columns else points.withColumn("ordinal", F.regexp_extract("point_id", r"_p(\d+)$", 1).try_cast("long"))
    edge_of = mm.match_paths(p, chords).select("point_id", "u", "v")
    matched = points.drop("u", "v").join(edge_of, "point_id", "left")
    return Matched(matched, ev.join_edge_class(ev.link_events(events, matched), edges))


# with files


def run_network(spark: SparkSession, graph: str, out: str, metric: bool = True) -> DataFrame:
    """Reads a GraphML network; writes muenster_edges_classified (GeoPackage) and the reports (CSV) under out."""
    n = network(files.read_network(spark, graph, metric)[1])
    write_gpkg(n.edges.drop("dist_to_road", "matched_rules"), f"{out}/muenster_edges_classified", "edges")
    for name in ("highway_vs_label", "condition_overlap", "length_by_label"):
        files.write_csv(getattr(n, name), f"{out}/inspection/{name}")
    return read_edges(spark, out)


def read_edges(spark: SparkSession, out: str) -> DataFrame:
    return read_gpkg(spark, f"{out}/muenster_edges_classified", EDGES)


def run_diagnostics(spark: SparkSession, csv: str | list[str], graph: str | None, out: str, metric: bool = True) -> DataFrame:
    """Reads raw readings; writes diagnostics/trajectory_quality (CSV) under out."""
    nodes = None if graph is None else files.read_network(spark, graph, metric)[0]
    files.write_csv(diagnostics(files.read_raw_csv(spark, csv), nodes), f"{out}/diagnostics/trajectory_quality")
    return files.read_quality_csv(spark, f"{out}/diagnostics/trajectory_quality")


def located(df: DataFrame) -> DataFrame:
    """x, y as a geometry of one place; null if either is null or NaN."""
    ok = F.coalesce(~F.isnan("x") & ~F.isnan("y"), F.lit(False))
    return df.withColumn("geometry", F.when(ok, F.array(F.struct("x", "y")))).drop("x", "y")


def placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("geometry")[0]["x"], "y": F.col("geometry")[0]["y"]}).drop("geometry")


def run_trajectories(spark: SparkSession, csv: str | list[str], graph: str | None, out: str, metric: bool = True) -> Trajectories:
    """Reads raw readings and, if it is there, the quality table; writes trajectory_points and overtake_events (GeoPackage) and trajectory_summary (CSV)."""
    nodes = None if graph is None else files.read_network(spark, graph, metric)[0]
    table = f"{out}/diagnostics/trajectory_quality"
    t = trajectories(files.read_raw_csv(spark, csv), nodes, files.read_quality_csv(spark, table) if Path(table).exists() else None)
    write_gpkg(located(t.points).select(*names(POINTS), "geometry"), f"{out}/trajectory_points", "points", point=True)
    write_gpkg(located(t.events), f"{out}/overtake_events", "events", point=True)
    files.write_csv(t.summary, f"{out}/trajectory_summary")
    return Trajectories(placed(read_gpkg(spark, f"{out}/trajectory_points", POINTS)), placed(read_gpkg(spark, f"{out}/overtake_events", EVENTS)), t.summary)


def names(ddl: str) -> list[str]:
    return [f.strip().split()[0] for f in ddl.split(",")]


def run_matching(spark: SparkSession, graph: str, out: str, metric: bool = True) -> Matched:
    """Reads points and overtakes of run_trajectories() and edges of run_network(); writes matched_points and matched_events (GeoPackage).

    If both are there already, nothing is matched anew.
    """
    paths = [f"{out}/matched_points", f"{out}/matched_events"]
    if not all(Path(p).exists() for p in paths):
        nodes, ways = files.read_network(spark, graph, metric)
        edges = read_edges(spark, out) if Path(f"{out}/muenster_edges_classified").exists() else None
        points, events = (placed(read_gpkg(spark, f"{out}/{name}", kind)) for name, kind in (("trajectory_points", POINTS), ("overtake_events", EVENTS)))
        m = matching(points, events, mm.straight_map(ways, nodes), edges)
        write_gpkg(located(m.points), paths[0], "points", point=True)
        write_gpkg(located(m.events), paths[1], "events", point=True)
    return Matched(*(placed(read_gpkg(spark, p, f"{kind}, u bigint, v bigint{more}")) for p, kind, more in zip(paths, (POINTS, EVENTS), ("", ", edge_class string"), strict=True)))
