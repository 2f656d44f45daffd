"""From raw readings to trajectories with ids, bearings and steps.

Order within a box is (createdAt, row_seq). A trajectory can be as long as its box reports, so nothing here
orders a whole trajectory by rows: rows are ordered per cell (box and stretch of time as wide as the gap that
ends a trajectory, so a cell is of one trajectory), and one summary row per cell carries ordinals, the last
point and counts over to the next cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from velotrace.functions.clean import floor_div, number
from velotrace.functions.geo import compass_bearing, distance, with_utm32
from velotrace.operators.shards import SECOND, rides
from velotrace.session import cut

GAP_MINUTES = 10
MIN_POINTS = 5
PAD_M = 2000.0

Box = tuple[float, float, float, float]


def node_extent(nodes: DataFrame, pad_m: float = PAD_M) -> DataFrame:
    """One row: extent of the nodes, widened by pad_m. Nulls of an empty table."""
    pad = F.lit(pad_m)
    return nodes.agg(
        (F.min("x") - pad).alias("x_min"), (F.min("y") - pad).alias("y_min"), (F.max("x") + pad).alias("x_max"), (F.max("y") + pad).alias("y_max")
    )


def load_points(raw: DataFrame, extent: DataFrame | None = None, observe: Observation | None = None) -> DataFrame:
    """Cleaned, projected and, if an extent (one row) is given, clipped points.

    Rows without lat, lon, createdAt or boxId are dropped; a value that is no number is null and the row
    kept. The clip is closed and comes before anything that looks at neighbours. observe counts rows that come in and are in.
    """
    rows = raw.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("createdAt").isNotNull() & F.col("boxId").isNotNull())
    points = with_utm32(rows.select("row_seq", "createdAt", number(F.col("value")).alias("value"), "lat", "lon", "boxId", "boxName"))
    if extent is None:
        return points
    both = points.join(F.broadcast(extent), F.lit(True))  # one row
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    if observe is not None:
        both = both.observe(observe, F.count(F.lit(1)).alias("rows"), F.count_if(inside).alias("kept"))
    return both.where(inside).drop("x_min", "y_min", "x_max", "y_max")


@dataclass(frozen=True)
class Journeys:
    """Trajectories as summaries of their cells.

    cells: boxId, cell, traj_id, and of the cell: n, t0, t1 (microseconds), zeros and n_hits (points without and with detection), n_known (with a
    value), value_max, path_m (with the step from the cell before), longest, head and tail (detections in a row: most, first, last), name and known_name
    (of its first point, and its first one that has a name). Carried over from the cells of the trajectory before: c_rows, c_zeros, c_last (place of the last
    point), c_hit (its last detection), c_run (detections in a row up to there), c_events (events begun); c_next is the place of the first point after. hits: boxId, cell, hits (array of
    the cell's detections: i, t, row_seq, value, x, y).
    """

    cells: DataFrame
    hits: DataFrame

    def of(self, good: DataFrame) -> Journeys:
        """Those of the trajectories in good (traj_id)."""
        return Journeys(self.cells.join(good.select("traj_id").distinct(), "traj_id", "left_semi"), self.hits)


def journeys(points: DataFrame, gap_minutes: float = GAP_MINUTES, min_points: int = MIN_POINTS, threshold: float = 0.0, merge_gap_s: float = 3.0) -> Journeys:
    """Trajectories (see segment()) summed up: points are read and shuffled once, by cell, and one row per cell is written.

    All measures of trajectories and all overtakes come from these rows, as what goes over a cell's border is carried by a
    scan of slim rows. merge_gap_s: detections farther apart begin a new event.
    """
    gap, apart = int(gap_minutes * 60 * SECOND), int(merge_gap_s * SECOND)
    t = F.unix_micros("createdAt")
    rows = points.select("boxId", floor_div(t, gap).alias("cell"), t.alias("t"), "row_seq", "value", "boxName", "x", "y")
    here = Window.partitionBy("boxId", "cell").orderBy("t", "row_seq")
    before, hit = here.rowsBetween(Window.unboundedPreceding, -1), F.coalesce(F.col("value") > threshold, F.lit(False))
    i = F.row_number().over(here) - 1
    seen = rows.withColumns({
        "i": i, "hit": hit, "step": F.coalesce(distance(F.lag("x").over(here), F.lag("y").over(here), F.col("x"), F.col("y")), F.lit(0.0)),
        "last_hit": F.last(F.when(hit, F.col("t")), ignorenulls=True).over(before), "last_zero": F.last(F.when(~hit, i), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)),
    })
    run = F.when(F.col("hit"), F.col("i") - F.coalesce("last_zero", F.lit(-1)))
    place = F.struct("x", "y")
    summed = seen.withColumn("run", run).groupBy("boxId", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count_if(~F.col("hit")).alias("zeros"), F.count_if("hit").alias("n_hits"), F.count("value").alias("n_known"), F.max("value").alias("value_max"),
        F.sum("step").alias("path_m"), F.coalesce(F.max("run"), F.lit(0)).alias("longest"), F.coalesce(F.max(F.when(F.col("last_zero").isNull(), F.col("run"))), F.lit(0)).alias("head"),
        F.coalesce(F.max_by(F.coalesce("run", F.lit(0)), "i"), F.lit(0)).alias("tail"), F.min_by(F.struct("boxName"), "i").alias("name"), F.min_by("boxName", F.when(F.col("boxName").isNotNull(), F.col("i"))).alias("known_name"),
        F.min_by(place, "i").alias("first"), F.max_by(place, "i").alias("last"), F.min(F.when(F.col("hit"), F.col("t"))).alias("hit0"), F.max(F.when(F.col("hit"), F.col("t"))).alias("hit1"),
        F.count_if(F.col("hit") & (F.col("t") - F.col("last_hit") > apart)).alias("begun"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("i", "t", "row_seq", "value", "x", "y")))).alias("hits"),
    )
    cells = cut(summed)
    whole = rides(cells.drop("hits"), gap, min_points, by="boxId")
    order = Window.partitionBy("boxId", "ride").orderBy("cell")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    joint = whole.withColumns({
        "traj_id": F.concat_ws("_", "boxId", F.col("ride").cast("string")), "c_rows": sofar("n"), "c_zeros": sofar("zeros"), "c_hit": F.last("hit1", ignorenulls=True).over(upto),
        "c_last": F.lag("last").over(order), "c_next": F.lead("first").over(order),
    })
    # detections in a row up to the end of a cell: those since the last point without one, which the number of such points tells
    row = Window.partitionBy("boxId", "ride", F.col("c_zeros") + F.col("zeros")).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    joint = joint.withColumn("run_out", F.sum("tail").over(row)).withColumn("c_run", F.coalesce(F.lag("run_out").over(order), F.lit(0))).drop("run_out")
    first_new = F.when(F.col("hit0").isNotNull(), F.coalesce((F.col("hit0") - F.col("c_hit") > apart).cast("long"), F.lit(1))).otherwise(0)
    step_in = F.when(F.col("c_last").isNotNull(), distance(F.col("c_last")["x"], F.col("c_last")["y"], F.col("first")["x"], F.col("first")["y"])).otherwise(0.0)
    done = joint.withColumns({"begun": F.col("begun") + first_new, "path_m": F.col("path_m") + step_in}).withColumn("c_events", sofar("begun"))
    return Journeys(done.drop("ride", "ride_t0", "ride_t1", "ride_n", "hit0", "hit1"), cells.select("boxId", "cell", "hits").where(F.size("hits") > 0))


def segment(points: DataFrame, gap_minutes: float = GAP_MINUTES, min_points: int = MIN_POINTS, among: Journeys | None = None) -> DataFrame:
    """Points with traj_id (boxId, `_` and the number of the stretch in its box from 1), and what their cell carries.

    A gap strictly above gap_minutes begins a new trajectory; those under min_points are dropped after
    numbering. Carried: cell, c_rows (points of the trajectory before the cell), c_last and c_next (last point before, first point
    after the cell). No rows give none. among: journeys() of the same points and gap, whose trajectories alone come out.
    """
    celled = points.withColumn("cell", floor_div(F.unix_micros("createdAt"), int(gap_minutes * 60 * SECOND)))
    if among is not None:
        return celled.join(among.cells.select("boxId", "cell", "traj_id", "c_rows", "c_last", "c_next"), ["boxId", "cell"])
    return celled.join(carried(points, gap_minutes, min_points).drop("n", "t0", "t1"), ["boxId", "cell"])


def carried(points: DataFrame, gap_minutes: float = GAP_MINUTES, min_points: int = MIN_POINTS) -> DataFrame:
    """A row per cell of a trajectory, from sums made before the shuffle: boxId, cell, traj_id, n, t0, t1 and what segment() carries."""
    gap = int(gap_minutes * 60 * SECOND)
    t = F.unix_micros("createdAt")
    at, place = F.struct(t.alias("t"), F.col("row_seq")), F.struct("x", "y")
    cells = points.groupBy("boxId", floor_div(t, gap).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1"), F.min_by(place, at).alias("first"), F.max_by(place, at).alias("last"))
    whole = rides(cells, gap, min_points, by="boxId")
    order = Window.partitionBy("boxId", "ride").orderBy("cell")
    return whole.select(
        "boxId", "cell", F.concat_ws("_", "boxId", F.col("ride").cast("string")).alias("traj_id"), "n", "t0", "t1", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c_rows"),
        F.lag("last").over(order).alias("c_last"), F.lead("first").over(order).alias("c_next"),
    )


def in_cell() -> WindowSpec:
    return Window.partitionBy("boxId", "cell").orderBy("createdAt", "row_seq")


def trace(segmented: DataFrame) -> DataFrame:
    """Adds ordinal (from 0), point_id, step_m (from the point before; 0 for the first) and bearing.

    bearing: compass degrees of the step; the first point has that of the second, a lone point 0.
    """
    here = in_cell()
    before = {k: F.lag(k).over(here) for k in ("x", "y")}
    has = F.lag("createdAt").over(here).isNotNull()
    bx, by = (F.when(has, before[k]).otherwise(F.col("c_last")[k]) for k in ("x", "y"))
    after = F.lead("createdAt").over(here).isNotNull()
    nx, ny = (F.when(after, F.lead(k).over(here)).otherwise(F.col("c_next")[k]) for k in ("x", "y"))
    p = segmented.withColumns({"ordinal": F.col("c_rows") + F.row_number().over(here) - 1, "bx": bx, "by": by, "nx": nx, "ny": ny})
    first = F.col("ordinal") == 0
    bearing = F.when(first, F.coalesce(compass_bearing(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")), F.lit(0.0))).otherwise(
        compass_bearing(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    )
    step = F.when(first, F.lit(0.0)).otherwise(distance(F.col("bx"), F.col("by"), F.col("x"), F.col("y")))
    return p.withColumns({"bearing": bearing, "step_m": step, "point_id": F.concat("traj_id", F.lit("_p"), F.col("ordinal").cast("string"))}).drop("bx", "by", "nx", "ny")


def scope_to_good(points: DataFrame, good: DataFrame | None) -> DataFrame:
    """Points of the trajectories in good (traj_id); all of them if good is None, none if it is empty."""
    return points if good is None else points.join(good.select("traj_id").distinct(), "traj_id", "left_semi")


def line_pieces(traced: DataFrame) -> DataFrame:
    """traj_id, boxId, piece (of cells, in order), first (ordinal), n_points, line (array of x, y in order): the line of a trajectory, a piece per cell.

    A piece begins with the last point of the one before, so that pieces can be drawn or measured on their own.
    """
    at = F.struct("ordinal", "x", "y")
    g = traced.groupBy("boxId", "traj_id", "cell").agg(F.array_sort(F.collect_list(at)).alias("p"), F.first("c_last").alias("c_last"))
    own = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    line = F.when(F.col("c_last").isNotNull(), F.concat(F.array("c_last"), own)).otherwise(own)
    return g.select("traj_id", "boxId", F.col("cell").alias("piece"), F.col("p")[0]["ordinal"].alias("first"), F.size("p").cast("long").alias("n_points"), line.alias("line"))


def trajectory_lines(traced: DataFrame) -> DataFrame:
    """traj_id, boxId, n_points, line (array of x, y in order) of trajectories with two points or more, from line_pieces(); a line is one row, as asked for."""
    own = F.when(F.col("first") > 0, F.slice("line", 2, F.greatest(F.size("line") - 1, F.lit(0)))).otherwise(F.col("line"))
    g = line_pieces(traced).groupBy("boxId", "traj_id").agg(F.array_sort(F.collect_list(F.struct("first", own.alias("line")))).alias("l"))
    line = F.flatten(F.transform("l", lambda p: p["line"]))
    return g.select("traj_id", "boxId", F.size(line).cast("long").alias("n_points"), line.alias("line")).where("n_points >= 2")
