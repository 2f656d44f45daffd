"""Points in regions by crossing parity, and points near polylines (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotrace.functions.geo import distance, point_segment_distance, with_utm32
from velotrace.operators.shards import SECOND, dedup, sharded, usable
from velotrace.operators.skew import is_small, joined_by
from velotrace.session import cut


#: Cell of places that are not known.
NOWHERE = -(1 << 63)


def cell_key(col: Column, strip: Column) -> Column:
    """One long of a column and a strip (a strip of latitude, and a stretch of it); never null.

    A null key would be filtered before a join, and the filter would repeat the whole computation of the place.
    """
    return F.coalesce(F.shiftleft(strip, 32).bitwiseOR(col.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(NOWHERE))


def by_number(spark: SparkSession) -> int:
    """Partitions for a fixed side whose rows make many more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def binned_edges(regions: DataFrame, cell_m: float) -> DataFrame:
    """Ring edges of regions (region, ring array<struct<x,y>>) in latitude strips.

    A row per edge, strip that the edge's y-range meets, and stretch of the strip from the region's
    lowest x to the edge's highest: a point needs only the edges of its own strip that do not end
    before its stretch, of regions that begin by then. Rings are closed if they aren't; horizontal edges cross no ray and are left out.
    """
    # a few regions make many rows, so they are dealt out by number, not by size
    rings = regions.repartition(by_number(regions.sparkSession), "region").select(
        "region", "ring", F.array_min(F.transform("ring", lambda p: p["x"])).alias("x_min")
    )
    places = F.forall("ring", lambda p: F.coalesce((F.abs(p["x"]) < FARTHEST) & (F.abs(p["y"]) < FARTHEST), F.lit(False)))
    # outer, with the empty ones dropped after: a filter on rings would be pushed below what makes them, and repeat it
    sides = F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, F.greatest(F.size("ring"), F.lit(0))), F.slice("ring", 1, 1)).alias("b"))
    edges = rings.select("region", "x_min", F.explode_outer(F.when((F.size("ring") >= 3) & places, sides)).alias("e")).select("region", "x_min", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    to = lambda c: F.floor(c / cell_m)
    strips = edges.where(F.col("ay") != F.col("by")).withColumn("strip", F.explode(F.sequence(to(F.least("ay", "by")), to(F.greatest("ay", "by")))))
    cells = strips.withColumn("stretch", F.explode(F.sequence(to(F.col("x_min")), to(F.greatest("ax", "bx")))))
    return cells.select(cell_key(F.col("stretch"), F.col("strip")).alias("cell"), "region", "ax", "ay", "bx", "by")


def points_in_regions(points: DataFrame, regions: DataFrame, cell_m: float = 40.0, rows_per_split: int = 200_000) -> DataFrame:
    """(point, x, y, region) for each point inside a region or on its boundary.

    points: (point, x, y), point unique; regions: (region, ring). The ray from a point runs to growing x. An edge
    is crossed if one end is at or below the point and the other above it, so a ray through a
    corner counts once; a point is inside if it has an odd number of crossings. A point on a
    slanting edge itself counts as inside; points on horizontal edges are in by the half-open rule at
    a lower edge and out at an upper one, so callers who need both grow the ring a little.

    Null or NaN coordinates, rings under 3 corners, null or with such corners: no rows. Edges are broadcast if they are few enough, so that
    points stay where they are until their crossings are summed; else both sides are shuffled by cell, hot cells split.
    """
    to = lambda c: F.floor(F.col(c) / cell_m)
    # null and NaN places need no filter: they straddle no edge
    placed = points.select("point", "x", "y", cell_key(to("x"), to("y")).alias("cell"))
    straddles = (F.least("ay", "by") <= F.col("y")) & (F.col("y") < F.greatest("ay", "by"))
    at = F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    pairs = joined_by(placed, binned_edges(regions, cell_m), ["cell"], "cell", F.col("point"), rows_per_split)
    crossed = pairs.where(straddles & (at >= F.col("x")))
    parity = crossed.groupBy("point", "region").agg(F.count(F.lit(1)).alias("crossings"), F.max((at == F.col("x")).cast("int")).alias("touching"), F.first("x").alias("x"), F.first("y").alias("y"))
    return parity.where((F.col("crossings") % 2 == 1) | (F.col("touching") == 1)).select("point", "x", "y", "region")


def around(x0: Column, y0: Column, x1: Column, y1: Column, reach: float) -> Column:
    """Ring of four corners that holds every place within reach of a segment."""
    r = F.lit(reach * 1.000001)
    length = distance(x0, y0, x1, y1)
    ex = F.coalesce(F.try_divide(x1 - x0, length), F.lit(1.0))
    ey = F.coalesce(F.try_divide(y1 - y0, length), F.lit(0.0))
    corner = lambda along, off: F.struct((x0 + ex * along - ey * off).alias("x"), (y0 + ey * along + ex * off).alias("y"))
    return F.array(corner(-r, -r), corner(length + r, -r), corner(length + r, r), corner(-r, r))


def segments(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A row per segment of lines (keys..., geometry): keys..., x0, y0, x1, y1. A line of one point gives a segment of no length; null geometry none."""
    g = F.col("geometry")
    ends = F.when(F.size(g) == 1, F.array(F.struct(g[0].alias("a"), g[0].alias("b")))).otherwise(
        F.zip_with(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )
    s = lines.where(g.isNotNull() & (F.size(g) >= 1)).select(*keys, F.explode(ends).alias("s"))
    return s.select(*keys, F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


#: Coordinates beyond this are no places.
FARTHEST = 1e9


def real(*cols: str) -> Column:
    """All of the columns are coordinates: not null, NaN or beyond FARTHEST."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.abs(F.col(c)) < FARTHEST, F.lit(False))
    return ok


def cut_long(parts: DataFrame, most_m: float = 250.0) -> DataFrame:
    """Segments (x0, y0, x1, y1 and others) of more than most_m in equal shorter ones, so that the cells of their boxes grow with their length only."""
    n = F.greatest(F.ceil(distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) / most_m), F.lit(1))
    many = parts.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    on = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")
    i, last = F.col("_i"), F.col("_i") + 1 == F.col("_n")
    new = {f"_{c}0": F.when(i == 0, F.col(f"{c}0")).otherwise(on(f"{c}0", f"{c}1", i)) for c in "xy"} | {f"_{c}1": F.when(last, F.col(f"{c}1")).otherwise(on(f"{c}0", f"{c}1", i + 1)) for c in "xy"}
    ends = ("x0", "y0", "x1", "y1")
    return many.withColumns(new).drop("_n", "_i", *ends).withColumnsRenamed({f"_{c}": c for c in ends})


def lines_near_points(points: DataFrame, lines: DataFrame, keys: list[str], reach_m: float, cell_m: float = 40.0) -> DataFrame:
    """(point, keys...) for each point and line at most reach_m apart, each pair once.

    Every segment becomes a region, the rectangle that holds its surroundings; points in these regions are
    found by crossing parity, and the exact distance then decides. A segment that several lines share, in either
    direction, is one region. lines: (keys..., geometry array<struct<x,y>>); equal rows of lines give one pair.
    """
    ends = ["x0", "y0", "x1", "y1"]
    parts = cut_long(segments(lines, keys).where(real(*ends)))
    turned = F.struct("x1", "y1") < F.struct("x0", "y0")
    parts = parts.select(*keys, *[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ends, ["x1", "y1", "x0", "y0"], strict=True)]).distinct()
    # regions are told by a number, which is short where it is shuffled and broadcast; written, it stays the same
    numbered = cut(parts.select(*ends).distinct().withColumn("region", F.monotonically_increasing_id()))
    regions = numbered.select("region", around(*[F.col(c) for c in ends], reach_m).alias("ring"))
    inside = points_in_regions(points, regions, cell_m)
    owners = parts.join(numbered, ends).select("region", *keys, F.struct(*ends).alias("s"))
    s = [F.col("s")[c] for c in ends]
    near = inside.join(F.broadcast(owners) if is_small(owners) else owners, "region").where(point_segment_distance(F.col("x"), F.col("y"), *s) <= reach_m)
    return near.select("point", *keys).distinct()


def detections(readings: DataFrame) -> DataFrame:
    """(point = row_seq, x, y) of the readings that count whose number is above 0."""
    rows = dedup(sharded(usable(readings, F.col("lat"), F.col("lon")), 600 * SECOND), ("num", "lat", "lon"))
    return with_utm32(rows.where((F.col("num") > 0) & F.col("row_seq").isNotNull())).select(F.col("row_seq").alias("point"), "x", "y")


def edges_near_detections(readings: DataFrame, edges: DataFrame, reach_m: float = 15.0) -> DataFrame:
    """row_seq, u, v, edge_key: street edges within reach_m of each detection.

    Readings without position, time or box don't count, those without row_seq can't be named; edges without geometry or with a null in
    (u, v, key) are left out; repeated edges count once. Empty tables give no rows.
    """
    ways = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("key").isNotNull()).select("u", "v", F.col("key").alias("edge_key"), "geometry")
    return lines_near_points(detections(readings), ways, ["u", "v", "edge_key"], reach_m).withColumnRenamed("point", "row_seq")
