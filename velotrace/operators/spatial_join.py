"""Joins by distance: a grid turns them into equi-joins, hot cells are split, exact distances decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotrace.functions.geo import point_segment_distance
from velotrace.operators.regions import by_number, cell_key, cut_long, real
from velotrace.operators.skew import joined_by


def in_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell_m: float, pad_m: float) -> DataFrame:
    """A row per grid cell that the box of (x0, y0)-(x1, y1), widened by pad_m, meets."""
    to = lambda c: F.floor(c / cell_m)
    low = lambda a, b: to(F.least(a, b) - pad_m)
    high = lambda a, b: to(F.greatest(a, b) + pad_m)
    return (
        df.withColumn("_col", F.explode(F.sequence(low(x0, x1), high(x0, x1))))
        .withColumn("_row", F.explode(F.sequence(low(y0, y1), high(y0, y1))))
        .withColumn("cell", cell_key(F.col("_col"), F.col("_row")))
        .drop("_col", "_row")
    )


def segments_near_points(points: DataFrame, segments: DataFrame, reach_m: float, rows_per_split: int = 200_000) -> DataFrame:
    """Columns of points (point, x, y, ...) and segments (segment, x0, y0, x1, y1) with distance_m <= reach_m.

    Rows with null, NaN or endless coordinates have no neighbours. The grid is as wide as the reach, and a segment
    lies in all cells that its widened box meets, so that a point looks into its own cell only.
    """
    to = lambda c: F.floor(F.col(c) / reach_m)
    # points without a place need no filter: no distance to them is within reach
    p = points.withColumn("cell", cell_key(to("x"), to("y")))
    s = in_cells(segments.where(real("x0", "y0", "x1", "y1")), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), reach_m, reach_m)
    d = point_segment_distance(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return joined_by(p, s, ["cell"], "cell", F.col("point"), rows_per_split).withColumn("distance_m", d).where(F.col("distance_m") <= reach_m).drop("cell")


def segment_distance(a: str, b: str) -> Column:
    """Distance of two segments in columns a.x0.. and b.x0..: 0 if they cross, else the least of the four ends'."""
    ax0, ay0, ax1, ay1 = (F.col(f"{a}.{c}") for c in ("x0", "y0", "x1", "y1"))
    bx0, by0, bx1, by1 = (F.col(f"{b}.{c}") for c in ("x0", "y0", "x1", "y1"))
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    apart = lambda u, v: ((u > 0) & (v < 0)) | ((u < 0) & (v > 0))
    crossing = apart(side(ax0, ay0, ax1, ay1, bx0, by0), side(ax0, ay0, ax1, ay1, bx1, by1)) & apart(side(bx0, by0, bx1, by1, ax0, ay0), side(bx0, by0, bx1, by1, ax1, ay1))
    ends = F.least(
        point_segment_distance(ax0, ay0, bx0, by0, bx1, by1), point_segment_distance(ax1, ay1, bx0, by0, bx1, by1),
        point_segment_distance(bx0, by0, ax0, ay0, ax1, ay1), point_segment_distance(bx1, by1, ax0, ay0, ax1, ay1),
    )
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def nearest_line(left: DataFrame, right: DataFrame, reach_m: float) -> DataFrame:
    """line, near, distance_m: for each line of left the nearest of right within reach_m (ties: the lowest); none, no row.

    left: segments (line, x0, y0, x1, y1); right: segments (near, x0, y0, x1, y1). Segments of left lie in the cells their box
    meets, those of right in the cells their widened box meets, so neighbours share one.
    """
    ends = ("x0", "y0", "x1", "y1")
    cols = [F.col(c) for c in ends]
    # a few segments make many pairs, so they are dealt out by number, not by size
    dealt = left.where(real(*ends)).repartition(by_number(left.sparkSession), "line")
    a = in_cells(cut_long(dealt), *cols, reach_m, 0.0)
    b = in_cells(cut_long(right.where(real(*ends))), *cols, reach_m, reach_m)
    pack = lambda df, key, name: df.select("cell", key, F.struct(*ends).alias(name))
    pairs = joined_by(pack(a, "line", "a"), pack(b, "near", "b"), ["cell"], "cell", F.xxhash64("line", "a"))
    near = pairs.select("line", "near", segment_distance("a", "b").alias("distance_m")).where(F.col("distance_m") <= reach_m)
    best = near.groupBy("line").agg(F.min(F.struct("distance_m", "near")).alias("best"))
    return best.select("line", F.col("best.near").alias("near"), F.col("best.distance_m").alias("distance_m"))
