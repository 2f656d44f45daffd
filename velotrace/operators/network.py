"""Street edges: tags, sidepaths, riding regimes, and the audit of the regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotrace.functions.geo import axis_angle
from velotrace.operators.regions import segments
from velotrace.operators.spatial_join import nearest_line

# Tag values that the rules read.
CAR_FREE = ["cycleway", "path", "footway", "pedestrian", "track", "bridleway"]
MOTOR = [
    "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "trunk", "trunk_link",
    "unclassified", "residential",
]
MAIN = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "trunk", "trunk_link"]
TRACK_TAGS = ["track", "opposite_track"]
LANE_TAGS = ["lane", "shared_lane", "share_busway", "opposite_lane"]
CYCLEWAY_COLUMNS = ["cycleway", "cycleway:left", "cycleway:right", "cycleway:both"]
# Regimes in the order of the rules; the first rule that holds decides.
REGIMES = [
    "bicycle_street", "roadside_track", "roadside_track", "independent_path", "painted_lane", "pedestrian_zone",
    "residential_street", "service_way", "offroad_track", "bus_lane", "minor_road_shared", "main_road_shared",
]
OTHER = "other"

# Metres and degrees within which a path is beside a road.
NEAR_M, MAX_M, MAX_ANGLE = 12.0, 30.0, 25.0
TAGS = ["highway", *CYCLEWAY_COLUMNS, "cyclestreet", "bicycle_road"]


def tag(df: DataFrame, name: str) -> Column:
    """The value of a tag: '' if missing; of several values the first that says something, 'no' if none does.

    One value, as text or as an array of one, is taken as it is; an empty array is a list without values.
    """
    if name not in df.columns:
        return F.lit("")
    c = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() != "array":
        return F.coalesce(c.cast("string"), F.lit(""))
    telling = F.filter(c, lambda v: v.isNotNull() & ~v.isin("no", "none"))
    many = F.coalesce(F.try_element_at(telling, F.lit(1)), F.lit("no"))
    return F.when(c.isNull(), F.lit("")).when(F.size(c) == 1, F.coalesce(c[0], F.lit(""))).otherwise(many)


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per (u, v, key); of unequal rows the one with a geometry, then the longest."""
    first = F.max_by(F.struct(*[F.col(f"`{c}`") for c in edges.columns]), F.struct(F.col("geometry").isNotNull(), F.col("length")))
    return edges.groupBy("u", "v", "key").agg(first.alias("_e")).select("_e.*")


def main_bearing(geometry: Column) -> Column:
    """Mathematical direction in [0, 180) of the longest segment (the first of equals); null for fewer than two points."""
    n = F.greatest(F.size(geometry) - 1, F.lit(0))
    parts = F.zip_with(
        F.slice(geometry, 1, n), F.slice(geometry, 2, n),
        lambda a, b: F.struct(((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])).alias("ll"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")),
    )
    best = F.aggregate(F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), parts[0], lambda m, p: F.when(p["ll"] > m["ll"], p).otherwise(m))
    angle = F.pmod(F.degrees(F.atan2(best["dy"], best["dx"])), F.lit(180.0))
    return F.when(F.size(geometry) >= 2, angle)


def nearest_roads(edges: DataFrame, max_m: float = MAX_M) -> DataFrame:
    """u, v, key, dist_to_road, angle for each car-free edge with a motor road within max_m: distance to the nearest, angle between the longest segments."""
    e = edges.withColumn("_hw", tag(edges, "highway"))
    ident = F.struct("u", "v", "key")
    paths = segments(e.where(F.col("_hw").isin(CAR_FREE)), ["u", "v", "key"]).withColumn("line", ident)
    roads = segments(e.where(F.col("_hw").isin(MOTOR)), ["u", "v", "key"]).withColumn("near", ident)
    cols = ["x0", "y0", "x1", "y1"]
    near = nearest_line(paths.select("line", *cols), roads.select("near", *cols), max_m)
    turned = e.select(ident.alias("id"), main_bearing(F.col("geometry")).alias("bearing"))
    return (
        near.join(turned.select(F.col("id").alias("line"), F.col("bearing").alias("b0")), "line")
        .join(turned.select(F.col("id").alias("near"), F.col("bearing").alias("b1")), "near")
        .select("line.*", F.col("near").alias("road"), F.col("distance_m").alias("dist_to_road"), axis_angle(F.col("b0"), F.col("b1")).alias("angle"))
    )


def flag_sidepaths(edges: DataFrame, near_m: float = NEAR_M, max_m: float = MAX_M, max_angle: float = MAX_ANGLE, sidepath_tag: str = "is_sidepath") -> DataFrame:
    """Edges (one per u, v, key) with is_sidepath and dist_to_road.

    A car-free edge is a sidepath within near_m of a motor road, or within max_m if it runs at most max_angle off it. The
    tag (column sidepath_tag as text or an array; a Boolean of that name is an earlier result and no tag) saying yes makes any edge one.
    """
    e = unique_edges(edges)
    told = sidepath_tag in e.columns and e.schema[sidepath_tag].dataType.typeName() in ("string", "array")
    e = e.withColumn("_tagged", (tag(e, sidepath_tag) == "yes") if told else F.lit(False))
    roads = nearest_roads(e, max_m)
    by_place = (F.col("_dist") <= near_m) | (F.col("_angle") <= max_angle)
    near = roads.select("u", "v", "key", F.col("dist_to_road").alias("_dist"), F.col("angle").alias("_angle"))
    both = e.drop("is_sidepath", "dist_to_road").join(near, ["u", "v", "key"], "left")
    return both.withColumn("is_sidepath", F.coalesce(by_place, F.lit(False)) | F.col("_tagged")).withColumnRenamed("_dist", "dist_to_road").drop("_angle", "_tagged")


def rules(edges: DataFrame) -> list[Column]:
    """The conditions of REGIMES, in order; edges must have is_sidepath."""
    hw = tag(edges, "highway")
    ways = [tag(edges, c) for c in CYCLEWAY_COLUMNS]
    some = lambda values: ways[0].isin(values) | ways[1].isin(values) | ways[2].isin(values) | ways[3].isin(values)
    side = F.coalesce(F.col("is_sidepath"), F.lit(False))
    own = hw.isin("cycleway", "path", "footway")
    return [
        (tag(edges, "cyclestreet") == "yes") | (tag(edges, "bicycle_road") == "yes"),
        own & side,
        some(TRACK_TAGS),
        own & ~side,
        some(LANE_TAGS),
        hw == "pedestrian",
        hw.isin("residential", "living_street"),
        hw == "service",
        hw.isin("track", "bridleway"),
        hw == "busway",
        hw == "unclassified",
        hw.isin(MAIN),
    ]


def classify_edges(edges: DataFrame) -> DataFrame:
    """Adds is_cycling_street, has_track_tag, has_lane_tag, separate_geometry, matched_rules (numbers from 1) and edge_class."""
    conditions = rules(edges)
    matched = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions, 1)]))
    label = F.lit(OTHER)
    for c, name in reversed([*zip(conditions, REGIMES, strict=True)]):
        label = F.when(c, F.lit(name)).otherwise(label)
    return edges.withColumns(
        {"is_cycling_street": conditions[0], "has_track_tag": conditions[2], "has_lane_tag": conditions[4], "separate_geometry": conditions[1] | conditions[3], "matched_rules": matched, "edge_class": label}
    )


def written(edges: DataFrame) -> DataFrame:
    """Array columns of text as one text with `;`, as for files without arrays."""
    lists = [f.name for f in edges.schema if f.dataType.simpleString() == "array<string>"]
    return edges.withColumns({c: F.array_join(F.col(f"`{c}`"), ";") for c in lists})


def crosstab_margins(edges: DataFrame) -> DataFrame:
    """highway, edge_class, n, with All for either margin and the total; a missing highway is ''."""
    e = edges.select(tag(edges, "highway").alias("highway"), "edge_class")
    c = e.cube("highway", "edge_class").agg(F.count(F.lit(1)).alias("n"), F.grouping("highway").alias("gh"), F.grouping("edge_class").alias("gc"))
    name = lambda g, v: F.when(F.col(g) == 1, F.lit("All")).otherwise(F.col(v)).alias(v)
    return c.select(name("gh", "highway"), name("gc", "edge_class"), "n")


def crosstab_wide(edges: DataFrame) -> DataFrame:
    """crosstab_margins() with a column per class."""
    return crosstab_margins(edges).groupBy("highway").pivot("edge_class", [*dict.fromkeys(REGIMES), OTHER, "All"]).agg(F.coalesce(F.sum("n"), F.lit(0))).fillna(0)


def multi_match(classified: DataFrame) -> DataFrame:
    many = (F.size("matched_rules") > 1).cast("int")
    return classified.agg(F.count(F.lit(1)).alias("n_edges"), F.sum(many).cast("long").alias("n_multi"), F.avg(many).alias("multi_share"))


def condition_overlap(classified: DataFrame) -> DataFrame:
    """rule_a, rule_b, label_a, label_b, n: how many edges match both rules, for all 12 x 12 pairs."""
    spark = classified.sparkSession
    pairs = classified.select(F.explode("matched_rules").alias("rule_a"), "matched_rules").select("rule_a", F.explode("matched_rules").alias("rule_b"))
    counts = pairs.groupBy("rule_a", "rule_b").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(a, b, x, y) for a, x in enumerate(REGIMES, 1) for b, y in enumerate(REGIMES, 1)], "rule_a int, rule_b int, label_a string, label_b string")
    return grid.join(F.broadcast(counts), ["rule_a", "rule_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))  # 144 rows at most


def other_top(classified: DataFrame, most: int = 10) -> DataFrame:
    """The commonest highway values of edges that no rule matches."""
    o = classified.where(F.col("edge_class") == OTHER)
    return o.groupBy(tag(o, "highway").alias("highway")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "highway").limit(most)


def length_share(edges: DataFrame) -> DataFrame:
    """edge_class, km (one place), share of all km (three places), longest first; rounded half-even."""
    km = edges.groupBy("edge_class").agg((F.sum("length") / 1000).alias("k"))
    total = km.agg(F.sum("k").alias("total"))
    return km.join(F.broadcast(total), F.lit(True)).select("edge_class", F.bround("k", 1).alias("km"), F.bround(F.col("k") / F.col("total"), 3).alias("share")).orderBy(F.col("km").desc(), "edge_class")


def class_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "edge_class")


def large_classes(edges: DataFrame, least: int = 10) -> DataFrame:
    c = edges.groupBy("edge_class").agg(F.count(F.lit(1)).alias("n"), (F.sum("length") / 1000).alias("km"))
    return c.where(F.col("n") >= least).orderBy(F.col("n").desc(), "edge_class")


def sidepath_share(edges: DataFrame) -> DataFrame:
    side = F.coalesce(F.col("is_sidepath"), F.lit(False))
    return edges.agg(F.count_if(side).alias("n_sidepaths"), F.avg(side.cast("int")).alias("share"))
