from __future__ import annotations

import itertools

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velotrace.operators import matching as mm
from velotrace.operators import network as nw
from velotrace.operators.regions import lines_near_points, points_in_regions
from velotrace.operators.spatial_join import segments_near_points

TAGS = ", ".join(f"`{t}` array<string>" for t in nw.TAGS)
EDGE = f"u long, v long, key int, length double, {TAGS}, is_sidepath_tag string, geometry array<struct<x:double,y:double>>"


def edge(u, v, line, highway=("residential",), key=0, cycleway=None, cyclestreet=None, side=None, right=None, length=1.0):
    as_list = lambda t: None if t is None else list(t)
    return (u, v, key, length, as_list(highway), as_list(cycleway), None, as_list(right), None, as_list(cyclestreet), None, side, None if line is None else [(float(x), float(y)) for x, y in line])


def flags(spark, edges):
    df = spark.createDataFrame(edges, EDGE).select("*", *[F.lit("?").alias(c) for c in ("angle", "road", "line", "near", "dist_to_road", "cell", "salt")])
    return {(r.u, r.v): r.is_sidepath for r in nw.flag_sidepaths(df, sidepath_tag="is_sidepath_tag").collect()}


def test_tags(spark):
    data = [edge(1, 2, None, cycleway=c) for c in (["no", "lane"], ["no", "none"], ["none"], None, [], [None])]
    df = spark.createDataFrame(data, EDGE)
    assert [r[0] for r in df.select(nw.tag(df, "cycleway")).collect()] == ["lane", "no", "none", "", "no", ""]
    assert [r[0] for r in df.select(nw.tag(df, "not_there")).collect()] == [""] * 6


def test_sidepath_bands(spark):
    road = edge(1, 2, [(0, 0), (200, 0)])
    path = lambda i, line: edge(i, i + 1, line, ["path"])
    tilt = lambda deg, y, x=50: [(x, y), (x + 20 * np.cos(np.radians(deg)), y + 20 * np.sin(np.radians(deg)))]
    got = flags(spark, [road, path(10, [(50, 12), (60, 80)]), path(20, tilt(0, 12.01)), path(30, tilt(25, 12.01)), path(40, tilt(26, 12.01)), path(50, [(50, 31), (70, 31)]), path(60, [(50, 0), (50, 90)]),
                        edge(70, 71, [(900, 900), (950, 900)], side="yes"), edge(80, 81, None, ["path"])])
    assert got == {(1, 2): False, (10, 11): True, (20, 21): True, (30, 31): True, (40, 41): False, (50, 51): False, (60, 61): True, (70, 71): True, (80, 81): False}


def test_longest_segment_tie_takes_the_first(spark):
    df = spark.createDataFrame([edge(1, 2, [(0, 0), (10, 0), (10, 10)]), edge(3, 4, [(5, 5)])], EDGE)
    assert [r[0] for r in df.orderBy("u").select(nw.main_bearing(F.col("geometry"))).collect()] == [0.0, None]


def test_first_rule_decides(spark):
    data = [edge(1, 2, None, ["path"], cycleway=["track"], cyclestreet=["yes"]), edge(3, 4, None, ["steps"]), edge(5, 6, None, ["residential"], right=["lane"]), edge(7, 8, None, None)]
    df = nw.classify_edges(spark.createDataFrame(data, EDGE).withColumn("is_sidepath", F.lit(True)))
    got = {r.u: (r.edge_class, r.matched_rules) for r in df.collect()}
    assert got == {1: ("bicycle_street", [1, 2, 3]), 3: ("other", []), 5: ("painted_lane", [5, 7]), 7: ("other", [])}
    overlap = {(r.rule_a, r.rule_b): r.n for r in nw.condition_overlap(df).collect()}
    assert len(overlap) == 144 and overlap[1, 3] == overlap[3, 1] == 1 and overlap[7, 7] == 1 and overlap[12, 1] == 0
    total = [r.n for r in nw.crosstab_margins(df).collect() if r.highway == r.edge_class == "All"]
    assert total == [4]


def test_empty_network(spark):
    df = spark.createDataFrame([], EDGE)
    assert nw.flag_sidepaths(df).count() == 0
    assert nw.length_share(nw.classify_edges(nw.flag_sidepaths(df))).count() == 0


def brute(points, segs, reach):
    out = set()
    for p, x, y in points:
        for s, x0, y0, x1, y1 in segs:
            d = np.array([x1 - x0, y1 - y0])
            ll = d @ d
            u = 0.0 if ll == 0 else float(np.clip(((x - x0) * d[0] + (y - y0) * d[1]) / ll, 0, 1))
            if np.hypot(x - x0 - u * d[0], y - y0 - u * d[1]) <= reach:
                out.add((p, s))
    return out


place = st.floats(-120, 120, allow_nan=False).map(lambda v: round(v, 2))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pts=st.lists(st.tuples(place, place), min_size=1, max_size=40), segs=st.lists(st.tuples(place, place, place, place), min_size=1, max_size=12))
def test_near_joins_equal_brute_force(spark, pts, segs):
    points = [(i, x, y) for i, (x, y) in enumerate(pts)]
    lines = [(i, *s) for i, s in enumerate(segs)]
    want = brute(points, lines, 15.0)
    p = spark.createDataFrame(points, "point long, x double, y double")
    s = spark.createDataFrame(lines, "segment long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.point, r.segment) for r in segments_near_points(p, s, 15.0).collect()} == want
    g = s.select("segment", F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("geometry"))
    assert {(r.point, r.segment) for r in lines_near_points(p, g, ["segment"], 15.0).collect()} == want


def test_very_long_and_endless_lines(spark):
    points = spark.createDataFrame([(1, 3e5, 3e5 + 10.0), (2, 0.0, 0.0), (3, float("inf"), 1.0)], "point long, x double, y double")
    line = lambda *c: [{"x": float(x), "y": float(y)} for x, y in c]
    lines = spark.createDataFrame([("far", line((1e5, 1e5), (9e5, 9e5))), ("inf", line((0, 0), (float("inf"), 0))), ("nan", line((0, 0), (1, float("nan"))))], "name string, geometry array<struct<x:double,y:double>>")
    assert [(r.point, r["name"]) for r in lines_near_points(points, lines, ["name"], 15.0).collect()] == [(1, "far")]


def test_regions_with_holes_of_shape_and_boundaries(spark):
    ring = lambda *c: [{"x": float(x), "y": float(y)} for x, y in c]
    u_shape = ring((0, 0), (90, 0), (90, 60), (60, 60), (60, 30), (30, 30), (30, 60), (0, 60))
    regions = spark.createDataFrame([("u", u_shape), ("bad", ring((0, 0), (1, 1))), ("none", None)], "region string, ring array<struct<x:double,y:double>>")
    pts = {"in": (15, 45), "gap": (45, 45), "base": (45, 15), "out": (-1, 15), "left": (0, 15), "corner_ray": (-5, 30), "right": (90, 15), "nan": (float("nan"), 1), "null": (None, 3)}
    points = spark.createDataFrame([(k, None if x is None else float(x), float(y)) for k, (x, y) in pts.items()], "point string, x double, y double")
    assert {r.point for r in points_in_regions(points, regions, cell_m=25.0).collect()} == {"in", "base", "left", "right"}


def test_hot_cell_is_split(spark):
    points = spark.range(3000).select(F.col("id").alias("point"), F.lit(5.0).alias("x"), F.lit(5.0).alias("y"))
    regions = spark.createDataFrame([("r", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "region string, ring array<struct<x:double,y:double>>")
    assert points_in_regions(points, regions, rows_per_split=100).count() == 3000


def test_matching_follows_the_road(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 100.0, 40.0), (4, 100.0, 40.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (2, 4, 0), (9, 1, 0), (None, 1, 0)], "u long, v long, key int")
    chords = mm.straight_map(edges, nodes)
    assert chords.count() == 6
    walk = [("b", "t", f"t_p{i}", i, 10.0 * i, 3.0 * (-1) ** i) for i in range(20)] + [("b", "far", "far_p0", 0, 900.0, 900.0)]
    points = spark.createDataFrame(walk, "boxId string, traj_id string, point_id string, ordinal long, x double, y double")
    got = {r.point_id: (r.u, r.v) for r in mm.match_paths(points, chords).collect()}
    assert got["far_p0"] == (None, None)
    assert {got[f"t_p{i}"] for i in range(1, 9)} == {(1, 2)} and {got[f"t_p{i}"] for i in range(12, 20)} == {(2, 3)}
    near = {r.point_id: (r.u, r.v) for r in mm.nearest_edge(points.select("point_id", "x", "y"), chords).collect()}
    assert near["t_p2"] == (1, 2) and "far_p0" not in near


def test_matching_finds_ways_of_any_length(spark):
    corners = [(i, 100.0 * i, 0.0) for i in range(31)] + [(40, 3040.0, 0.0), (41, 3140.0, 0.0), (42, 3000.0, 600.0), (43, 3040.0, 600.0), (50, 9000.0, 0.0), (51, 9100.0, 0.0)]
    nodes = spark.createDataFrame(corners, "node_id long, x double, y double")
    edges = spark.createDataFrame([*((i, i + 1) for i in range(30)), (30, 42), (42, 43), (43, 40), (40, 41), (50, 51)], "u long, v long")
    places = [*range(5, 100, 5), *range(2005, 2100, 5), *range(2905, 3000, 5), *range(3092, 3140, 5)]  # an outage of 1.9 km, and of 0.8 km; then a way round of 1.2 km
    walk = [("b", "t", f"t_p{i}", i, float(x), 0.0) for i, x in enumerate(places)] + [("b", "t", f"t_p{len(places)}", len(places), 9050.0, 0.0)]
    points = spark.createDataFrame(walk, "boxId string, traj_id string, point_id string, ordinal long, x double, y double")
    got = {r.point_id: (r.u, r.v) for r in mm.match_paths(points, mm.straight_map(edges, nodes)).collect()}
    at = [got[f"t_p{i}"] for i in range(len(walk))]
    assert set(at[1:18]) == {(0, 1)} and set(at[20:37]) == {(20, 21)} and set(at[39:56]) == {(29, 30)} and set(at[58:-1]) == {(40, 41)}
    assert at[-1] == (None, None)  # no way leads there


def test_matching_keeps_all_candidates(spark):
    ends = [(100 + k, 0.0, 2.0 * k) for k in range(-6, 7)] + [(200 + k, 300.0, 2.0 * k) for k in range(-6, 7)] + [(300, 600.0, 20.0)]
    nodes = spark.createDataFrame([(n, x, y) for n, x, y in ends if n != 206] + [(206, 300.0, 20.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([*((100 + k, 200 + k) for k in range(-6, 7)), (206, 300)], "u long, v long")  # 13 streets side by side, of which the outermost only goes on
    places = [*range(5, 300, 10), *range(305, 600, 10)]
    walk = [("b", "t", f"t_p{i}", i, float(x), 0.0) for i, x in enumerate(places)]
    points = spark.createDataFrame(walk, "boxId string, traj_id string, point_id string, ordinal long, x double, y double")
    got = {r.point_id: (r.u, r.v) for r in mm.match_paths(points, mm.straight_map(edges, nodes)).collect()}
    assert {got[f"t_p{i}"] for i in range(30)} == {(106, 206)} and {got[f"t_p{i}"] for i in range(31, 60)} == {(206, 300)}


def grid_of_streets(n=4, step=60.0):
    """A lattice of two-way streets: u, v, ends."""
    at = {(i, j): n * i + j for i in range(n) for j in range(n)}
    pairs = [(a, b) for (i, j), a in at.items() for b in (at.get((i + 1, j)), at.get((i, j + 1))) if b is not None]
    xy = lambda k: (step * (k // n), step * (k % n))
    both = [*pairs, *((b, a) for a, b in pairs)]
    return np.array([a for a, _ in both]), np.array([b for _, b in both]), np.array([[*xy(a), *xy(b)] for a, b in both])


def best_path(grid, roads, how, xy):
    """Likelihood and edges of the best path by trying all of them."""
    steps = []
    for i, (x, y) in enumerate(xy):
        _, c, d, s = grid.near(np.array([x]), np.array([y]), np.array([how.max_dist_init if i == 0 else how.max_dist]))
        steps.append(list(zip(c.tolist(), d.tolist(), s.tolist(), strict=True)))
    best = (-np.inf, None)
    for path in itertools.product(*steps):
        score = -(path[0][1] ** 2) / (2 * how.noise**2)
        for (c0, _, s0), (c1, d1, s1), (p0, p1) in zip(path, path[1:], itertools.pairwise(xy), strict=False):
            way = abs(s1 - s0) if c0 == c1 and s1 - s0 >= -how.noise else grid.length[c0] - s0 + roads.distances(int(grid.v[c0]), {int(grid.u[c1])}).get(int(grid.u[c1]), np.inf) + s1
            score += -abs(way - np.hypot(*np.subtract(p1, p0))) / how.noise - d1**2 / (2 * how.noise**2)
        best = max(best, (score, path), key=lambda b: b[0])
    return best


def test_decoder_equals_all_paths_tried():
    rng = np.random.default_rng(5)
    u, v, ends = grid_of_streets()
    how = mm.Matching(max_dist=32.0, max_dist_init=32.0, min_prob_norm=1e-30)
    grid = mm.Grid(u, v, ends, 32.0)
    roads = mm.Roads(u, v, grid.length)
    for _ in range(25):
        xy = [(float(a), float(b)) for a, b in np.cumsum(rng.normal(0, 12, (4, 2)), axis=0) + rng.uniform(20, 160, 2)]
        score, path = best_path(grid, roads, how, xy)
        decoder = mm.Decoder(grid, roads, how)
        for x, y in xy:
            p, c, d, s = grid.near(np.array([x]), np.array([y]), np.array([32.0]))
            decoder.point(x, y, c, d, s)
        got = decoder.finish()
        assert path is not None and len(got) == 4 and not decoder.over
        assert abs(score - decoder.score.max()) < 1e-9


def test_long_trajectories_are_decoded_in_parts():
    rng = np.random.default_rng(6)
    u, v, ends = grid_of_streets(8)
    how = mm.Matching(min_prob_norm=1e-300)
    grid = mm.Grid(u, v, ends, 60.0)
    x = np.clip(210 + np.cumsum(rng.normal(0, 3, 3000)), 0, 420)
    y = np.clip(210 + np.cumsum(rng.normal(0, 3, 3000)), 0, 420)
    p, c, d, s = grid.near(x, y, np.full(3000, 50.0))
    at = np.searchsorted(p, np.arange(3001))
    whole, parts, found, most = (mm.Decoder(grid, mm.Roads(u, v, grid.length), how), mm.Decoder(grid, mm.Roads(u, v, grid.length), how), [], 0)
    for i in range(3000):
        k = slice(at[i], at[i + 1])
        whole.point(x[i], y[i], c[k], d[k], s[k])
        parts.point(x[i], y[i], c[k], d[k], s[k])
        most = max(most, len(parts.held))
        if i % 100 == 99:
            found += parts.certain()
    assert found + parts.finish() == whole.finish() and most < 1000
