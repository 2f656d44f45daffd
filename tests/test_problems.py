from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import LAT, LON, M_LAT, M_LON, RAW, T0, at, dicts, reading, us
from velotrace.functions.geo import with_utm32
from velotrace.operators.orphans import event_orphans, orphan_report, orphans
from velotrace.operators.regions import edges_near_detections
from velotrace.operators.regular import missing_periods, regular_series
from velotrace.operators.runlength import Alike, joined, pieces
from velotrace.operators.shards import sharded
from velotrace.operators.spikes import hampel, judged, strange_readings, strange_rides
from velotrace.operators.stops import Dwelling, corners, found_slots, trips_and_stops

BAD = [reading(900, 1, "5", lat=None), reading(901, 1, "5", lon=None), reading(902, None, "5"), reading(903, 1, "5", box=None), (904, None, None, None, None, None, None)]
#: Readings that count but have no name.
NAMELESS = [reading(None, 7777 + i, "77", box="nameless") for i in range(30)]


def clash(df):
    """Extra columns named as the operators name theirs."""
    return df.select("*", *[F.lit("?").alias(c) for c in ("t", "shard", "num", "box", "x", "cell", "point", "ride", "key", "part")])


# 1


EV = "event_uid string, closest_point_id string, u long, v long, start timestamp, loaded_at timestamp"


def world(spark, events, points=(), retracted=(), nodes=(), edges=()):
    make = lambda rows, schema: clash(spark.createDataFrame(list(rows), schema)) if "u long" not in schema else spark.createDataFrame(list(rows), schema)
    return event_orphans(
        make(events, EV), make(points, "point_id string, loaded_at timestamp"), make(retracted, "point_id string, retracted_at timestamp"), make(nodes, "node_id long"), make(edges, "u long, v long")
    )


def test_orphans_cases(spark):
    e = lambda uid, p, u, v, t=10: (uid, p, u, v, at(0), None if t is None else at(t))
    events = [
        e("ok", "p1", 1, 2), e("ok", "p1", 1, 2, 99), e("later", "p2", 2, 1), e("exact", "p3", None, None), e("gone", "p4", None, None), e("gone_at", "p5", None, None), e("gone_later", "p6", None, None),
        e("none", "zz", 9, 2), e("pair", None, 1, 3), e("empty", "", 1, None), e("first", "p2", None, None, 5), e("first", "p2", None, None, 50), e("untimed", "p2", None, None, None), e(None, "zz", 8, 1), e(None, "yy", 1, 3),
    ]
    points = [("p1", at(5)), ("p1", at(50)), ("p2", at(20)), ("p3", at(10)), ("p4", at(1)), ("p5", at(1)), ("p6", at(1)), (None, at(1)), ("p7", None)]
    gone = [("p4", at(2)), ("p5", at(10)), ("p6", at(11)), ("p6", None), (None, at(1))]
    got = Counter((r.event_uid, r.ref_field) for r in world(spark, events, points, gone, [(1,), (2,), (3,), (3,), (None,)], [(2, 1), (1, 2), (None, 3)]).collect())
    assert got == Counter(
        [("later", "closest_point_id"), ("gone", "closest_point_id"), ("gone_at", "closest_point_id"), ("none", "closest_point_id"), ("none", "u"), ("pair", "edge"), ("first", "closest_point_id"),
         (None, "closest_point_id"), (None, "closest_point_id"), (None, "u"), (None, "edge")]
    )


def test_orphans_of_empty_tables(spark):
    assert world(spark, []).count() == 0
    found = world(spark, [("a", "p", 1, 2, at(0), at(1))])
    assert {r.ref_field for r in found.collect()} == {"closest_point_id", "u", "v"}
    assert {(r.ref_table, r.ref_field, r.period, r.n_orphans) for r in orphan_report(found).collect()} == {("matched_points", "closest_point_id", "2024-05-01", 1), ("network_nodes", "u", "2024-05-01", 1), ("network_nodes", "v", "2024-05-01", 1)}


def test_orphans_with_hot_key_and_many_ranges(spark):
    refs = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
    refs = refs.select(F.struct("id").alias("ref"), "key", F.lit(5).cast("long").alias("at"))
    parents = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(1).cast("long").alias("since"), F.lit(None).cast("long").alias("gone"))
    got = {r.ref.id for r in orphans(refs, parents, keys_per_range=100, references_per_split=200).collect()}
    assert got == {i for i in range(6000) if i % 3 == 0 or i >= 5000}


# 2


def test_detections_near_edges(spark):
    data = [reading(1, 0, "120"), reading(2, 1, "0"), reading(3, 2, "x"), reading(4, 3, "80", lat=LAT + 500 * M_LAT), reading(6, 0, "50"), reading(5, 4, " 90 "), *BAD, *NAMELESS]
    r = clash(spark.createDataFrame(data, RAW))
    x, y = 405177.0, 5757490.0
    from velotrace.operators.points import load_points

    p = load_points(r.where("row_seq = 1")).first()
    x, y = p.x, p.y
    edge = lambda u, v, k, line: (u, v, k, None if line is None else [(float(a), float(b)) for a, b in line])
    edges = [edge(1, 2, 0, [(x - 50, y + 14.9), (x + 50, y + 14.9)]), edge(1, 2, 0, [(x - 50, y + 14.9), (x + 50, y + 14.9)]), edge(2, 3, 0, [(x - 50, y + 15.1), (x + 50, y + 15.1)]), edge(3, 4, 1, None),
             edge(4, 5, 0, [(x + 3, y)]), edge(None, 5, 0, [(x, y), (x, y)]), edge(5, 6, 2, [(x + 14.9, y), (x + 100, y)])]
    e = spark.createDataFrame(edges, "u long, v long, key int, geometry array<struct<x:double,y:double>>")
    got = {(q.row_seq, q.u, q.v, q.edge_key) for q in edges_near_detections(r, e).collect()}
    assert got == {(s, *k) for s in (1, 5) for k in ((1, 2, 0), (4, 5, 0), (5, 6, 2))}
    assert edges_near_detections(r.limit(0), e).count() == 0 and edges_near_detections(r, e.limit(0)).count() == 0


# 3


def test_series_fills_and_marks(spark):
    data = [reading(1, 0, "x"), reading(2, 12, "7"), reading(3, 12, "9"), reading(4, 13, "8"), reading(5, 45, None), reading(6, 640, "3"), reading(7, 2000, "1"), *BAD]
    got = sorted(dicts(regular_series(clash(spark.createDataFrame(data, RAW)))), key=lambda r: r["cell_s"])
    t = us(0) // 1_000_000
    assert [r["cell_s"] for r in got] == list(range(t, t + 641, 10))
    assert [(r["status"], r["n_numbers"], r["mean_value"], r["filled_value"]) for r in got[:3]] == [("empty", 0, None, None), ("observed", 2, 7.5, 8.0), ("filled", 0, None, 8.0)]
    assert got[-1]["last_value"] == 3.0 and got[-2]["filled_value"] == 8.0
    assert missing_periods(regular_series(spark.createDataFrame(data, RAW))).count() == 63
    assert regular_series(spark.createDataFrame([], RAW)).count() == 0
    assert regular_series(spark.createDataFrame(NAMELESS, RAW)).agg(F.sum("n_numbers")).first()[0] == 30
    assert regular_series(spark.createDataFrame(data[:4], RAW)).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        regular_series(spark.createDataFrame([], RAW), period_s=7)


# runs


def brute_runs(items, alike, ride_gap, least_rows):
    """items per entity in order: (t, v or None, item)."""
    out, ride, rides = [], [], []
    for r in items:
        if ride and ride_gap is not None and r[0] - ride[-1][0] > ride_gap:
            rides.append(ride)
            ride = []
        ride.append(r)
    rides.append(ride)
    for ride in rides:
        if len(ride) < least_rows:
            continue
        run = []
        for t, v, item in ride:
            if not item:
                continue
            fit = v is not None and (alike.lowest is None or (abs(v) if alike.absolute else v) > alike.lowest)
            if run and not (fit and abs(v - run[-1][1]) <= alike.tolerance and (alike.gap_us is None or t - run[-1][0] <= alike.gap_us)):
                out.append(run)
                run = []
            if fit:
                run.append((t, v))
        out.append(run)
    return sorted((r[0][0], r[-1][0], len(r)) for r in out if len(r) >= alike.least)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from([1, 1, 2, 3, 4, 9, 11, 25]), st.sampled_from([None, 0.0, 1.0, 1.4, 2.0, 9.0]), st.booleans()), min_size=1, max_size=120),
    st.sampled_from([Alike(0.5, 3, 3, 0.0), Alike(0.5, None, 2, 0.0, absolute=True), Alike(0.0, 12, 2)]),
)
def test_runs_equal_brute_force(spark, steps, alike):
    t, items = 0, []
    for gap, v, item in steps:
        t += gap
        items.append((t, v, item or v is not None))
    rows = spark.createDataFrame([("e", t, t, i, item, v) for i, (t, v, item) in enumerate(items)], "entity string, t long, t_end long, id long, item boolean, v double")
    got = joined(pieces(sharded(rows, 10), alike, copies=False), alike, 10, 5)
    assert sorted((r.t0, r.t1, r.n) for r in got.collect()) == brute_runs(items, alike, 10, 5)


def test_runs_go_on_over_shards_without_items(spark):
    rows = [("e", t, t, t, t not in range(10, 20), 1.0 if t not in range(10, 20) else None) for t in range(2, 29, 2)]
    df = spark.createDataFrame(rows, "entity string, t long, t_end long, id long, item boolean, v double")
    alike = Alike(0.5, None, 2)
    got = joined(pieces(sharded(df, 10), alike, copies=False), alike, 10, 5).collect()
    assert [(r.t0, r.t1, r.n) for r in got] == [(2, 28, 9)] == brute_runs([(r[1], r[5], r[4]) for r in rows], alike, 10, 5)


# 4


def test_hampel_takes_both_levels():
    rng = np.random.default_rng(1)
    v = np.r_[rng.normal(150, 5, 400), rng.normal(300, 5, 400)]
    for k, x in ((100, 90.0), (398, 225.0), (402, 240.0), (700, 380.0)):
        v[k] = x
    assert set(np.flatnonzero(hampel(v) > 4.5)) == {100, 398, 402, 700}
    v[50] = 300  # the other level is usual too
    assert set(np.flatnonzero(hampel(v) > 4.5)) == {100, 398, 402, 700}
    assert np.isnan(hampel(np.array([1.0, 2.0, 900.0]))).all() and len(hampel(np.zeros(0))) == 0
    assert np.flatnonzero(hampel(np.r_[np.full(20, 10.0), 40.0]) > 4.5).tolist() == [20]


def test_planted_cases_are_told_from_ordinary_values():
    rng = np.random.default_rng(8)
    wrong = 0
    for n in (40, 130, 400, 1500, 5000):
        for _ in range(12):
            level, unit, change = rng.uniform(90, 230), rng.uniform(5, 15), rng.integers(n // 3, 2 * n // 3)
            step = np.where(np.arange(n) < change, 0, rng.choice([0.0, 6.0, -5.0]) * unit)
            v = level + step + unit * np.clip(rng.normal(0, 1, n), -3, 3)
            cases = np.flatnonzero(rng.random(n) < 0.02)
            v[cases] = (level + step + unit * rng.choice([-8.5, 15.0, 9.0], n))[cases]
            far = np.minimum(np.abs(v - level), np.abs(v - level - step[-1])) >= 8 * unit
            wrong += (np.round(v * 2) / 2, (hampel(np.round(v * 2) / 2) > 4.5) != far)[1].sum()
    assert wrong <= 2  # of 85,000


def ranks(spark, boxes):
    rows = [(b, i, len(v), 10_000 * j + i, float(x), 0) for j, (b, v) in enumerate(boxes.items()) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "box string, rank long, total long, row_seq long, num double, kind int")


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(150, 5, 3000), 1)
    v[::211] += 70
    rows = ranks(spark, {"b": v, "c": v[:1], "d": v[:300]})
    got = [sorted(r.row_seq for r in judged(rows, block=b).collect()) for b in (250, 100_000)]
    assert got[0] == got[1] == [*range(0, 3000, 211), *range(20_000, 20_300, 211)]


def test_strange_readings(spark):
    data = [reading(i, 3 * i, str(100 + i % 7)) for i in range(300)]
    data += [reading(1000 + i, 1000 + i, "55.5") for i in range(19)] + [reading(1100, 1019.5, "err"), reading(1101, 1020, "55.9"), reading(1102, 1021, "0"), reading(1103, 1030, "-3"), reading(1104, 1031, "401"), reading(1105, 1032, "400"), reading(1106, 1033, "inf")]
    data += [reading(2000 + i, 1300 + i, "70") for i in range(19)] + [reading(3000, 1000, "999"), *BAD]
    got = {}
    data += NAMELESS
    for r in strange_readings(clash(spark.createDataFrame(data, RAW))).collect():
        got.setdefault(r.reason, set()).add(r.row_seq)
    assert got["bounds"] == {1103, 1104, 1106}
    assert got["stuck"] == {1101, *range(1000, 1019)}
    assert 1105 in got["far_off"] and not got["far_off"] & set(range(300))
    assert strange_readings(spark.createDataFrame([], RAW)).count() == 0


def test_strange_rides(spark):
    rows = [("b", f"b_{i}", 5 + i % 3, 200, 10.0 + i % 5) for i in range(12)]
    rows += [("b", "neg", -1, 200, 9.0), ("b", "over", 300, 200, 9.0), ("b", "far", 72, 200, 80.0), ("b", "rate", 5, 200, 121.0), ("b", "near", 6, 200, 39.0), ("b", "high", 24, 200, 9.0), ("b", "not_far", 71, 200, 41.0), ("b", "nulls", None, None, None), ("b", "nan", 5, 10, float("nan")),
             ("b", "below", 5, 200, -4.0), (None, "lone", 24, 200, 1.0), ("b", None, 99, 10, 1.0)]
    df = spark.createDataFrame([*rows, rows[-4]], "boxId string, traj_id string, longest_nonzero_run long, n_points long, raw_per_km double")
    got = sorted((r.traj_id, r.reason) for r in strange_rides(clash(df)).collect())
    assert got == [("below", "rate_impossible"), ("far", "run_far_off"), ("neg", "run_impossible"), ("over", "run_impossible"), ("rate", "rate_far_off")]
    assert strange_rides(df.limit(0)).count() == 0


# 5


def route(parts, box="b", seq=0, noise=2.0, seed=3):
    """Readings a second of parts (seconds, metres per second to the east); times in parts with None speed are skipped."""
    rng = np.random.default_rng(seed)
    out, t, x = [], 0, 0.0
    for n, speed in parts:
        for _ in range(n):
            if speed is not None:
                x += speed
                out.append(reading(seq + t, t, "0", LAT + rng.normal(0, noise) * M_LAT, LON + (x + rng.normal(0, noise)) * M_LON, box))
            t += 1
    return out


def summary(df):
    return [(r.kind, round((r.t0 - us(0)) / 1e6), round((r.t1 - us(0)) / 1e6)) for r in df.orderBy("box", "t0", F.col("kind") != "ride").collect()]


def close_to(got, want, s=12):
    assert [g[0] for g in got] == [w[0] for w in want], got
    assert all(abs(a - b) <= s for g, w in zip(got, want, strict=True) for a, b in zip(g[1:], w[1:], strict=True)), got


def test_ride_with_stops(spark):
    data = route([(100, 4), (180, 0), (60, 4), (90, 0), (200, 5), (40, 0), (300, None), (50, 0), (120, 4)])
    data[150] = reading(150, 150, "0", LAT + 700 * M_LAT, LON)
    data[160] = reading(160, 160, "0", 0.0, 0.0)
    data[161] = reading(161, 161, "0", LON, LAT)
    data += [reading(5000, 150.0, "0", 1.0, 1.0), *BAD]
    got = trips_and_stops(clash(spark.createDataFrame(data, RAW)))
    close_to(summary(got), [("ride", 0, 1139), ("move", 0, 99), ("stop", 100, 280), ("move", 281, 629), ("stop", 630, 1019), ("move", 1020, 1139)])
    ride = got.where("kind = 'ride'").first()
    assert abs(ride.reach_m - (400 + 240 + 1000 + 480)) < 20 and ride.n_pings == len(data) - 1 - len(BAD)
    slots = {(r.kind, r.slot) for r in found_slots(got).collect()}
    t = us(0) // 1_000_000
    assert slots == {("trip", (t + 569) // 600), ("stop", (t + 190) // 600), ("stop", (t + 825) // 600)}


def test_parked_all_the_time_over_many_shards(spark):
    got = trips_and_stops(spark.createDataFrame(route([(3000, 0), (500, None), (1500, 0)]), RAW), Dwelling(shard_s=300))
    close_to(summary(got), [("ride", 0, 4999), ("stop", 0, 4999)], 3)
    assert got.where("kind = 'ride'").first().reach_m < 30


def test_shards_do_not_change_trips(spark):
    data = route([(50, 4), (700, 0), (400, 3), (130, 0), (900, 4), (650, None), (400, 0), (60, 5)]) + route([(100, 0), (500, 2)], "c", 100_000, seed=9)
    df = spark.createDataFrame(data, RAW).cache()
    got = [summary(trips_and_stops(df, Dwelling(shard_s=s))) for s in (400, 1800, 100_000)]
    close_to(got[0], got[2], 3)
    close_to(got[1], got[2], 3)
    assert [k for k, *_ in got[2]].count("ride") == 3


def test_leaving_and_coming_back_is_two_stops(spark):
    data = route([(200, 0), (20, 4), (20, -4), (200, 0)])
    close_to(summary(trips_and_stops(spark.createDataFrame(data, RAW))), [("ride", 0, 439), ("stop", 0, 200), ("move", 206, 233), ("stop", 240, 439)])


def test_reach_is_exact_in_every_direction(spark):
    toward = lambda deg, t: (LAT + 4 * t * np.sin(np.radians(deg)) * M_LAT, LON + 4 * t * np.cos(np.radians(deg)) * M_LON)
    df = spark.createDataFrame([reading(100 * d + t, t, "0", *map(float, toward(d + 0.5, t)), f"b{d}") for d in range(12) for t in range(51)], RAW)
    far = {}
    for r in with_utm32(df.select("row_seq", "lat", "lon")).orderBy("row_seq").collect():
        far.setdefault(f"b{r.row_seq // 100}", []).append((r.x, r.y))
    got = {r.box: r.reach_m for r in trips_and_stops(df, Dwelling(shard_s=30)).where("kind = 'ride'").collect()}
    for box, xy in far.items():
        assert abs(got[box] - np.hypot(*(np.array(xy) - np.median(xy[:5], axis=0)).T).max()) < 1e-6
    rng = np.random.default_rng(4)
    x, y, g = np.round(rng.normal(0, 9, 900)), np.round(rng.normal(0, 9, 900)), np.sort(rng.integers(0, 9, 900))
    k = corners(x, y, g)
    for cx, cy in rng.normal(0, 30, (9, 2)):
        d = np.hypot(x - cx, y - cy)
        assert all(d[g == n].max() == d[k][g[k] == n].max() for n in range(9))


def test_degenerate_pings(spark):
    same = [reading(i, 0) for i in range(10)]
    assert trips_and_stops(spark.createDataFrame(same, RAW)).count() == 0  # one reading that counts
    nan = [reading(i, i, lat=float("nan")) for i in range(6)]
    got = dicts(trips_and_stops(spark.createDataFrame(nan, RAW)))
    assert [(r["kind"], r["reach_m"], r["n_pings"]) for r in got] == [("ride", None, 6)]
    assert trips_and_stops(spark.createDataFrame([], RAW)).count() == 0
    assert [(r.kind, r.n_pings) for r in trips_and_stops(spark.createDataFrame(NAMELESS, RAW)).collect()] == [("ride", 30), ("move", 30)]
    assert T0.year == 2024
