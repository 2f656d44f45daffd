from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import LAT, LON, M_LAT, M_LON, RAW, dicts, reading, us
from velotrace.functions.geo import axis_angle, compass_bearing, point_segment_distance, utm32
from velotrace.operators import events as ev
from velotrace.operators import points as pt
from velotrace.operators import quality as ql
from velotrace.plans import core


def load(spark, data):
    return pt.load_points(spark.createDataFrame(data, RAW))


def trace(spark, data, **how):
    return pt.trace(pt.segment(load(spark, data), **how))


def tours(spark, data, **how):
    return pt.journeys(load(spark, data), **how)


def test_projection(spark):
    df = spark.createDataFrame([(51.9607, 7.6261), (None, 7.0)], "lat double, lon double")
    a, b = df.select(*[c.alias(n) for c, n in zip(utm32(F.col("lat"), F.col("lon")), "xy", strict=True)]).collect()
    assert (round(a.x, 3), round(a.y, 3)) == (405600.613, 5757558.641)
    assert b.x is None


def test_bearings_and_angles(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0), (0.0, 0.0)], "dx double, dy double")
    assert [r[0] for r in df.select(compass_bearing(F.col("dx"), F.col("dy"))).collect()] == [0, 90, 180, 270, 0]
    one = spark.range(1)
    assert one.select(axis_angle(F.lit(5.0), F.lit(175.0))).first()[0] == 10
    assert one.select(point_segment_distance(*[F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)])).first()[0] == 5


def test_cleaning_keeps_rows_without_number(spark):
    data = [reading(i, i, v) for i, v in enumerate(["abc", "NaN", "5", None, " 7 ", "0"])] + [
        reading(10, 10, lat=None), reading(11, 11, lon=None), reading(12, None), reading(13, 13, box=None)]
    got = {r["row_seq"]: r["value"] for r in dicts(load(spark, data))}
    assert got == {0: None, 1: None, 2: 5.0, 3: None, 4: 7.0, 5: 0.0}


def test_gap_of_exactly_ten_minutes_goes_on(spark):
    data = [reading(i, s) for i, s in enumerate([0, 600, 1200, 1800, 2400, 3000.000001, 3600.000001, 3601, 3602, 3603])]
    got = trace(spark, data).groupBy("traj_id").count()
    assert {(r.traj_id, r["count"]) for r in got.collect()} == {("b_1", 5), ("b_2", 5)}


def test_small_trajectories_keep_their_number(spark):
    data = [reading(i, i) for i in range(4)] + [reading(10 + i, 5000 + i) for i in range(5)]
    assert {r.traj_id for r in trace(spark, data).collect()} == {"b_2"}


def test_ties_in_time_are_ordered_by_row_seq(spark):
    data = [reading(5 - i, 0) for i in range(5)]
    got = {r.row_seq: r.point_id for r in trace(spark, data).collect()}
    assert got == {i: f"b_1_p{i - 1}" for i in range(1, 6)}


def test_steps_and_bearings_over_cells(spark):
    # one reading every 200 s crosses a cell border often
    data = [reading(i, 200 * i, lat=LAT + 10 * i * M_LAT) for i in range(12)]
    got = sorted(dicts(trace(spark, data)), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in got] == list(range(12))
    assert got[0]["step_m"] == 0 and all(abs(r["step_m"] - 10) < 0.05 for r in got[1:])
    assert all(abs(r["bearing"] - got[1]["bearing"]) < 0.05 for r in got)


def test_lone_point_has_bearing_zero(spark):
    got = dicts(trace(spark, [reading(1, 0)], min_points=1))
    assert [(r["bearing"], r["step_m"]) for r in got] == [(0.0, 0.0)]


def test_longest_run_over_cells_and_nulls(spark):
    values = ["5"] * 4 + ["x"] + ["6"] * 7 + ["0", "1"]
    data = [reading(i, 250 * i, v) for i, v in enumerate(values)]
    assert ql.longest_runs(tours(spark, data)).first().longest_nonzero_run == 7


def test_quality_flags(spark):
    still = [reading(i, 0, "1" if i < 2 else "0", box="still") for i in range(5)]
    null = [reading(100 + i, i, "x" if i == 2 else "3", box="null") for i in range(5)]
    ride = [reading(200 + i, i, "9" if i in (3, 4, 9) else "0", lat=LAT + 5 * i * M_LAT, box="ride") for i in range(60)]
    got = {r["boxId"]: r for r in dicts(ql.quality_table(ql.trajectory_stats(tours(spark, still + null + ride))))}
    assert got["still"]["mean_speed_kmh"] is None and not got["still"]["f_speed"]
    assert got["still"]["nonzero_share"] == 0.4 and not got["still"]["f_nz_share"]
    assert got["still"]["raw_per_km"] is None and got["still"]["f_too_short"] and not got["still"]["f_rate"]
    assert got["null"]["value_max"] is None and got["null"]["nonzero_share"] == 0.8
    assert got["null"]["flag_reasons"] == "speed,nz_share,long_run,too_short"
    assert got["ride"]["keep"] and got["ride"]["flag_reasons"] == "ok" and got["ride"]["longest_nonzero_run"] == 2


def test_reports_agree(spark):
    data = [reading(1000 * b + i, i, str(i % (b + 1)), lat=LAT + (4 + b) * i * M_LAT, box=f"b{b}") for b in range(4) for i in range(80)]
    q = ql.quality_table(ql.trajectory_stats(tours(spark, data)))
    s = ql.keep_summary(q).first()
    assert s.n == 4 == sum(r.n for r in ql.flag_histogram(q).collect())
    assert s.n_kept == q.where("flag_reasons = 'ok'").count()


def test_good_scope(spark):
    data = [reading(i, i) for i in range(5)] + [reading(10 + i, 9000 + i) for i in range(5)]
    j = tours(spark, data).of(spark.createDataFrame([("b_2",)], "traj_id string"))
    assert {r.point_id for r in pt.trace(pt.segment(load(spark, data), among=j)).collect()} == {f"b_2_p{i}" for i in range(5)}
    t = trace(spark, data[:5])
    assert pt.scope_to_good(t, None).count() == 5
    assert pt.scope_to_good(t, spark.createDataFrame([], "traj_id string")).count() == 0


def test_events_merge_at_three_seconds(spark):
    hits = {0: "140", 3: "120", 6.000001: "150", 20: "120", 21: "0", 22: "120", 23: "150"}
    data = [reading(i, s, v) for i, (s, v) in enumerate(sorted(hits.items()))]
    got = sorted(dicts(ev.overtake_events(tours(spark, data))), key=lambda r: r["event_id"])
    assert [(r["event_uid"], r["n_samples"], r["min_clearance_cm"], r["is_close"]) for r in got] == [
        ("b_1_ev1", 2, 120, True), ("b_1_ev2", 1, 150, False), ("b_1_ev3", 3, 120, True)]
    assert got[2]["closest_point_id"] == "b_1_p3" and got[2]["last_point_id"] == "b_1_p6" and got[0]["duration_s"] == 3


def test_events_go_over_cells(spark):
    data = [reading(i, 2 * i, "5" if i % 50 else "0") for i in range(1000)]
    got = sorted((r.event_id, r.n_samples) for r in ev.overtake_events(tours(spark, data)).collect())
    assert got == [(i + 1, 49) for i in range(20)]
    long = [reading(i, 3 * i, "5") for i in range(1000)]
    assert [(r.event_id, r.n_samples) for r in ev.overtake_events(tours(spark, long)).collect()] == [(1, 1000)]


def test_summary_without_events(spark):
    t = tours(spark, [reading(i, i, lat=LAT + 50 * i * M_LAT) for i in range(6)])
    s = dicts(ev.summarise(t, ev.overtake_events(t)))[0]
    assert (s["n_overtakes"], s["min_overtake_cm"], s["overtake_rate_per_km"]) == (0, None, 0.0)


def test_empty_table(spark):
    rows, t = trace(spark, []), tours(spark, [])
    assert rows.count() == 0 == t.cells.count()
    e = ev.overtake_events(t)
    assert e.count() == 0 and ev.summarise(t, e).count() == 0
    assert ql.quality_table(ql.trajectory_stats(t)).count() == 0 and pt.trajectory_lines(rows).count() == 0 == ql.box_overview(t).count()


def test_clip_is_closed_and_comes_first(spark):
    data = [reading(i, 400 * i, lon=LON + (100_000 * M_LON if i == 2 else 0)) for i in range(12)]
    ext = load(spark, data[:1]).agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
    kept = pt.load_points(spark.createDataFrame(data, RAW), ext)
    assert kept.count() == 11
    assert {r.traj_id for r in pt.segment(kept).collect()} == {"b_2"}  # the hole of 800 s parts, and two points are too few


def test_linking(spark):
    events = spark.createDataFrame([("e1", "p9", "p1", "p2"), ("e2", None, "p9", "p2"), ("e3", "p3", None, "p9"), ("e4", None, None, None)], "event_uid string, closest_point_id string, first_point_id string, last_point_id string")
    points = spark.createDataFrame([("p1", 2, 1), ("p2", 5, 6), ("p3", None, None)], "point_id string, u long, v long")
    got = ev.link_events(events.select("*", *[F.lit("?").alias(c) for c in ("uv", "prio", "point_id", "u", "a")]), points).drop("uv", "prio", "point_id", "a")
    assert sorted((r.event_uid, r.u, r.v) for r in got.collect()) == [("e1", 2, 1), ("e2", 5, 6), ("e3", None, None), ("e4", None, None)]
    edges = spark.createDataFrame([(1, 2, 1, "b"), (1, 2, 0, "a"), (2, 1, 0, "c"), (None, 1, 0, "x")], "u long, v long, key int, edge_class string")
    named = {r.event_uid: r.edge_class for r in ev.join_edge_class(got, edges).collect()}
    assert named == {"e1": "a", "e2": None, "e3": None, "e4": None}
    assert [r.edge_class for r in ev.join_edge_class(got, None).collect()] == [None] * 4


def test_sessions_stream_and_batch_agree(spark, tmp_path):
    from velotrace.streaming import sessions

    data = [reading(i, s, "5" if i % 3 else "0") for i, s in enumerate([0, 1, 2, 3, 603, 1300, 1301, 1302, 1303, 1304, 9000])]
    spark.createDataFrame(data, RAW).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = sessions.trajectory_sessions(sessions.cleaned(spark.read.parquet(str(tmp_path / "in"))))
    stream = sessions.trajectory_sessions(sessions.cleaned(spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = [("b", 5), ("b", 5)]
    assert [(r.boxId, r.n_points) for r in batch.collect()] == want
    assert [(r.boxId, r.n_points) for r in spark.sql("SELECT * FROM sessions").collect()] == want
    assert math.isclose(us(0), us(0))


@pytest.mark.parametrize("gap", [1, 10])
def test_one_hot_box_is_cut_by_time(spark, gap):
    data = [reading(i, 30 * i, "4") for i in range(400)]
    t = tours(spark, data, gap_minutes=gap)
    assert t.cells.count() >= 20 and t.cells.select("traj_id").distinct().count() == 1
    assert t.cells.agg(F.sum("n")).first()[0] == 400
    assert ql.longest_runs(t).first().longest_nonzero_run == 400


def test_events_without_uid_are_kept_and_linked(spark, tmp_path):
    rows = [("e1", "p1", None, None), ("e1", "p1", None, None), (None, "p1", None, None), (None, "p1", None, None), (None, "zz", "p2", None), (None, None, None, None)]
    spark.createDataFrame(rows, "event_uid string, closest_point_id string, first_point_id string, last_point_id string").write.parquet(f"{tmp_path}/overtake_events.parquet")
    spark.createDataFrame([("p1", 1, 2), ("p2", 3, 4)], "point_id string, u long, v long").write.parquet(f"{tmp_path}/matched_points.parquet")
    got = sorted(((r.event_uid or "", r.u or 0, r.v or 0) for r in core.link_events(spark, str(tmp_path)).collect()))
    assert got == [("", 0, 0), ("", 1, 2), ("", 3, 4), ("e1", 1, 2)]
    share = core.linked_share(spark, str(tmp_path)).first()
    assert (share.n_events, share.n_linked) == (4, 3)
