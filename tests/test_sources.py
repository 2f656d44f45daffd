from __future__ import annotations

import sqlite3
import struct
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tests.helpers import LAT, LON, RAW, alike, at, reading
from velotrace.operators.points import load_points
from velotrace.sources import files
from velotrace.sources.geopackage import corners_of, read_gpkg, write_gpkg

GRAPH = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="node" attr.name="y" attr.type="string" />
  <key id="d1" for="node" attr.name="x" attr.type="string" />
  <key id="d2" for="edge" attr.name="highway" attr.type="string" />
  <key id="d3" for="edge" attr.name="length" attr.type="string" />
  <key id="d4" for="edge" attr.name="geometry" attr.type="string" />
  <graph edgedefault="directed">
    <node id="11"><data key="d0">20.5</data><data key="d1">10.5</data></node>
    <node id="12"><data key="d0">40</data><data key="d1">30</data></node>
    <edge source="11" target="12" id="0"><data key="d2">['path', 'footway']</data><data key="d3">28.1</data></edge>
    <edge source="12" target="11" id="1"><data key="d2">residential</data><data key="d4">LINESTRING (30 40, 20 30.5, 10.5 20.5)</data></edge>
  </graph>
</graphml>
"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH)
    nodes, edges = files.read_network(spark, str(tmp_path / "g.graphml"))
    assert sorted((r.node_id, r.x, r.y) for r in nodes.collect()) == [(11, 10.5, 20.5), (12, 30.0, 40.0)]
    got = {(r.u, r.v, r.key): r for r in edges.collect()}
    a, b = got[11, 12, 0], got[12, 11, 1]
    assert a.highway == ["path", "footway"] and a.length == 28.1 and a.cycleway is None
    assert [(p.x, p.y) for p in a.geometry] == [(10.5, 20.5), (30.0, 40.0)]
    assert b.highway == ["residential"] and [(p.x, p.y) for p in b.geometry] == [(30.0, 40.0), (20.0, 30.5), (10.5, 20.5)]


def test_network_stage_from_graphml(spark, tmp_path):
    from velotrace.operators import network as nw

    tagged = GRAPH.replace('<key id="d3"', '<key id="d5" for="edge" attr.name="is_sidepath" attr.type="string" /><key id="d3"').replace('<data key="d3">', '<data key="d5">yes</data><data key="d3">')
    (tmp_path / "g.graphml").write_text(tagged)
    _, edges = files.read_network(spark, str(tmp_path / "g.graphml"))
    got = nw.classify_edges(nw.flag_sidepaths(edges, near_m=-1.0, max_m=1.0, max_angle=-1.0))
    assert {(r.u, r.is_sidepath, r.edge_class) for r in got.collect()} == {(11, True, "roadside_track"), (12, False, "residential_street")}
    files.write_csv(got, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).where("highway = 'path;footway'").count() == 1


def test_graphml_in_degrees_is_projected(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH.replace("20.5", "51.9607").replace("10.5", "7.6261"))
    nodes, _ = files.read_network(spark, str(tmp_path / "g.graphml"), metric=False)
    r = nodes.where("node_id = 11").first()
    assert (round(r.x, 2), round(r.y, 2)) == (405600.61, 5757558.64)


def test_raw_csv(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("createdAt,lat,lon,boxId,value,extra\n2024-05-01T08:00:00Z,51.9,7.6,b,abc,1\n2024-05-01T10:00:00+02:00,51.9,7.6,b,12.5,2\n")
    df = files.read_raw_csv(spark, str(tmp_path / "raw.csv"))
    assert df.columns == [*files.RAW.names, "row_seq"]
    rows = df.collect()
    assert [r.value for r in sorted(rows, key=lambda r: r.row_seq)] == ["abc", "12.5"] and len({r.createdAt for r in rows}) == 1 and all(r.boxName is None for r in rows)
    (tmp_path / "bad.csv").write_text("createdAt,lat,lon,boxId,value\nyesterday,51.9,7.6,b,1\n")
    with pytest.raises(Exception, match="yesterday"):
        files.read_raw_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", ["x", "y"], True), (2, None, None, False)], "n_points long, boxId string, tags array<string>, keep boolean")
    files.write_csv(df, str(tmp_path / "c"))
    q = files.read_quality_csv(spark, str(tmp_path / "c"))
    assert q.columns == files.QUALITY.names and {r.boxId for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"b", None}
    assert {r.tags for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"x;y", None}
    files.write_table(df, str(tmp_path / "p"))
    files.write_jsonl(df, str(tmp_path / "j"))
    for back in (files.read_table(spark, str(tmp_path / "p"), df.schema), files.read_jsonl(spark, str(tmp_path / "j"), df.schema)):
        a, b = alike(back.withColumn("tags", F.to_json("tags")).toPandas(), df.withColumn("tags", F.to_json("tags")).toPandas())
        assert a == b


def test_rows_keep_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "long.csv").write_text("createdAt,lat,lon,boxId,value\n" + "".join(f"2024-05-01T08:00:00Z,51.9,7.6,b,{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        df = files.read_raw_csv(spark, str(tmp_path / "long.csv"))
        assert df.rdd.getNumPartitions() > 4
        rows = sorted(df.collect(), key=lambda r: r.row_seq)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == [str(i) for i in range(5000)] and len({r.row_seq for r in rows}) == 5000


def test_graphml_round_trip(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH.replace("residential", "resi&amp;&lt;dential"))
    nodes, edges = files.read_network(spark, str(tmp_path / "g.graphml"))
    files.write_graphml(nodes, edges, str(tmp_path / "out"))
    again = files.read_network(spark, str(tmp_path / "out"))
    for a, b in zip((nodes, edges), again, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert "resi&<dential" in str(again[1].collect())
    ElementTree.parse(next((tmp_path / "out").glob("part-*")))  # one well-formed document


def test_gpkg_round_trip(spark, tmp_path):
    schema = "u long, name string, on_time timestamp, ok boolean, tags array<string>, km double, geometry array<struct<x:double,y:double>>"
    rows = [(1, "a\"b", at(1.5), True, ["x", "y"], 0.5, [(1.0, 2.0), (3.0, 4.5)]), (2, None, None, None, None, None, None), (3, "", at(0), False, ["z"], float("nan"), [(1.0, 2.0)]), (4, "e", at(0), False, None, 1.0, [])]
    df = spark.createDataFrame(rows, schema)
    assert write_gpkg(df, str(tmp_path / "l"), "edges", files=2) == 4
    got = sorted(read_gpkg(spark, str(tmp_path / "l"), schema).collect())
    assert [(r.u, r.name, r.on_time, r.ok, r.tags) for r in got] == [(r.u, r.name, r.on_time, r.ok, r.tags) for r in sorted(df.collect())]
    assert [None if r.geometry is None else [tuple(p) for p in r.geometry] for r in got] == [rows[0][-1], None, rows[2][-1], None]
    assert write_gpkg(df.where("u < 3"), str(tmp_path / "l"), "edges", point=True, files=1) == 2  # takes the place of what was there
    assert [r.geometry and tuple(r.geometry[0]) for r in sorted(read_gpkg(spark, str(tmp_path / "l"), schema).collect())] == [(1.0, 2.0), None]
    db = sqlite3.connect(next((tmp_path / "l").glob("*.gpkg")))
    assert db.execute("PRAGMA application_id").fetchone() == (0x47504B47,) and db.execute("SELECT geometry_type_name, srs_id FROM gpkg_geometry_columns").fetchone() == ("POINT", 25832)
    assert db.execute("SELECT min_x, max_y FROM gpkg_contents").fetchone() == (1.0, 2.0)
    assert write_gpkg(df.limit(0), str(tmp_path / "e"), "edges", files=1) == 0 and read_gpkg(spark, str(tmp_path / "e"), schema).count() == 0


def test_gpkg_shapes_of_other_writers():
    head = b"GP\x00\x03" + struct.pack("<i4d", 25832, 0, 1, 0, 1)  # with an envelope
    multi = struct.pack("<BII", 1, 5, 2) + b"".join(struct.pack("<BII4d", 1, 2, 2, *p) for p in ((0, 0, 1, 1), (1, 1, 2, 0)))
    assert [tuple(p.values()) for p in corners_of(head + multi)] == [(0, 0), (1, 1), (1, 1), (2, 0)]
    assert [tuple(p.values()) for p in corners_of(b"GP\x00\x00" + struct.pack(">i", 0) + struct.pack(">BI3d", 0, 1001, 5, 6, 7))] == [(5, 6)]
    assert corners_of(b"GP\x00\x11" + bytes(4)) is None and corners_of(None) is None
    with pytest.raises(ValueError, match="kind 3"):
        corners_of(b"GP\x00\x01" + bytes(4) + struct.pack("<BII", 1, 3, 0))


def test_stages_from_files_to_regimes(spark, tmp_path):
    from velotrace.plans import stages

    x, y = 405177.0, 5757490.0
    corner = lambda i: (x + 200 * i, y)
    nodes = "".join(f'<node id="{i}"><data key="d1">{corner(i)[0]}</data><data key="d0">{corner(i)[1]}</data></node>' for i in range(4))
    ways = "".join(f'<edge source="{i}" target="{i + 1}" id="0"><data key="d2">residential</data><data key="d3">200</data></edge>' for i in range(3))
    head, rest = GRAPH.split('<graph edgedefault="directed">')
    (tmp_path / "g.graphml").write_text(head + '<graph edgedefault="directed">' + nodes + ways + "</graph></graphml>")
    p = load_points(spark.createDataFrame([reading(0, 0)], RAW)).first()
    lon = lambda m: LON + (x - p.x + m) / 68_700
    lat = LAT + (y - p.y) / 111_250
    (tmp_path / "raw.csv").write_text("createdAt,lat,lon,boxId,boxName,value\n" + "".join(f"{at(i).isoformat()},{lat},{lon(4.0 * i)},b,n,{120 if i in (30, 31, 90) else 0}\n" for i in range(140)) + f"{at(500).isoformat()},{lat},{lon(90_000)},b,n,99\n")
    graph, csv, out = str(tmp_path / "g.graphml"), str(tmp_path / "raw.csv"), str(tmp_path / "out")
    assert {r.edge_class for r in stages.run_network(spark, graph, out).collect()} == {"residential_street"}
    q = stages.run_diagnostics(spark, csv, graph, out)
    assert [(r.traj_id, r.keep, r.n_points) for r in q.collect()] == [("b_1", True, 140)]
    t = stages.run_trajectories(spark, csv, graph, out)
    assert t.points.count() == 140 and sorted((r.event_uid, r.n_samples) for r in t.events.collect()) == [("b_1_ev1", 2), ("b_1_ev2", 1)]
    m = stages.run_matching(spark, graph, out)
    assert sorted((r.event_uid, {r.u, r.v}, r.edge_class) for r in m.events.collect()) == [("b_1_ev1", {0, 1}, "residential_street"), ("b_1_ev2", {1, 2}, "residential_street")]
    assert m.points.where("u is not null").count() == 140 and stages.run_matching(spark, graph, out).events.count() == 2
