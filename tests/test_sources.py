"""Sources and sinks: files written by hand, and round trips."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from subgrade.operators import segments as G, shapes
from subgrade.sinks import clouds
from subgrade.sources import discovery, ply, vector

ASCII = """ply
format ascii 1.0
element vertex 5
property float x
property float y
property float z
property uchar red
property uchar green
property uchar blue
property int class
end_header
0 0 1 10 20 30 0
1 0 2 10 20 30 1
2 0 3 10 20 30 1
3 0 4 10 20 30 2
4 0 5 10 20 30 9
"""
GML = """<?xml version="1.0"?><c xmlns:gml="http://www.opengis.net/gml" xmlns:l="urn:l">
<m><l:Vandledning gml:id="v1"><l:driftsstatus>i drift</l:driftsstatus><l:udvendigDiameter>200</l:udvendigDiameter><l:geometri><gml:LineString srsDimension="3"><gml:posList>0 0 -99 1 0 2 2 0 4</gml:posList></gml:LineString></l:geometri></l:Vandledning></m>
<m><l:Vandledning gml:id="v2"><l:driftsstatus>Ude af drift</l:driftsstatus></l:Vandledning></m>
<m><l:Gaskomponent gml:id="k1"><l:geometri><gml:Point srsDimension="2"><gml:pos>5 6</gml:pos></gml:Point></l:geometri></l:Gaskomponent></m>
</c>"""


def test_ascii_and_stride(spark, tmp_path):
    (tmp_path / "a.ply").write_text(ASCII)
    rows = ply.read_ply(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r.x, r.z, r.red, r["class"], r.utility_type, r.n_total) for r in rows][:2] == [(0.0, 1.0, 10, 0, None, 5), (1.0, 2.0, 10, 1, None, 5)]
    assert [r.point_id for r in ply.read_ply(spark, str(tmp_path), 2).orderBy("point_id").collect()] == [0, 2, 4]
    assert {r.utility_type for r in ply.with_utility_type(ply.read_ply(spark, str(tmp_path))).collect()} == {0}


@pytest.mark.parametrize("order,kind", [("<", "binary_little_endian"), (">", "binary_big_endian")])
def test_binary_of_either_order(spark, tmp_path, order, kind):
    head = f"ply\nformat {kind} 1.0\nelement vertex 3\nproperty double x\nproperty double y\nproperty double z\nproperty int utility_type\nend_header\n"
    body = b"".join(struct.pack(order + "dddi", i, i / 2, -i, 7) for i in range(3))
    (tmp_path / "b.ply").write_bytes(head.encode() + body)
    rows = ply.read_ply(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z, r.utility_type, r.red) for r in rows] == [(0.0, 0.0, 0.0, 7, None), (1.0, 0.5, -1.0, 7, None), (2.0, 1.0, -2.0, 7, None)]


def test_empty_cloud(spark, tmp_path):
    (tmp_path / "c.ply").write_text(ASCII.replace("vertex 5", "vertex 0").split("end_header")[0] + "end_header\n")
    assert ply.read_ply(spark, str(tmp_path)).count() == 0


def test_ply_round_trip(spark, tmp_path):
    (tmp_path / "a.ply").write_text(ASCII)
    pts = ply.read_ply(spark, str(tmp_path / "a.ply"))
    clouds.write_ply(pts, str(tmp_path / "out"), "class", ["x", "y", "z", "red", "green", "blue", "point_id"])
    text = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert sorted(text) == ["class=0", "class=1", "class=2", "class=9"]
    frame, n = ply.parse(text["class=1"].encode())
    assert n == 2 and frame["x"].tolist() == [1.0, 2.0]


def test_registry_layers(spark, tmp_path):
    (tmp_path / "r.gml").write_text(GML)
    feats = vector.read_layers(spark, str(tmp_path / "r.gml"), ["Vandledning", "Gasledning", "Gaskomponent"])
    rows = {(r.layer, r.geom_type): r for r in feats.collect()}
    line, point = rows["Vandledning", "LineString"], rows["Gaskomponent", "Point"]
    assert [tuple(v) for v in line.parts[0]] == [(0.0, 0.0, -99.0), (1.0, 0.0, 2.0), (2.0, 0.0, 4.0)]
    assert [tuple(v) for v in point.parts[0]] == [(5.0, 6.0, 0.0)]
    assert rows["Vandledning", None].parts is None
    derived = {(r.layer, r.geom_type): (r.radius, r.is_active) for r in G.derived(feats).collect()}
    assert derived["Vandledning", "LineString"] == (0.1, True) and derived["Vandledning", None] == (0.01, False)
    assert G.segments(G.vertices(G.derived(feats)), "layer", "feature_id", "part_idx").count() == 2


def test_areas_and_sidecars(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"name": "Area5"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0, 3.0]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    areas = vector.read_areas(spark, str(tmp_path / "a.geojson"))
    assert vector.area_offset(areas, "Area5") == (1.0, 2.0, 3.0)
    with pytest.raises(LookupError):
        vector.area_offset(areas, "Area6")
    (tmp_path / "g").mkdir()
    (tmp_path / "g/x_ground.json").write_text('{"ground_z": 1.5}')
    (tmp_path / "g/y_ground.json").write_text("{broken")
    got = {r.path[-13:]: (r.ground_z, r.method) for r in vector.read_ground(spark, str(tmp_path / "g")).collect()}
    assert got == {"x_ground.json": (1.5, "loaded from cache"), "y_ground.json": (None, "loaded from cache")}
    (tmp_path / "t.json").write_text(json.dumps({"vertices": [[0, 0, 0], [1, 0, 0], [1, 1, 0]], "mode": "hull"}))
    assert vector.read_trench(spark, str(tmp_path / "t.json")).first().mode == "hull"


def test_discovery(spark):
    names = [("a/S_Instances/20240101_1/p.ply", "20240101_1"), ("a/S_Instances/20240202_1/q.ply", "20240202_1"), ("a/S_Instances/labeled_2/r.ply", "labeled_2"), ("a/S_Instances/top.ply", "S_Instances")]
    files = spark.createDataFrame([(p, f, p.split("/")[-1]) for p, f in names], "path string, folder string, name string")
    assert [r.name for r in discovery.latest_run(files).collect()] == ["q.ply"]
    assert sorted(r.name for r in discovery.labelled_run(files).collect()) == ["r.ply", "top.ply"]
    sites = spark.createDataFrame([("x/Area_1/Area_1_Site_2.ply",), ("x/Area_10/Area_10_Site_2.ply",), ("x/Area_1/Area_1_Site_2_utm.ply",), ("x/Area_1_Finetuning/Area_1_Site_3.ply",)], "path string")
    sites = sites.select("path", F.lit("f").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"))
    assert [r.path for r in discovery.site_files(sites, 1).collect()] == ["x/Area_1/Area_1_Site_2.ply"]


def test_las_files(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1.0, 2.0, 3.0, 1, 5, 6, 7, 8), ("m", 1.5, 2.5, 3.5, 2, 6, 6, 7, 8)], "metric string, x double, y double, z double, classification int, intensity int, red int, green int, blue int")
    clouds.write_binary(clouds.las_files(rows, "metric"), str(tmp_path / "las"), "metric", ".las")
    raw = (tmp_path / "las/m.las").read_bytes()
    assert raw[:4] == b"LASF" and (raw[24], raw[25]) == (1, 4) and len(raw) == 375 + 2 * 26
    assert struct.unpack_from("<Q", raw, 247)[0] == 2
    x, y, z, intensity = struct.unpack_from("<iiiH", raw, 375 + 26)
    assert (x, y, z, intensity) == (500, 500, 500, 6)


def test_colour_table_and_sidecars_out(spark, tmp_path):
    clouds.write_colour_table(spark, str(tmp_path / "c"))
    lines = "".join(p.read_text() for p in (tmp_path / "c").glob("*.txt")).splitlines()
    assert lines[0] == "1,0,218,124,255,Class 1:  <= 250 mm" and len(lines) == 5
    clouds.write_sidecar(spark.createDataFrame([([[0.0, 0.0]],)], "vertices array<array<double>>"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 0


def test_shapes(spark):
    square = [(i, float(x), float(y), 0.0, "a") for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)])]
    pts = spark.createDataFrame(square, "pid long, x double, y double, z double, instance string")
    assert [tuple(v) for v in shapes.convex_hull(pts, "instance").first().ring] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    r = np.random.default_rng(0)
    long = spark.createDataFrame([(float(t), float(t), float(e), "b") for t, e in zip(r.random(200) * 10, r.normal(0, 0.01, 200))], "x double, y double, z double, instance string")
    size = shapes.oriented_boxes(long, "instance").first().extent
    assert size[0] == pytest.approx(10 * 2**0.5, rel=0.05) and size[1] < 0.1 and size[2] < 0.1
    one, two = pts.withColumn("class", F.lit(1)), pts.limit(2)
    both = shapes.joined_clouds({"s1": one, "s2": two})
    assert {(r.site_id, r["class"]): r.n for r in both.groupBy("site_id", "class").agg(F.count("*").alias("n")).collect()} == {("s1", 1): 6, ("s2", -1): 2}
    assert shapes.main_to_water(one.withColumn("class", F.when(F.col("pid") == 0, 0).otherwise(1))).select("utility_type").collect()[0][0] == 7
    labelled = spark.createDataFrame([(0, 3), (1, 0), (2, 5), (3, 0)], "idx int, utility_type int")
    assert [shapes.next_unlabelled(labelled, i) for i in (0, 1, 3)] == [1, 3, 1]
    seg = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.5)], "seg_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, half_width double")
    assert [tuple(c) for c in shapes.ribbon_corners(seg).first().corners] == [(0.0, -0.5, 0.0), (0.0, 0.5, 0.0), (2.0, 0.5, 0.0), (2.0, -0.5, 0.0)]
