"""A folder opened as a site, runs of labels and selections, overview depths, and buffer counts."""

import json
from math import isclose

import numpy as np
import pytest
from pyspark.sql import functions as F

from subgrade import tables
from subgrade.operators import accuracy, depth, opened, runs
from subgrade.sources import discovery
from tests.test_polygons import REGISTRY

CLOUD = "ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty int class\nend_header\n"


@pytest.fixture
def folder(tmp_path):
    """Water_Area_5 with a cloud, its areas, a registry, and runs of instances."""
    at = tmp_path / "Water_Area_5"
    (at / "Site_37_Instances/20250101_000000").mkdir(parents=True)
    (at / "Site_37_Instances/20250102_000000").mkdir()
    points = [(i % 10, i // 10, 1 + i / 100, i % 3) for i in range(100)]
    (at / "Area_5_Site_37.ply").write_text(CLOUD.format(n=100) + "".join(f"{x} {y} {z} {c}\n" for x, y, z, c in points))
    one = CLOUD.format(n=1) + "0 0 0 1\n"
    for run, names in (("20250101_000000", ["1_instance_0.ply"]), ("20250102_000000", ["1_instance_0.ply", "1_instance_1.ply"])):
        for n in names:
            (at / "Site_37_Instances" / run / n).write_text(one)
    areas = [{"type": "Feature", "properties": {"name": "Area5"}, "geometry": {"type": "Point", "coordinates": [100.0, 200.0, 3.0]}}]
    (tmp_path / "areas.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": areas}))
    moved = REGISTRY.replace("0 0 -99 1 0 2", "101 201 -99 103 202 5").replace("<gml:pos>5 6</gml:pos>", "<gml:pos>105 206</gml:pos>")
    (tmp_path / "r.gml").write_text(moved)
    return tmp_path


def paths(folder):
    return {"cloud": str(folder / "Water_Area_5/Area_5_Site_37.ply"), "areas": str(folder / "areas.geojson"), "registry": str(folder / "r.gml")}


def test_a_folder_end_to_end(spark, folder):
    site = opened.open_site(spark, **paths(folder))
    assert (site.area, site.offset, site.crop_radius) == ("Area5", (100.0, 200.0, 3.0), 0.0)
    assert isclose(site.centre[0], 104.5) and isclose(site.centre[1], 204.5)
    assert site.session.points.count() == 100
    assert site.session.box == (-2.0, -2.0, 11.0, 11.0)
    segs = site.session.segments().collect()
    assert [(r.x1, r.y1, r.z1, r.x2, r.y2, r.z2) for r in segs] == [(1.0, 1.0, -99.0, 3.0, 2.0, 2.0)]
    assert [r.feature_id for r in site.session.features_near().collect()] == ["v1"]
    assert [(r.comp_id, r.x, r.y, r.z) for r in site.session.components_near().collect()] == [("k1", 5.0, 6.0, -3.0)]
    assert sorted(r.path.rsplit("/", 2)[-2:] for r in site.instances.collect()) == [["20250102_000000", "1_instance_0.ply"], ["20250102_000000", "1_instance_1.ply"]]


def test_settings_of_the_session_and_a_round_crop(spark, folder):
    for k, v in paths(folder).items():
        spark.conf.set(opened.PREFIX + k, v)
    spark.conf.set(opened.PREFIX + "crop_mode", "circle")
    try:
        site = opened.open_site(spark, with_registry=False, with_instances=False, crop_radius=1.0)
        assert sorted((r.x, r.y) for r in site.session.points.collect()) == [(4.0, 4.0), (4.0, 5.0), (5.0, 4.0), (5.0, 5.0)]
        assert site.session.features.count() == 0 and site.instances is None and site.crop_radius == 1.0
    finally:
        for k in (*paths(folder), "crop_mode"):
            spark.conf.unset(opened.PREFIX + k)


def test_errors_are_told(spark, folder):
    given = paths(folder)
    with pytest.raises(FileNotFoundError, match="areas = .*none.*, registry"):
        opened.open_site(spark, **given | {"areas": str(folder / "none"), "registry": ""})
    with pytest.raises(ValueError, match="crop_mode"):
        opened.open_site(spark, **given, crop_mode="square")
    (folder / "plain").mkdir()
    (folder / "plain/cloud.ply").write_text(CLOUD.format(n=0))
    with pytest.raises(ValueError, match="no area"):
        opened.open_site(spark, **given | {"cloud": str(folder / "plain/cloud.ply")})
    (folder / "plain/Area_6.ply").write_text(CLOUD.format(n=0))
    with pytest.raises(LookupError, match="Area6"):
        opened.open_site(spark, **given | {"cloud": str(folder / "plain/Area_6.ply")})


def test_older_instance_folders(spark, tmp_path):
    at = tmp_path / "Water_Area_1"
    for name in ("Site_1_instances_2023", "Area_1_Site_1_instances_2024", "Area_1_Site_1_instances_2024/labeled", "Site_10_instances_2025"):
        (at / name).mkdir(parents=True)
        (at / name / "a.ply").write_text("x")
    (at / "Area_1_Site_1.ply").write_text("x")
    own = lambda: [r.path.rsplit("/", 2)[1:] for r in discovery.instances_of(discovery.list_files(spark, str(at)), f"file:{at}/Area_1_Site_1.ply").collect()]
    # the last name of both spellings; and of the other folder, once it is the last, the labelled files
    assert own() == [["Site_1_instances_2023", "a.ply"]]
    (at / "Site_1_instances_2023/a.ply").unlink()
    (at / "Site_1_instances_2023").rmdir()
    assert own() == [["labeled", "a.ply"]]
    files = discovery.list_files(spark, str(at))
    with pytest.raises(LookupError):
        discovery.instances_of(files, f"file:{at}/Area_1_Site_2.ply")


def test_runs_are_appended_and_the_last_counts(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    rows = lambda *x: spark.createDataFrame(list(x), "site_id int, instance int, label string")
    runs.assign_labels(store, rows((1, 0, "WaterLine"), (1, 1, "GasLine")), "2025")
    runs.assign_labels(store, rows((1, 1, "PowerLine")), "2026")
    with pytest.raises(FileExistsError):
        runs.assign_labels(store, rows((1, 1, "OtherLine")), "2026")
    with pytest.raises(ValueError):
        runs.assign_labels(store, rows((1, 1, "OtherLine")), "../2027")
    instances = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "site_id int, instance int")
    got = {(r.site_id, r.instance): (r.label, r.utility_type, r.run) for r in runs.labelled(instances, store).collect()}
    assert got == {(1, 0): ("WaterLine", 7, "2025"), (1, 1): ("PowerLine", 1, "2026"), (2, 0): (None, 0, None)}
    assert store.all("labels").count() == 3
    features = spark.createDataFrame([("a",), ("b",), ("a",)], "feature_id string")
    runs.select_features(store, features, "wet", "1")
    runs.select_features(store, features.filter("feature_id = 'b'"), "wet", "2")
    runs.select_features(store, features, "dry", "3")
    assert [r.feature_id for r in runs.selected(store, "wet").collect()] == ["b"]
    assert runs.selected(store, "none").count() == 0


def test_overview_depths(spark):
    rows = [("f", 0, v, 1.0, 1.0, z, mm) for v, z, mm in ((0, -99.0, 1500.0), (1, -98.5, 0.0), (2, 4.0, None), (3, 90.0, None))]
    rows += [("g", 0, 0, 1.0, 1.0, -99.0, None), ("h", 0, 0, 9.0, 9.0, -99.0, None)]
    vertices = spark.createDataFrame(rows, "feature_id string, part_idx int, vid int, x double, y double, z double, indicative_mm double")
    samples = spark.createDataFrame([(1, 1.0, 1.0, 6.0), (2, 9.0, 9.0, 8.0)], "pid long, x double, y double, z double")
    found = depth.resolve_overview(vertices, samples, None, 5.0, (0.0, 10.0), ["feature_id", "part_idx"], ["feature_id", "part_idx", "vid"])
    got = {(r.feature_id, r.vid): (round(r.z, 6), r.depth_source) for r in found.collect()}
    # an indicative depth under the ground; the mean, held to the span; a registered height held too; the ground
    assert got == {("f", 0): (4.5, 2), ("f", 1): (12.0, 3), ("f", 2): (4.0, 1), ("f", 3): (12.0, 1), ("g", 0): (6.0, 5), ("h", 0): (8.0, 5)}
    assert found.columns == [*vertices.columns, "depth_source"]
    flat = depth.resolve_overview(vertices, samples.filter("false"), (0.1, 0.0, 3.0), 5.0, (0.0, 10.0), ["feature_id", "part_idx"], ["feature_id", "part_idx", "vid"])
    assert round(next(r.z for r in flat.collect() if r.feature_id == "h"), 6) == 3.9


@pytest.mark.parametrize("block", [2048, 3])
def test_buffer_counts_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(accuracy, "BLOCK_POINTS", block)
    r = np.random.default_rng(4)
    points = [(i, *map(float, r.random(2) * 30 - 10)) for i in range(200)]
    parts = [(f"f{i % 9}", i, *map(float, r.random(4) * 30 - 10), [0.5, 2.0, 1.0, 0.0, None][i % 5]) for i in range(70)] + [("point", 900, 1.0, 1.0, 1.0, 1.0, 3.0)]
    segs = spark.createDataFrame(parts, "feature_id string, seg_id long, x1 double, y1 double, x2 double, y2 double, half_width double")
    wanted = {}
    for f, _, *e, w in parts:
        a, d = np.array(e[:2]), np.array(e[2:]) - np.array(e[:2])
        for pid, *p in points:
            t = min(max(((np.array(p) - a) @ d) / (d @ d), 0), 1) if d @ d > 1e-12 else 0
            dist = float(np.hypot(*(np.array(p) - a - t * d)))
            if w and dist <= w:
                wanted.setdefault(f, {}).setdefault(pid, []).append(dist)
    got = {x.feature_id: (x.n_points, round(x.nearest, 9)) for x in accuracy.buffer_counts(spark.createDataFrame(points, "pid long, x double, y double"), segs).collect()}
    assert got == {f: (len(v), round(min(min(d) for d in v.values()), 9)) for f, v in wanted.items()}
    none = segs.filter("half_width < 0")
    assert accuracy.buffer_counts(spark.createDataFrame(points, "pid long, x double, y double"), none).count() == 0


@pytest.mark.parametrize("nearest", [True, False])
def test_buffers_of_many_parts_over_few_places(spark, monkeypatch, nearest):
    for name, value in {"BLOCK_POINTS": 64, "TASK_PARTS": 20, "MANY_PARTS": 30, "MEETING": 7}.items():
        monkeypatch.setattr(accuracy, name, value)
    kept = {}
    monkeypatch.setattr(accuracy, "written", lambda df, name: kept.setdefault(name, tables.written(df, name)))
    r = np.random.default_rng(6)
    places = r.random((120, 2)) * 20
    points = [(i, *map(float, places[i % 120])) for i in range(6000)] + [(6000, None, 1.0)]
    parts = [(["all", None, "few"][min(i % 20, 2) if i % 20 < 3 else 0], *map(float, r.random(2) * 20), *map(float, r.random(2) * 20), [0.1, 0.3][i % 2]) for i in range(120)]
    segs = spark.createDataFrame(parts, "feature_id string, x1 double, y1 double, x2 double, y2 double, half_width double")
    wanted = {}
    for f, *e, w in parts:
        a, d = np.array(e[:2]), np.array(e[2:]) - np.array(e[:2])
        t = np.clip((places - a) @ d / (d @ d), 0, 1)
        dist = np.hypot(*(places - a - t[:, None] * d).T)
        wanted.setdefault(f, []).append(np.where(dist <= w, dist, np.inf))
    least = {f: np.min(v, axis=0) for f, v in wanted.items()}
    got = {x.feature_id: (x.n_points, x.nearest and round(x.nearest, 9)) for x in accuracy.buffer_counts(spark.createDataFrame(points, "pid long, x double, y double"), segs, nearest=nearest).collect()}
    assert got == {f: (50 * int(np.isfinite(v).sum()), round(float(v.min()), 9) if nearest else None) for f, v in least.items() if np.isfinite(v).any()}
    # 6000 points at 120 places are two blocks of 64, and only these travel
    assert kept["buffer-blocks"].count() == 2
    assert kept["buffer-counts"].filter("name = 'all' AND bits IS NOT NULL").count() > 2
