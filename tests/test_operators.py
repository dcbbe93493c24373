"""Operators on planted sites: known geometry and known offsets give known results."""

import tracemalloc
from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from subgrade.plans import sites
from tests.conftest import DATA
from subgrade.operators import accuracy, adhoc, cluster, depth, deviation, discretise, ground, match, nearest, packed, sections, segments as G, shapes, site
from subgrade.functions.geometry import near_polygon
from subgrade.streaming.instances import running_stats

SEGMENTS = "seg_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, hw double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_site(spark, seed=0, n=60, m=40):
    r = np.random.default_rng(seed)
    pts = [(i, *map(float, r.random(3) * 10), "a", i % 3) for i in range(n)]
    segs = [(i, *map(float, r.random(6) * 10), float(i % 4 == 0) * 0.3, bool(i % 2), i % 3) for i in range(m)]
    return frame(spark, pts, "pid long, x double, y double, z double, instance string, t int"), frame(spark, segs, SEGMENTS + ", is_active boolean, t int")


def plain_nearest(p, segs):
    """(distance, seg_id, xy, z) of the nearest of (seg_id, x1 .. z2, hw), the first of equals, by the definition."""
    best = (inf, None, inf, inf)
    for seg_id, *ends, hw in sorted(segs):
        a, d = np.array(ends[:3]), np.array(ends[3:]) - np.array(ends[:3])
        t = min(max(float((p - a) @ d / (d @ d)), 0.0), 1.0) if d @ d > 1e-12 else 0.0
        e, flat = p - (a + t * d), np.hypot(d[0], d[1])
        xy = np.hypot(e[0], e[1])
        if hw > 1e-9:
            xy = max((abs(-e[0] * d[1] + e[1] * d[0]) / flat if flat > 1e-12 else 0.0) - hw, 0.0)
        dist = float(np.sqrt(xy * xy + e[2] * e[2]))
        if dist < best[0] - 1e-12:
            best = (dist, seg_id, xy, abs(e[2]))
    return best


@pytest.mark.parametrize("settings", [{}, {"POINTS": 4, "PIECES": 3, "FAN": 1, "BEAM": 2, "PACKED": 50}, {"POINTS": 1, "PIECES": 1, "FAN": 2, "BEAM": 1}])
@pytest.mark.parametrize("by", [[], ["t"]])
def test_nearest_segment_against_all_pairs(spark, monkeypatch, settings, by):
    for name, value in settings.items():
        monkeypatch.setattr(packed, name, value)
    pts, segs = random_site(spark)
    # twins, a point, a vertical ribbon, and a point far below
    rows = [tuple(r) for r in segs.collect()]
    rows += [(100 + r[0], *r[1:]) for r in rows] + [(300, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 0.0, True, 0), (301, 9.0, 9.0, 2.0, 9.0, 9.0, 3.0, 0.2, True, 1)]
    segs = frame(spark, rows[::-1], SEGMENTS + ", is_active boolean, t int")
    points = [tuple(r) for r in pts.collect()] + [(900, 4.0, 4.0, -70.0, "a", 2)]
    found = nearest.nearest_segment(frame(spark, points, pts.schema), segs, by).collect()
    assert len(found) == len(points)
    for r in found:
        dist, seg_id, xy, z = plain_nearest(np.array([r.x, r.y, r.z]), [s[:8] for s in rows if not by or s[9] == r.t])
        assert r.seg_id == seg_id and abs(r.dist - dist) + abs(r.dist_xy - xy) + abs(r.dist_z - z) < 1e-9


def test_few_pairs_are_compared(spark):
    """At the size of the correctness tables, the search compares less than a tenth of all pairs."""
    at = DATA.parent / "sf0.01"
    at = str(at if at.exists() else DATA)
    points, segs = sites.points(spark, at), sites.segments(spark, at)
    assert nearest.comparisons(points, segs) < 0.1 * points.count() * segs.count()


def test_far_coordinates_and_far_points(spark):
    """Metres in the millions, and a cloud far beside its segments."""
    r = np.random.default_rng(5)
    shift = np.array([7.1e5, 6.2e6, 30.0])
    segs = [(i, *(shift + a), *(shift + a + r.normal(0, 2, 3)), 0.2 * (i % 5 == 0)) for i, a in enumerate(r.random((300, 3)) * 50)]
    pts = [(i, *(shift + p + (0 if i < 150 else 900.0))) for i, p in enumerate(r.random((300, 3)) * 50)]
    rows = nearest.nearest_segment(frame(spark, [tuple(map(lambda v: v.item() if hasattr(v, "item") else v, p)) for p in pts], "pid long, x double, y double, z double"),
        frame(spark, [tuple(map(lambda v: v.item() if hasattr(v, "item") else v, s)) for s in segs], SEGMENTS)).collect()
    for x in rows:
        dist, seg_id, _, _ = plain_nearest(np.array([x.x, x.y, x.z]), segs)
        assert abs(x.dist - dist) < 1e-6 and (x.seg_id == seg_id or dist > 0)


def test_points_without_a_segment_are_infinitely_far(spark):
    pts, segs = random_site(spark, n=5)
    none = segs.filter("false")
    assert [(r.dist, r.seg_id) for r in nearest.nearest_segment(pts, none).collect()] == [(inf, None)] * 5
    other = nearest.nearest_segment(pts, segs.filter("t = 1"), ["t"]).collect()
    assert {r.t for r in other if r.dist < inf} == {1} and len(other) == 5
    assert nearest.nearest_segment(pts.filter("false"), segs).count() == 0


def test_nearest_points_against_all_pairs(spark):
    r = np.random.default_rng(1)
    p, q = r.random((80, 3)) * 5, np.vstack([r.random((30, 3)) * 5, [[50.0, 50.0, 50.0]]])
    points = frame(spark, [(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    queries = frame(spark, [(i, *map(float, x)) for i, x in enumerate(q)], "qid long, x double, y double, z double")
    for flat, k in ((False, 1), (True, 8), (False, 100)):
        axes = 2 if flat else 3
        d2 = ((q[:, None, :axes] - p[None, :, :axes]) ** 2).sum(axis=2)
        wanted = {(i, n + 1): int(j) for i, row in enumerate(d2) for n, j in enumerate(np.argsort(row, kind="stable")[:k])}
        got = nearest.nearest_points(queries, points, k, 0.3, flat=flat).collect()
        assert {(g.qid, g.rank): g.pid for g in got} == wanted
    assert nearest.nearest_points(queries, points.filter("false"), 1, 0.3).count() == 0


def test_pick(spark):
    segs = frame(spark, [(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], SEGMENTS)
    comps = frame(spark, [(9, 0.5, 0.1, 0.0)], "comp_id long, x double, y double, z double")
    one = lambda hit: nearest.pick(hit, comps, segs).first()
    assert (one((0.5, 0.12, 0.0)).kind, one((0.5, -0.05, 0.0)).kind, one((0.5, 3.0, 0.0)).kind) == ("component", "segment", None)


def test_depth_fallbacks(spark):
    schema = "f int, vid int, z double, indicative_mm double"
    rows = [(1, 0, -99.0, 1500.0), (1, 1, 2.0, 1500.0), (1, 2, 4.0, 1500.0), (2, 0, -99.0, None), (2, 1, 2.0, None), (2, 2, 4.0, None), (3, 0, -99.0, None), (3, 1, -99.0, None)]
    got = depth.resolve(frame(spark, rows, schema), F.lit(0.0), ["f"]).orderBy("f", "vid").collect()
    assert [(r.z, r.depth_source) for r in got] == [(-1.5, 2), (2.0, 1), (4.0, 1), (3.0, 3), (2.0, 1), (4.0, 1), (0.0, 5), (0.0, 5)]
    counts = depth.source_counts(depth.resolve(frame(spark, rows, schema), F.lit(0.0), ["f"]), ["f"])
    assert {r.depth_source: r.n_segments for r in counts.collect()} == {1: 2, 2: 1, 3: 1, 5: 1}
    held = depth.resolve(frame(spark, rows, schema), F.lit(-50.0), ["f"], at_most=-98.0, held=(F.lit(-2.0), F.lit(2.0)))
    assert {r.z for r in held.collect()} == {-2.0, 2.0, 4.0}


def test_planted_offset(spark):
    segs = frame(spark, [(1, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0)], SEGMENTS)
    pts = frame(spark, [(i, i / 10, 0.3, 0.4, "pipe") for i in range(101)], "pid long, x double, y double, z double, instance string")
    found = nearest.nearest_segment(pts, segs)
    s = deviation.instance_stats(found).first()
    assert [round(v, 6) for v in (s["mean"], s["median"], s["std"], s["p95"], s["max"], s["min"])] == [0.5, 0.5, 0.0, 0.5, 0.5, 0.5] and s.n == 101
    rows = deviation.export_rows(found, F.lit(True), "dist_z", 100.0, 200.0, 5.0).orderBy("pid").collect()
    assert (rows[0].classification, rows[0].intensity, rows[0].x, round(rows[0].z, 6)) == (2, 400, 100.0, 5.4)


def test_majority_and_file_name(spark):
    pts = frame(spark, [("a", t) for t in (3, 2, 3, 2)] + [("b", 0)], "instance string, utility_type int")
    rows = deviation.majority_type(pts, name_type=F.lit(7)).collect()
    assert {r.instance: r.utility_type for r in rows} == {"a": 2, "b": 7}


def test_samples_of_a_ribbon_and_a_tube(spark):
    schema = "seg_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, radius double, half_width double"
    rows = [(1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.01, 0.02), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5, 0.0), (3, 0.0, 0.0, 0.0, 1e-9, 0.0, 0.0, 0.1, 0.0)]
    got = discretise.discretise(frame(spark, rows, schema)).toPandas()
    ribbon, tube = got[got.seg_id == 1], got[got.seg_id == 2]
    assert len(ribbon) == (int(np.ceil(0.1 / 0.02)) + 1) * (int(np.ceil(0.04 / 0.02)) + 1)
    assert ribbon.y.abs().max() == pytest.approx(0.02) and (got.seg_id == 3).sum() == 0
    assert np.hypot(tube.x, tube.y).min() == pytest.approx(0.5) and np.hypot(tube.x, tube.y).max() == pytest.approx(0.5)


def test_plane_and_inverse_distance(spark):
    r = np.random.default_rng(4)
    xy = r.random((300, 2)) * 10
    z = 0.2 * xy[:, 0] - 0.1 * xy[:, 1] + 3
    z[:5] += 40
    pts = frame(spark, [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, z))], "pid long, x double, y double, z double")
    assert ground.fit_plane(pts) == pytest.approx((0.2, -0.1, 3.0), abs=1e-6)
    assert ground.fit_plane(pts.limit(2)) is None
    samples = frame(spark, [(0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 3.0)], "pid long, x double, y double, z double")
    at = frame(spark, [(0, 1.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)], "qid long, x double, y double, z double")
    assert {g.qid: g.ground_z for g in ground.idw(at, samples).collect()} == {0: 2.0, 1: 3.0}
    assert ground.ground_level(pts, pts.filter("pid < 0")).first().ground_z == pytest.approx(np.quantile(z, 0.95))


def test_density_finds_two_clouds_and_noise():
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(0, 0.05, (150, 3)), r.normal(3, 0.05, (120, 3)), [[50.0, 0, 0]]])
    labels = cluster.density_labels(x, 50, 5)
    assert labels[-1] == -1 and {labels[0], labels[200]} == {0, 1}
    assert (labels[:150] == labels[0]).mean() > 0.9 and (labels[150:270] == labels[200]).mean() > 0.9
    assert (cluster.density_labels(x[:3], 50, 5) == -1).all()


def test_density_holds_few_distances_at_a_time():
    x = np.random.default_rng(8).random((4000, 3))
    tracemalloc.start()
    core = cluster._core_distances(x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for i in (0, 1777, 3999):
        assert core[i] == np.sort(np.sqrt(((x - x[i]) ** 2).sum(axis=1)))[4]


def test_labels_are_those_of_the_nearest_voxel_point(spark):
    r = np.random.default_rng(9)
    cells = [(i, i % 2, *map(float, r.random(3) * 3), i % 7 - 1) for i in range(60)] + [(60, 0, 1.0, 1.0, 90.0, 5), (61, 0, 1.0, 1.0, 90.0, 6)]
    pts = [(i, i % 3, *map(float, r.random(3) * 3)) for i in range(300)] + [(300, 0, 1.0, 1.0, 95.0)]
    labelled = frame(spark, cells, "pid long, site_id int, x double, y double, z double, label int")
    got = {row.pid: row.label for row in cluster.label_points(frame(spark, pts, "pid long, site_id int, x double, y double, z double"), labelled).collect()}
    near = {pid: min((sum((a - b) ** 2 for a, b in zip(at, c[2:5])), c[0], c[5]) for c in cells if c[1] == site)[2] for pid, site, *at in pts if site < 2}
    assert got == near and got[300] == 5


def test_parallel_pipes_are_split(spark):
    r = np.random.default_rng(6)
    rows = [(1, 4, i, float(r.random() * 5), float(y + r.normal(0, 0.003)), float(r.normal(0, 0.003))) for i, y in enumerate([0.0] * 250 + [0.4] * 250)]
    df = frame(spark, rows, "site_id int, label int, pid long, x double, y double, z double")
    got = cluster.split_parallel(df).toPandas().groupby("label").size()
    assert sorted(got) == [250, 250] and set(got.index) == {4, 5}


def plain_reach(x: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Clusters of points that have min_points within eps (themselves included), and what lies within eps of them."""
    n = len(x)
    labels = np.full(n, -1)
    near = [np.flatnonzero(((x - p) ** 2).sum(axis=1) <= eps * eps) for p in x]
    core = np.array([len(k) >= min_points for k in near], dtype=bool)
    label = 0
    for i in range(n):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], stack = label, [i]
        while stack:
            for j in near[stack.pop()]:
                if labels[j] < 0:
                    labels[j] = label
                    if core[j]:
                        stack.append(j)
        label += 1
    return labels


def plain_across(x: np.ndarray) -> np.ndarray:
    """The second and third principal component of points, which a pipe's axis is not part of."""
    centred = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov(centred.T))
    return centred @ vectors[:, ::-1][:, 1:]


@pytest.mark.parametrize("seed, gap", [(1, 0.25), (2, 0.1), (3, 0.06)])
def test_reach_clusters_are_those_of_all_pairs(spark, seed, gap):
    """Dense cells, sparse ones, and dense cells at about the distance that links them; two instances of one site and a
    point of its own, noise around them."""
    r = np.random.default_rng(seed)
    sets = [np.vstack([r.normal(0, 0.02, (300, 2)), r.normal([gap, 0], 0.02, (300, 2)), r.uniform(-0.3, 0.4, (150, 2)), [[-2, -2]]]) for _ in range(2)]
    rows = [(1, k, 1000 * k + i, *map(float, p)) for k, x in enumerate(sets) for i, p in enumerate(r.permutation(x))]
    df = frame(spark, rows, "site_id int, label int, pid long, u double, v double")
    got = sections.reach_clusters(df, 0.03, 10, ["site_id", "label"]).toPandas()
    assert got["pid"].is_unique
    for k in range(2):
        own = sorted((p[2], p[3], p[4]) for p in rows if p[1] == k)
        found = plain_reach(np.array([p[1:] for p in own]), 0.03, 10)
        of = got[got["label"] == k].set_index("pid")["cluster"]
        assert [of.get(p[0], -1) for p in own] == found.tolist()


def test_touching_dense_cells_are_told_exactly(spark):
    """Two rows of points, each dense, whose nearest points are just within or just beyond reach."""
    for apart, clusters in ((0.03 * (1 - 1e-6), 1), (0.03 * (1 + 1e-6), 2)):
        x = [(1, 0, i, i * 0.0001, 0.0) for i in range(100)] + [(1, 0, 100 + i, 0.0099 + apart + i * 0.0001, 0.0) for i in range(100)]
        got = sections.reach_clusters(frame(spark, x, "site_id int, label int, pid long, u double, v double"), 0.03, 20, ["site_id", "label"])
        assert got.select("cluster").distinct().count() == clusters
        assert got.count() == 200


def test_planes_across_are_those_of_the_axes(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, [5.0, 1.0, 0.2], (200, 3)) @ np.linalg.qr(r.normal(size=(3, 3)))[0] + 1000
    df = frame(spark, [(1, 0, i, *map(float, p)) for i, p in enumerate(x)], "site_id int, label int, pid long, x double, y double, z double")
    got = sections.across(df, ["site_id", "label"]).orderBy("pid").toPandas()[["u", "v"]].to_numpy()
    assert np.abs(np.abs(got) - np.abs(plain_across(x))).max() < 1e-6


def test_splits_leave_noise_small_instances_and_single_ones(spark):
    r = np.random.default_rng(9)
    def pipe(label, first, y, n):
        return [(1, label, first + i, float(r.random() * 5), float(y + r.normal(0, 0.003)), float(r.normal(0, 0.003))) for i in range(n)]
    rows = [*pipe(-1, 0, 0.0, 300), *pipe(-1, 300, 0.4, 300), *pipe(0, 1000, 0.0, 20), *pipe(1, 2000, 0.0, 300), *pipe(2, 3000, 0.0, 250), *pipe(2, 3250, 0.4, 240), *pipe(2, 3490, 0.8, 30)]
    df = frame(spark, rows, "site_id int, label int, pid long, x double, y double, z double")
    got = cluster.split_parallel(df).toPandas().set_index("pid")["label"]
    assert len(got) == len(rows)
    assert (got[got.index < 1000] == -1).all() and (got[(got.index >= 1000) & (got.index < 2000)] == 0).all() and (got[(got.index >= 2000) & (got.index < 3000)] == 1).all()
    assert [set(got[(got.index >= a) & (got.index < b)]) for a, b in ((3000, 3250), (3250, 3490), (3490, 3520))] == [{2}, {3}, {-1}]
    assert cluster.split_parallel(df.filter("false")).count() == 0


def test_matching_and_reference_points(spark):
    segs = frame(spark, [(1, "Vandledning", None, "Vandledning"), (2, "Ledningstrace", "El", "Ledningstrace (El)"), (3, "AndenLedning", None, "AndenLedning")], "seg_id long, layer string, supply string, storage_key string")
    types = frame(spark, [(7,), (1,), (99,)], "utility_type int")
    got = match.matched_segments(segs, types).collect()
    assert sorted((r.utility_type, r.seg_id) for r in got) == [(1, 2), (7, 1), (99, 1), (99, 2), (99, 3)]
    refs = match.reference_points(types.withColumn("pid", F.col("utility_type")), segs).collect()
    assert sorted((r.pid, r.storage_key) for r in refs) == [(1, "Ledningstrace (El)"), (7, "Vandledning")]


def test_buffers_and_drape(spark):
    segs = frame(spark, [(1, 0.0, 0.0, 0.0, 10.0, 0.0, 5.0, 0.0, "f", 0.5)], SEGMENTS + ", feature_id string, half_width double")
    pts = frame(spark, [(1, 4.0, 0.5), (2, 4.0, 0.6), (3, 10.3, 0.3)], "pid long, x double, y double")
    hits = {r.pid: round(r.distance, 6) for r in accuracy.buffer_hits(pts, segs.drop("hw")).collect()}
    assert hits == {1: 0.5, 3: round(0.18**0.5, 6)}
    assert {r.pid: r.draped_z for r in accuracy.drape(pts, segs.drop("feature_id", "half_width")).collect()} == {1: 2.0, 2: 2.0, 3: 5.0}
    assert {r.draped_z for r in accuracy.drape(pts, segs.filter("false")).collect()} == {0.0}


def test_views_of_layers(spark):
    feats = frame(spark, [("Gasledning", "1", "LineString", [], {"a": "x"}), ("Elledning", "2", "LineString", [], {"a": "y", "b": "z"})], G.FEATURE_SCHEMA)
    assert sorted(adhoc.open_views(feats, "v_")) == ["Elledning", "Gasledning"]
    assert adhoc.ask(spark, "SELECT count(*) AS n FROM v_Elledning").first().n == 1
    assert {(r.layer, r.attribute): list(r.samples) for r in adhoc.describe(feats).collect()}[("Elledning", "b")] == ["z"]


def test_stream_of_instances(spark, tmp_path):
    rows = frame(spark, [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0), ("2024-01-01 00:07:00", "b", 5.0)], "ts string, instance string, z double")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, instance string, z double").parquet(str(tmp_path / "in"))
    q = running_stats(stream).writeStream.outputMode("complete").format("memory").queryName("instances").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.instance, r.n, r.mean_z) for r in spark.sql("SELECT * FROM instances").collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_nearest_of_many_agrees_with_brute_force(spark):
    r = np.random.default_rng(3)
    wanted = [(i, *map(float, r.random(3) * 4), "ab"[i % 2]) for i in range(400)] + [(400, 1.0, 1.0, 1.0, "none")]
    # a crowd in one place, equal distances, and one far away
    near = [(i, *map(float, r.random(3) * 4), "ab"[i % 2]) for i in range(150)] + [(150 + i, 2.0, 2.0, 2.0, "a") for i in range(50)] + [(200, 90.0, 0.0, 0.0, "b")]
    queries = frame(spark, wanted, "k long, x double, y double, z double, t string")
    points = frame(spark, near, "pid long, x double, y double, z double, t string")
    got = {row.k: (row.dev, row.dev_xy, row.dev_z) for row in nearest.nearest_of_many(queries, points, ["t"], chunk=8).collect()}
    assert len(got) == 401 and all(np.isnan(v) for v in got[400])
    for k, x, y, z, t in wanted[:-1]:
        d, px, py, pz = min((float(np.sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2)), px, py, pz) for _, px, py, pz, u in near if u == t)
        assert got[k] == pytest.approx((d, np.hypot(x - px, y - py), abs(z - pz)), abs=1e-9)
    assert nearest.nearest_of_many(queries.filter("false"), points, ["t"]).count() == 0


def test_sample_deviation_agrees_with_brute_force(spark):
    cols = "layer string, supply string, storage_key string, seg_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, radius double, half_width double"
    segs = frame(spark, [
        ("Vandledning", None, "Vandledning", 1, 0.0, 0.0, 0.0, 1.0, 0.5, 0.2, 0.01, 0.0),
        ("Ledningstrace", "El", "Ledningstrace (El)", 2, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.01, 0.05), ("Olieledning", None, "Olieledning", 3, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.01, 0.0),
    ], cols)
    pts = [(i, i / 10, i % 3 / 3, 0.3, 7 if i % 2 else 1) for i in range(12)]
    points = frame(spark, pts, "pid long, x double, y double, z double, utility_type int")
    got = {r.seg_id: r for r in deviation.sample_deviation(segs, points).collect()}
    samples = discretise.discretise(segs.select("seg_id", "x1", "y1", "z1", "x2", "y2", "z2", "radius", "half_width")).toPandas()
    for seg, kind in ((1, 7), (2, 1)):
        own = samples[samples["seg_id"] == seg][["x", "y", "z"]].to_numpy()
        refs = np.array([p[1:4] for p in pts if p[4] == kind])
        apart = np.sqrt(((own[:, None] - refs[None]) ** 2).sum(2))
        at = refs[apart.argmin(1)]
        wanted = (apart.min(1), np.hypot(*(own - at)[:, :2].T), np.abs((own - at)[:, 2]))
        assert got[seg].n == len(own) > 100
        for name, d in zip(("dev", "dev_xy", "dev_z"), wanted):
            assert got[seg][f"mean_{name}"] == pytest.approx(d.mean(), abs=1e-6) and got[seg][f"max_{name}"] == pytest.approx(d.max(), abs=1e-6)
    assert np.isnan(got[3].mean_dev)


def test_ground_falls_back_to_the_plane_and_the_level(spark):
    queries = frame(spark, [(1, 2.0, 3.0, 0.0)], "qid long, x double, y double, z double")
    none = frame(spark, [], "pid long, x double, y double, z double")
    one = frame(spark, [(1, 5.0, 5.0, 7.0)], "pid long, x double, y double, z double")
    height = lambda samples, plane: ground.ground_at(queries, samples, plane, -1.0).first().ground_z
    assert (height(one, (1.0, 1.0, 0.0)), height(none, (1.0, 2.0, 0.5)), height(none, None)) == pytest.approx((7.0, 8.5, -1.0))
    told = ground.ground_scalars(none, one).first()
    assert (told.ground_z, told.n_samples, told.plane_rms) == (7.0, 0, None)
    tilted = frame(spark, [(i, float(i % 5), float(i // 5), 0.5 * (i % 5)) for i in range(25)], "pid long, x double, y double, z double")
    assert ground.ground_scalars(tilted, one).first().slope_pct == pytest.approx(50.0)


def test_components_that_are_no_points(spark):
    square = [("q", i, x, y, z) for i, (x, y, z) in enumerate([(0.0, 0.0, 4.0), (2.0, 0.0, 1.0), (2.0, 2.0, 1.0), (0.0, 2.0, 1.0), (0.0, 0.0, 4.0)])]
    rows = frame(spark, square + [("p", 0, 1.0, 2.0, None)], "id string, vid int, x double, y double, z double")
    got = {r.id: (r.x, r.y, r.z) for r in shapes.representative_points(rows, "id", F.col("id") == "q").collect()}
    assert got == {"q": (1.0, 1.0, 4.0), "p": (1.0, 2.0, 0.0)}


def test_site_session_and_filters(spark):
    pts = frame(spark, [(1, 0.0, 0.0, 0.0), (2, 4.0, 4.0, 0.0)], "pid long, x double, y double, z double")
    part = lambda *xy: [[{"x": x, "y": y, "z": 0.0} for x, y in xy]]
    lines = [("in", part((1.0, 1.0), (9.0, 9.0))), ("corner only", part((-9.0, 5.0), (5.0, 12.0))), ("edge", part((6.0, 0.0), (6.0, 1.0))), ("away", part((7.0, 0.0), (7.0, 1.0))), ("none", None)]
    feats = frame(spark, [("Gasledning", n, "LineString", p, {}) for n, p in lines], G.FEATURE_SCHEMA)
    comps = frame(spark, [(1, 5.0, 5.0), (2, 6.5, 0.0)], "comp_id long, x double, y double")
    session = site.SiteSession(spark, pts, feats, comps)
    assert session.box == (-2.0, -2.0, 6.0, 6.0)
    assert {r.feature_id for r in session.features_near().collect()} == {"in", "edge"}
    assert [r.comp_id for r in session.components_near().collect()] == [1]
    with pytest.raises(ValueError):
        site.SiteSession(spark, pts.filter("false"), feats, comps).box
    assert spark.range(1).select(site.box_near((0, 0, 1, 1), 2.0, 0.0, 3.0, 1.0).alias("a"), site.box_near((0, 0, 1, 1), 2.0, 0.0, 3.0, 1.0, 1.0).alias("b")).first() == (False, True)
    assert site.visible(feats, ["Elledning"]).count() == 0 and site.visible(feats, None).count() == 5
    segs = frame(spark, [("Gasledning", None, "Gasledning")], "layer string, supply string, storage_key string")
    things = frame(spark, [(4, "a"), (1, "b")], "utility_type int, instance string")
    shown = lambda chosen: {r.name for r in site.utility_filter(things, segs, chosen).collect() if r.is_visible}
    assert (shown(None), shown((4, "a")), shown((1, "b"))) == ({"a", "b", "Gasledning"}, {"a", "Gasledning"}, {"b"})


def test_near_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = frame(spark, [(2.0, 2.0), (5.9, 2.0), (6.1, 2.0), (5.5, 5.5), (5.4, 5.3)], "x double, y double")
    assert [r.near for r in rows.select(near_polygon(F.col("x"), F.col("y"), ring, 2.0).alias("near")).collect()] == [True, True, False, False, True]


def test_points_travel_once_whatever_the_segments(spark, monkeypatch):
    """Every step of the search holds each point once, where lines cross all over the points and others lie far below."""
    r = np.random.default_rng(8)
    pts = frame(spark, [(i, *map(float, p)) for i, p in enumerate(r.random((900, 3)) * (10, 10, -20))], "pid long, x double, y double, z double")
    segs = frame(spark, [(i, *map(float, e), 0.0) for i, e in enumerate(r.random((3000, 6)) * (10, 10, -5, 10, 10, -5))], SEGMENTS)
    held = {}
    keep = packed.written

    def noted(df, name):
        held[name] = keep(df, name)
        return held[name]

    monkeypatch.setattr(packed, "written", noted)
    found = nearest.nearest_segment(pts, segs).agg(F.count("seg_id")).first()[0]
    copies = {n: df.agg(F.sum(F.size("pids"))).first()[0] for n, df in held.items() if "pids" in df.columns}
    assert found == 900 and copies and set(copies.values()) == {900}, copies
