"""Registries in one pass, polygons against rectangles, triangles."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from subgrade.operators import polygons
from subgrade.sources import gml

REGISTRY = """<?xml version="1.0" encoding="UTF-8"?>
<ler:Reg xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:ler="urn:ler"><gml:boundedBy><gml:null/></gml:boundedBy>
<gml:featureMember><ler:Graveforesp gml:id="g1"><ler:navn>A &amp; B</ler:navn><ler:geometri><gml:Polygon srsDimension="2"><gml:exterior><gml:LinearRing>
<gml:posList>0 0 10 0 10 10 0 10 0 0</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>2 2 2 4 4 4 4 2 2 2</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></ler:geometri></ler:Graveforesp></gml:featureMember>
<gml:featureMember><ler:Graveforesp gml:id="g2"><ler:geometri><gml:MultiSurface srsDimension="2"><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:pos>20 0</gml:pos><gml:pos>21 0</gml:pos><gml:pos>20 1</gml:pos><gml:pos>20 0</gml:pos></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>
<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>30 0 31 0 30 1 30 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></ler:geometri></ler:Graveforesp></gml:featureMember>
<gml:featureMember><ler:Vandledning gml:id="v1"><ler:status><ler:kode>i drift</ler:kode></ler:status><ler:geometri><gml:Curve srsDimension="3"><gml:segments><gml:LineStringSegment><gml:posList>0 0 -99 1 0 2</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve></ler:geometri></ler:Vandledning></gml:featureMember>
<gml:featureMember><ler:Vandledning><ler:tom></ler:tom></ler:Vandledning></gml:featureMember>
<gml:featureMember><ler:Gaskomponent gml:id="k1"><ler:geometri><gml:Point srsDimension="2"><gml:pos>5 6</gml:pos></gml:Point></ler:geometri></ler:Gaskomponent></gml:featureMember>
</ler:Reg>
"""


@pytest.fixture
def registry(spark, tmp_path):
    (tmp_path / "r.gml").write_text(REGISTRY)
    return gml.read_features(spark, str(tmp_path / "r.gml"), ["Graveforesp", "Vandledning", "Gaskomponent", "Olieledning"])


def test_all_layers_from_one_scan(spark, registry):
    plan = registry._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1
    rows = {r.feature_id: r for r in registry.collect()}
    assert len(rows) == 5
    g1, g2, v1, k1 = (rows[i] for i in ("g1", "g2", "v1", "k1"))
    assert (g1.geom_type, g1.roles, g1.polygons, g1.attrs) == ("Polygon", ["exterior", "interior"], [0, 0], {"navn": "A & B"})
    assert (g2.geom_type, g2.roles, g2.polygons) == ("MultiSurface", ["exterior", "exterior"], [0, 1])
    assert [tuple(v) for v in v1.parts[0]] == [(0.0, 0.0, -99.0), (1.0, 0.0, 2.0)] and v1.attrs == {"status": "i drift"}
    assert [tuple(v) for v in k1.parts[0]] == [(5.0, 6.0, 0.0)] and k1.roles == ["point"]
    bare = next(r for r in rows.values() if r.parts is None)
    assert bare.layer == "Vandledning" and bare.attrs == {} and bare.geom_type is None


def test_dig_polygon_is_the_first(spark, registry):
    assert gml.dig_polygon(registry) == [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    with pytest.raises(LookupError):
        gml.dig_polygon(registry, "Vandledning")


def test_small_splits_keep_every_member(spark, tmp_path):
    many = REGISTRY.replace("</ler:Reg>", "".join(f'<gml:featureMember><ler:Olieledning gml:id="o{i}"><ler:geometri><gml:LineString><gml:posList>{i} 0 0 {i} 1 1</gml:posList></gml:LineString></ler:geometri></ler:Olieledning></gml:featureMember>\n' for i in range(300)) + "</ler:Reg>")
    (tmp_path / "m.gml").write_text(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = gml.read_features(spark, str(tmp_path / "m.gml"), ["Olieledning"])
        assert got.rdd.getNumPartitions() > 5 and sorted(int(r.feature_id[1:]) for r in got.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("rect,met", [
    ((1, 1, 3, 3), {"g1"}), ((2.5, 2.5, 3.5, 3.5), set()), ((2, 2, 4, 4), {"g1"}), ((-5, -5, 50, 50), {"g1", "g2", "v1", "k1"}), ((5, 5, 5.5, 6), {"g1", "k1"}),
    ((20.6, 0.6, 22, 2), set()), ((10, 10, 12, 12), {"g1"}), ((10.1, 10.1, 12, 12), set()), ((30.1, 0.1, 30.2, 0.2), {"g2"}), ((0.2, -1, 0.4, 0.5), {"g1", "v1"}),
])
def test_what_meets_a_rectangle(spark, registry, rect, met):
    found = registry.filter(polygons.meets_rect(*[F.lit(float(v)) for v in rect]))
    assert {r.feature_id for r in found.collect()} == met


def test_other_types_are_skipped_and_counted(spark, registry):
    assert {r.feature_id for r in polygons.of_kind(registry, "polygon", "point").collect()} == {"g1", "g2", "k1"}
    assert {(r.layer, r.geom_type, r.n) for r in polygons.skipped(registry, "polygon", "point").collect()} == {("Vandledning", "Curve", 1), ("Vandledning", None, 1)}


def shoelace(ring):
    x, y = np.array(ring).T
    return abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def star(r, cx, cy, low, high, n):
    angles = sorted(r.random() * 2 * math.pi for _ in range(n))
    return np.array([(cx + (d := r.uniform(low, high)) * math.cos(a), cy + d * math.sin(a)) for a in angles])


def test_triangles_fill_random_polygons_with_holes():
    r = random.Random(7)
    for _ in range(200):
        # corners all around, so that the middle is inside
        angles = [i * 2 * math.pi / 12 + r.random() * 0.4 for i in range(12)]
        outer = np.array([((d := r.uniform(5, 10)) * math.cos(a), d * math.sin(a)) for a in angles])
        holes = [star(r, x, y, 0.3, 0.9, 7) for x, y in ((-1.5, 0.0), (1.5, 0.2), (0.0, 2.2))[: r.randrange(4)]]
        holes = [h for h in holes if len(h) > 2]
        found = polygons.triangles_of([outer, *holes])
        total = sum(shoelace(t) for t in found)
        assert abs(total - (shoelace(outer) - sum(shoelace(h) for h in holes))) < 1e-9
        assert len(found) <= len(outer) + sum(map(len, holes)) + 2 * len(holes) - 2


@pytest.mark.parametrize(("x", "y", "a", "holed"), [(1.8, 1.2, 1.1, False), (0.2, 0.6, 0.5, False), (1.2, 1.7, 1.0, True), (0.6, 0.2, 0.6, True)])
def test_corners_on_a_line_up_to_rounding(x, y, a, holed):
    at = lambda *xy: np.array([(x + a * i, y + a * j) for i, j in xy])
    outer = at((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0))
    hole = at((0.25, 0.25), (0.25, 0.5), (0.5, 0.5), (0.5, 0.25), (0.25, 0.25))
    t = polygons.triangles_of([outer, hole] if holed else [outer])
    assert np.abs(polygons._cross(t[:, 0], t[:, 1], t[:, 2])).sum() / 2 == pytest.approx(3 * a * a - (a * a / 16 if holed else 0))
    assert len({tuple(p) for p in t.reshape(-1, 2)}) == (10 if holed else 6)


def test_degenerate_rings_have_no_triangles():
    assert len(polygons.triangles_of([np.array([(0, 0), (1, 1)], float)])) == 0
    assert len(polygons.triangles_of([np.array([(0, 0), (1, 1), (2, 2), (0, 0)], float)])) == 0
    assert len(polygons.triangles_of([np.array([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)], float)])) >= 2


def test_triangulated_table(spark, registry):
    corners = polygons.triangulated(registry, "feature_id").collect()
    each = {}
    for c in corners:
        each.setdefault((c.feature_id, c.polygon, c.triangle), {})[c.corner] = (c.x, c.y)
    areas = {}
    for (f, p, _), t in each.items():
        areas[f, p] = areas.get((f, p), 0) + shoelace([t[i] for i in range(3)])
    assert {k: round(v, 9) for k, v in areas.items()} == {("g1", 0): 96.0, ("g2", 0): 0.5, ("g2", 1): 0.5}
