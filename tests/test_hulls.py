"""Hulls in space, against the definition: a corner is no mixture of the others, and no point lies outside."""

import numpy as np
import pytest

from subgrade.operators import discretise, hulls


def extremes(points, directions=3000, seed=0):
    """Points that are farthest in some direction: corners for sure."""
    d = np.random.default_rng(seed).normal(size=(directions, 3))
    return {tuple(points[i]) for i in (points @ d.T).argmax(axis=0)}


def holds(corners, points, directions=3000):
    d = np.random.default_rng(1).normal(size=(directions, 3))
    return ((points @ d.T).max(axis=0) <= (corners @ d.T).max(axis=0) + 1e-9).all()


@pytest.mark.parametrize("seed", range(6))
def test_corners_of_random_clouds(seed):
    r = np.random.default_rng(seed)
    points = r.normal(size=(800, 3)) * [5, 1, 0.2] + np.array([7e5, 6.2e6, 3]) * (seed % 2)
    got = hulls.corners_of(points)
    assert {tuple(p) for p in got} <= {tuple(p) for p in points}
    shift = points.mean(axis=0)
    assert extremes(points - shift) <= {tuple(p) for p in got - shift} and holds(got - shift, points - shift)
    assert len(got) < 200


def test_grids_lines_planes_and_few_points():
    cube = np.array([(x, y, z) for x in range(6) for y in range(6) for z in range(6)], float)
    got = {tuple(p) for p in hulls.corners_of(cube)}
    assert {(x, y, z) for x in (0.0, 5.0) for y in (0.0, 5.0) for z in (0.0, 5.0)} <= got
    flat = np.c_[np.random.default_rng(2).random((300, 2)), np.zeros(300)]
    assert holds(hulls.corners_of(flat), flat) and len(hulls.corners_of(flat)) < 60
    line = np.outer(np.arange(20.0), [1, 2, 3])
    assert {tuple(p) for p in hulls.corners_of(line)} == {(0, 0, 0), (19, 38, 57)}
    assert len(hulls.corners_of(np.zeros((5, 3)))) == 1 and len(hulls.corners_of(np.empty((0, 3)))) == 0
    assert len(hulls.corners_of(np.array([[0, 0, 0], [1, np.nan, 0]]))) == 1


def test_boxes_hold_all_points_and_ignore_density(spark):
    r = np.random.default_rng(5)
    turn = np.linalg.qr(r.normal(size=(3, 3)))[0]
    body = r.random((400, 3)) * [10, 3, 1]
    # nine tenths of the points are in one small place
    crowd = r.random((3600, 3)) * 0.01 + [0.2, 2.8, 0.5]
    ends = np.array([(x, y, z) for x in (0, 10) for y in (0, 3) for z in (0, 1)], float)
    points = np.concatenate([body, crowd, ends]) @ turn.T + [100, 200, 5]
    df = spark.createDataFrame([(1, *map(float, p)) for p in points] + [(2, 1.0, 1.0, 1.0)], "i int, x double, y double, z double").repartition(5)
    boxes = hulls.hull_boxes(df, "i")
    row = boxes.filter("i = 1").first()
    assert np.allclose(sorted(row.extent, reverse=True), [10, 3, 1], atol=0.8)
    assert df.join(boxes, "i").filter(hulls.outside_box()).count() == 0
    edges = hulls.box_edges(boxes.filter("i = 1"), "i")
    lengths = sorted(round(float(np.linalg.norm([e.x2 - e.x1, e.y2 - e.y1, e.z2 - e.z1])), 6) for e in edges.collect())
    assert lengths == sorted(round(v, 6) for v in row.extent for _ in range(4))
    dots = discretise.dashes(edges, 0.05, 0.05)
    assert dots.select("seg_id").distinct().count() == 12 and dots.count() > 200
    assert hulls.hull_corners(df.filter("i = 0"), "i").count() == 0
