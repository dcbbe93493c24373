"""What travels in the search for nearest segments, on planted sites."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subgrade.operators import nearest, packed
from tests.test_operators import SEGMENTS, frame, plain_nearest

POINTS = "pid long, x double, y double, z double"


def plain(rows):
    return [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows]


@pytest.fixture
def held(monkeypatch):
    """The tables that the search writes, and what _dealt gives, by name."""
    tables, keep, deal = {}, packed.written, packed._dealt
    monkeypatch.setattr(packed, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    monkeypatch.setattr(packed, "_dealt", lambda *a: tables.setdefault("dealt", keep(deal(*a), "dealt")))
    return tables


def test_segments_above_others_don_t_travel_to_points_far_below(spark, held):
    r = np.random.default_rng(8)
    pts = plain((i, *p) for i, p in enumerate(r.random((1100, 3)) * (10, 10, -12) + (0, 0, -8)))
    segs = plain((i, *e, 0.1 * (i % 50 == 0)) for i, e in enumerate(r.random((4000, 6)) * (10, 10, -5, 10, 10, -5)))
    found = nearest.nearest_segment(frame(spark, pts, POINTS), frame(spark, segs, SEGMENTS)).collect()
    for x in found[::50]:
        dist, seg_id, _, _ = plain_nearest(np.array([x.x, x.y, x.z]), segs)
        assert x.seg_id == seg_id and abs(x.dist - dist) < 1e-9
    blocks = held["nearest-points"].count()
    travelled = held["dealt"].agg(F.sum(F.length("ids") / 8)).first()[0]
    assert blocks >= 4 and travelled < 0.25 * blocks * len(segs)


def test_rows_of_segments_are_bounded():
    n = 5 * packed.ROW + 5
    ids, ends = np.arange(n), np.zeros((len(packed.ENDS), n))
    block, line = np.repeat([7, 9], n), np.tile(np.arange(n), 2)
    batches = list(packed._rows(block, line, ids, ends))
    rows = [(b, np.frombuffer(i, np.int64)) for t in batches for b, i in zip(t.column(0).to_pylist(), t.column(1).to_pylist())]
    assert max(len(i) for _, i in rows) <= packed.ROW and len(batches) > 1
    assert all((np.concatenate([i for b, i in rows if b == k]) == ids).all() for k in (7, 9))


def test_many_ties_are_compared_some_at_a_time(spark, monkeypatch):
    sizes, keep = [], packed._Block._compare
    monkeypatch.setattr(packed, "PAIRS", 50)
    monkeypatch.setattr(packed._Block, "_compare", lambda self, i, j, *rest: (sizes.append(len(i)), keep(self, i, j, *rest)))
    block = packed._Block(np.random.default_rng(1).random((3, 64)), 1e-9)
    ends = np.array([[0.0, 0.0, 2.0, 1.0, 1.0, 2.0, 0.0]] * 10).T.copy()
    block.meet(np.arange(10)[::-1].copy(), ends)
    assert (block.seg == 0).all() and len(sizes) > 5 and max(sizes) < 50 + 80
