"""Heights at places."""

from pyspark.sql import functions as F

from subgrade.operators import accuracy
from tests.test_operators import SEGMENTS, frame
from tests.test_packed import held  # noqa: F401


def test_a_place_is_draped_once(spark, held):  # noqa: F811
    pts = frame(spark, [(i, float(i % 7), float(i % 3)) for i in range(420)] + [(900, None, 1.0)], "pid long, x double, y double")
    segs = frame(spark, [(1, 0.0, 0.0, 0.0, 10.0, 0.0, 5.0, 0.0), (2, 0.0, 2.0, 1.0, 10.0, 2.0, 1.0, 0.0)], SEGMENTS)
    got = {r.pid: r.draped_z for r in accuracy.drape(pts, segs).collect()}
    assert len(got) == 421 and got[900] == 0.0
    assert all(got[i] == (1.0 if i % 3 == 2 else i % 7 / 2) for i in range(420))
    assert held["nearest-points"].agg(F.sum(F.size("pids"))).first()[0] == 21
