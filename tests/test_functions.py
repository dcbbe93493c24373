"""Hand-computed cases of the scalar and geometry functions, and their properties."""

from math import inf, nan

import pytest
from pyspark.sql import functions as F

from subgrade.functions import scalars as S
from subgrade.functions.geometry import Seg, circle_clip, in_polygon, offsets, rect_clip

SEG = "x double, y double, z double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, hw double"


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}")
    return [r.v for r in df.select("id", column().alias("v")).orderBy("id").collect()]


def rounded(row):
    return None if row is None else tuple(round(x, 6) for x in row)


def test_segment_and_ribbon_distance(spark):
    rows = [(3.0, 0.5, 0.25, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (3.0, 0.5, 0.25, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.125), (1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]

    def parts():
        xy2, dz = offsets(Seg.of(F.col), F.col("x"), F.col("y"), F.col("z"))
        return F.array(F.sqrt(xy2), dz, F.sqrt(xy2 + dz * dz))

    got = [rounded(v) for v in values(spark, rows, SEG, parts)]
    assert got == [(2.061553, 0.25, 2.076656), (0.375, 0.25, 0.450694), rounded((2**0.5, 1.0, 3**0.5))]


@pytest.mark.parametrize(
    "clip,ends,t",
    [
        (lambda s: rect_clip(s, 0.0, -1.0, 2.0, 1.0), (-1.0, 0.0, 3.0, 0.0), (0.25, 0.75)),
        (lambda s: rect_clip(s, 0.0, -1.0, 2.0, 1.0), (-1.0, 2.0, 3.0, 2.0), None),
        (lambda s: rect_clip(s, 0.0, -1.0, 2.0, 1.0), (1.0, 0.0, 1.0, 0.0), (0.0, 1.0)),
        (lambda s: circle_clip(s, F.lit(0.0), F.lit(0.0), F.lit(1.0)), (-2.0, 0.0, 2.0, 0.0), (0.25, 0.75)),
        (lambda s: circle_clip(s, F.lit(0.0), F.lit(0.0), F.lit(1.0)), (-2.0, 2.0, 2.0, 2.0), None),
        (lambda s: circle_clip(s, F.lit(0.0), F.lit(0.0), F.lit(1.0)), (0.5, 0.5, 0.5, 0.5), (0.0, 1.0)),
    ],
)
def test_clips(spark, clip, ends, t):
    x1, y1, x2, y2 = ends
    row = (0.0, 0.0, 0.0, x1, y1, 0.0, x2, y2, 4.0, 0.0)
    assert rounded(values(spark, [row], SEG, lambda: clip(Seg.of(F.col)))[0]) == t


def test_point_in_polygon(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    inside = lambda: in_polygon(F.col("x"), F.col("y"), ring)
    assert values(spark, [(1.0, 1.0), (2.0, 3.0), (3.9, 3.0), (5.0, 1.0)], "x double, y double", inside) == [True, False, True, False]
    assert values(spark, [(9.0, 9.0)], "x double, y double", lambda: in_polygon(F.col("x"), F.col("y"), [])) == [True]


def test_accuracy_classes(spark):
    texts = ["<= 0,50 m", "> 2.00 m", "> 1.00", "<= 3 m", "0.375", "", "ukendt", None, "nan"]
    got = values(spark, [(t,) for t in texts], "t string", lambda: S.accuracy_class(F.col("t")))
    assert [tuple(v) if v else None for v in got] == [(0.5, 2), (2.0, 5), (1.0, 3), (2.0, 4), (0.25, 1), None, None, None, None]


def test_deviation_classes_and_colours(spark):
    d = [0.0, 0.25, 0.2500001, 0.5, 1.0, 2.0, 2.1, nan]
    assert values(spark, [(x,) for x in d], "d double", lambda: S.deviation_class(F.col("d"))) == [1, 1, 2, 2, 3, 4, 5, 0]
    hard = values(spark, [(nan,), (0.3,)], "d double", lambda: S.deviation_colour(F.col("d")))
    assert [tuple(c) for c in hard] == [(0.8, 0.0, 0.0), (0.6, 0.9, 0.0)]
    soft = values(spark, [(0.125,), (nan,), (5.0,), (-1.0,)], "d double", lambda: S.deviation_gradient(F.col("d")))
    assert [rounded(c) for c in soft] == [(0.3, 0.8, 0.1), (0.0, 0.0, 0.0), (0.8, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_bytes_and_intensities(spark):
    assert values(spark, [(0.0005,), (0.0015,), (70.0,)], "d double", lambda: S.las_intensity(F.col("d"))) == [0, 2, 65535]
    back = values(spark, [(x / 10,) for x in range(11)], "c double", lambda: S.linear_to_srgb(S.srgb_to_linear(F.col("c"))))
    assert all(abs(v - x / 10) < 1e-9 for x, v in enumerate(back))


def test_names(spark):
    files = ["1_instance_0_type_4.ply", "_type_WaterLine.ply", "x.ply", "_type_Foo.ply"]
    assert values(spark, [(f,) for f in files], "f string", lambda: S.type_of_file(F.col("f"))) == [4, 7, 0, 0]
    assert values(spark, [("Area_5_Site_11",)], "f string", lambda: S.base_name(F.col("f"))) == ["Site_11"]
    assert values(spark, [("Water_Area_5", "Area_3_Site_1.ply"), ("x", "area 12.ply"), ("x", "y")], "p string, f string", lambda: S.area_number(F.col("p"), F.col("f"))) == [5, 12, None]
    assert values(spark, [("Fjernvarme",), ("ukendt",)], "s string", lambda: S.supply_line(F.col("s"))) == ["TermiskLedning", None]
    grey = lambda: S.supply_colour(F.col("s"), F.struct(*[F.lit(0.5).alias(c) for c in "rgb"]))
    assert [tuple(v) for v in values(spark, [("telekommunikation",), ("?",)], "s string", grey)] == [(0.98, 0.588, 0.275), (0.5, 0.5, 0.5)]
    assert values(spark, [(" Ude af Drift",), ("i drift",), (None,)], "s string", lambda: S.is_active(F.col("s"))) == [False, True, True]
    assert values(spark, [("500",), ("-1",), ("",), (None,)], "s string", lambda: S.width_metres(F.col("s"))) == [0.5, None, None, None]
    assert values(spark, [(r"x/Ledningspakke_123",), ("y",)], "s string", lambda: S.package_label(F.col("s"))) == ["Ledningspakke 123", None]
    assert inf > 0
