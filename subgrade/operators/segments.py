"""Features to parts, vertices and segments; selection and clipping; counts by layer.

features: layer, feature_id, parts array<array<struct<x,y,z>>>, attrs map<string,string>. Coordinates are local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subgrade.functions import scalars as S
from subgrade.functions.dims import FALLBACK_RADIUS, TRACE_FALLBACK_WIDTH, TRACE_LAYER
from subgrade.functions.geometry import Seg, at, box_meets_rect, circle_clip, in_polygon, rect_clip

FEATURE_SCHEMA = "layer string, feature_id string, geom_type string, parts array<array<struct<x:double,y:double,z:double>>>, attrs map<string,string>"


def to_local(x: Column, y: Column, z: Column, tx, ty, tz) -> tuple[Column, Column, Column]:
    """Global to local; a missing z counts as 0 before the shift."""
    return x - tx, y - ty, F.coalesce(z, F.lit(0.0)) - tz


def derived(features: DataFrame) -> DataFrame:
    """features and supply, storage_key, radius, half_width, is_active, indicative_mm, from attrs."""
    a = lambda k: F.col("attrs").getItem(k)
    diameter = S.number(a("udvendigDiameter"))
    is_trace = F.col("layer") == TRACE_LAYER
    width = F.coalesce(S.width_metres(a("bredde")), F.when(is_trace, F.lit(TRACE_FALLBACK_WIDTH)))
    return features.withColumns({
        "supply": F.when(is_trace, S.given(a("forsyningsart"))),
        "storage_key": S.storage_key(F.col("layer"), a("forsyningsart")),
        "radius": F.coalesce(F.when(diameter > 0, diameter / 2000), F.lit(FALLBACK_RADIUS)),
        "half_width": F.coalesce(width / 2, F.lit(0.0)),
        "is_active": S.is_active(a("driftsstatus")),
        "indicative_mm": S.number(a("vejledendeDybde")),
    })


def vertices(features: DataFrame) -> DataFrame:
    """A row for each vertex, with part_idx and vid (its place in the part); features without geometry have none."""
    keep = [c for c in features.columns if c != "parts"]
    parts = features.select(*keep, F.posexplode("parts").alias("part_idx", "part"))
    points = parts.select(*keep, "part_idx", F.posexplode("part").alias("vid", "p"))
    return points.select(*keep, "part_idx", "vid", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.z").alias("z"))


def boxes(vertex_rows: DataFrame, *by: str) -> DataFrame:
    """The horizontal box of each part."""
    return vertex_rows.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x", "y")])


def segments(vertex_rows: DataFrame, *by: str, order: str = "vid") -> DataFrame:
    """Consecutive vertices of a part as rows x1..z2, with seg_idx from 0."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = {f"{c}2": F.lead(c).over(w) for c in "xyz"}
    rows = vertex_rows.withColumns(ahead | {"seg_idx": F.row_number().over(w) - 1}).filter("x2 is not null")
    return rows.withColumnsRenamed({c: f"{c}1" for c in "xyz"})


def _clipped(rows: DataFrame, span: Column) -> DataFrame:
    s = Seg.of(F.col)
    cut = rows.withColumn("span", span).filter("span is not null")
    ends = {f"{c}{i}": at(getattr(s, f"{c}1"), getattr(s, f"{c}2"), F.col(f"span.t{i - 1}")) for i in (1, 2) for c in "xyz"}
    return cut.withColumns(ends).drop("span")


def _with_hw(rows: DataFrame) -> DataFrame:
    return rows if "hw" in rows.columns else rows.withColumn("hw", F.lit(0.0))


def clip_rect(rows: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Segments cut to the rectangle; heights run along."""
    rows = _with_hw(rows)
    return _clipped(rows, rect_clip(Seg.of(F.col), minx, miny, maxx, maxy))


def clip_circle(rows: DataFrame, cx: float, cy: float, r: float) -> DataFrame:
    rows = _with_hw(rows)
    return _clipped(rows, circle_clip(Seg.of(F.col), F.lit(float(cx)), F.lit(float(cy)), F.lit(float(r))))


def parts_in_rect(parts: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    return parts.filter(box_meets_rect(F.col("low_x"), F.col("low_y"), F.col("high_x"), F.col("high_y"), minx, miny, maxx, maxy))


def parts_in_circle(vertex_rows: DataFrame, cx: float, cy: float, r: float, *by: str) -> DataFrame:
    """Parts with a vertex in the circle, or whose box meets the circle's: more may pass than truly meet it."""
    near = F.max(((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2 <= r * r)).alias("near")
    box = [f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x", "y")]
    rows = vertex_rows.groupBy(*by).agg(near, *box)
    meets = box_meets_rect(F.col("low_x"), F.col("low_y"), F.col("high_x"), F.col("high_y"), cx - r, cy - r, cx + r, cy + r)
    return rows.filter(F.col("near") | meets)


def crop_circle(points: DataFrame, r: float) -> DataFrame:
    """Points within r of the cloud's horizontal centroid, which is one aggregated row."""
    centre = points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    return points.crossJoin(F.broadcast(centre)).filter(d2 <= r * r).drop("cx", "cy")


def layer_stats(segment_rows: DataFrame) -> DataFrame:
    """By layer: features and segments, all and active."""
    active = F.col("is_active")
    return segment_rows.groupBy("layer").agg(
        F.countDistinct("feature_id").alias("n_features"), F.count("*").alias("n_segments"),
        F.countDistinct(F.when(active, F.col("feature_id"))).alias("n_active_features"), F.count_if(active).alias("n_active_segments"),
    )


def key_stats(segment_rows: DataFrame) -> DataFrame:
    """By storage_key: features and segments, and features in use and out of it."""
    active = F.col("is_active")
    return segment_rows.groupBy("storage_key").agg(
        F.countDistinct("feature_id").alias("n_features"), F.count("*").alias("n_segments"),
        F.countDistinct(F.when(active, F.col("feature_id"))).alias("n_active_features"), F.countDistinct(F.when(~active, F.col("feature_id"))).alias("n_inactive_features"),
    )


def crop_rect(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Points in the rectangle, edges included."""
    return points.filter(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))


def crop_polygon(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points in the ring, of those in its box; a ring under three corners holds everything."""
    if len(ring) < 3:
        return points
    xs, ys = [float(x) for x, _ in ring], [float(y) for _, y in ring]
    return crop_rect(points, min(xs), min(ys), max(xs), max(ys)).filter(in_polygon(F.col("x"), F.col("y"), ring))


def midpoints(segment_rows: DataFrame) -> DataFrame:
    """seg_id and the middle mx, my, mz of each segment."""
    return segment_rows.select("seg_id", *[((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(f"m{c}") for c in "xyz"])


def centroids(vertex_rows: DataFrame, by: str) -> DataFrame:
    """by and the mean vertex cx, cy, cz."""
    return vertex_rows.groupBy(by).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
