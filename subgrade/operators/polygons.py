"""Polygons with holes: what meets a rectangle, kinds of geometry, triangles and their heights.

features have parts, roles and polygons, as sources.gml gives them; rings may be closed or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from subgrade.functions.geometry import Seg, crosses, rect_clip
from subgrade.operators.accuracy import drape

#: Types by kind.
KINDS = {
    "point": ("Point", "MultiPoint"), "line": ("LineString", "Curve", "MultiLineString", "MultiCurve", "CompositeCurve"),
    "polygon": ("Polygon", "Surface", "MultiPolygon", "MultiSurface"),
}


def of_kind(features: DataFrame, *kinds: str) -> DataFrame:
    """The features whose geometry is of one of the kinds (point, line, polygon); the others are told by skipped()."""
    return features.filter(F.col("geom_type").isin([t for k in kinds for t in KINDS[k]]))


def skipped(features: DataFrame, *kinds: str) -> DataFrame:
    """layer, geom_type (null: without geometry), n of the features that of_kind leaves out."""
    kept = F.coalesce(F.col("geom_type").isin([t for k in kinds for t in KINDS[k]]), F.lit(False))
    return features.filter(~kept).groupBy("layer", "geom_type").agg(F.count("*").alias("n"))


def edges(part: Column, closed: Column) -> Column:
    """The edges of a part as structs x1, y1, x2, y2; of a ring that is not closed, the last to the first too."""
    ring = F.when(closed & (F.size(part) > 0) & (F.element_at(part, 1) != F.element_at(part, -1)), F.concat(part, F.slice(part, 1, 1))).otherwise(part)
    ends = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.filter(ends, lambda e: e["x2"].isNotNull())


def _parts() -> Column:
    return F.arrays_zip("parts", "roles")


def _is_ring(p: Column) -> Column:
    return p["roles"].isin("exterior", "interior")


def contains(x: Column, y: Column) -> Column:
    """Whether a feature's polygons hold a point, holes left out: edges that a ray to the right crosses are odd in number."""
    crossed = F.transform(_parts(), lambda p: F.when(_is_ring(p), F.size(F.filter(edges(p["parts"], F.lit(True)), lambda e: crosses(e["x1"], e["y1"], e["x2"], e["y2"], x, y)))).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda a, b: a + b) % 2 == 1


def meets_rect(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a feature truly meets the rectangle, edges included: a point lies in it, an edge runs through it, or a polygon
    holds it. A rectangle within a hole is not met. Null without geometry."""
    zero = F.lit(0.0)

    def edge(e: Column) -> Column:
        return rect_clip(Seg(e["x1"], e["y1"], zero, e["x2"], e["y2"], zero, zero), minx, miny, maxx, maxy).isNotNull()

    inside = lambda v: (v["x"] >= minx) & (v["x"] <= maxx) & (v["y"] >= miny) & (v["y"] <= maxy)
    touched = F.exists(_parts(), lambda p: F.exists(p["parts"], inside) | F.exists(edges(p["parts"], _is_ring(p)), edge))
    # what no edge meets lies wholly in or out, so one corner tells
    return touched | contains(minx, miny)


def area() -> Column:
    """The area of a feature's polygons less their holes."""
    def shoelace(p: Column) -> Column:
        twice = F.aggregate(F.transform(edges(p["parts"], F.lit(True)), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]), F.lit(0.0), lambda a, b: a + b)
        return F.when(p["roles"] == "exterior", F.abs(twice) / 2).when(p["roles"] == "interior", -F.abs(twice) / 2).otherwise(0.0)

    return F.aggregate(F.transform(_parts(), shoelace), F.lit(0.0), lambda a, b: a + b)


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of triangles; positive if a, b, c turn left."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _opened(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings without a repeated last corner, the first turning left and the others right; those under 3 corners go."""
    out = []
    for i, r in enumerate(rings):
        r = r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r
        if len(r) < 3:
            if not i:
                return []
            continue
        x, y = r.T
        left = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() > 0
        out.append(r if left == (i == 0) else r[::-1])
    return out


def _bridged(outer: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """One ring of a ring and a hole, joined by an edge there and back between corners that see each other."""
    k = int(hole[:, 0].argmax())
    m = hole[k]
    a, b = outer, np.roll(outer, -1, axis=0)
    spans = ((a[:, 1] <= m[1]) & (b[:, 1] >= m[1])) | ((b[:, 1] <= m[1]) & (a[:, 1] >= m[1]))
    rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
    x = np.where(b[:, 1] == a[:, 1], np.maximum(a[:, 0], b[:, 0]), a[:, 0] + (m[1] - a[:, 1]) / rise * (b[:, 0] - a[:, 0]))
    hits = np.where(spans & (x >= m[0]), x, np.inf)
    e = int(hits.argmin())
    p = e if a[e, 0] > b[e, 0] else (e + 1) % len(outer)
    # corners within the triangle of m, the hit and p hide p; of these, the one at the smallest angle is seen
    tri = np.array([m, [hits[e], m[1]], outer[p]])
    tri = tri if _cross(*tri) >= 0 else tri[[0, 2, 1]]
    inside = np.all([_cross(tri[i], tri[(i + 1) % 3], outer) >= 0 for i in range(3)], axis=0)
    inside &= ~(outer == outer[p]).all(axis=1)
    if inside.any():
        d = outer - m
        angle = np.where(inside, np.abs(np.arctan2(d[:, 1], d[:, 0])), np.inf)
        best = np.flatnonzero(angle == angle.min())
        p = int(best[(d[best] ** 2).sum(axis=1).argmin()])
    # a corner that an earlier bridge doubled is joined at that copy whose own angle opens to m
    for i in np.flatnonzero((outer == outer[p]).all(axis=1)):
        before, at, after = outer[i - 1], outer[i], outer[(i + 1) % len(outer)]
        sides = _cross(before, at, m) > 0, _cross(at, after, m) > 0
        if all(sides) if _cross(before, at, after) >= 0 else any(sides):
            p = int(i)
            break
    return np.concatenate([outer[: p + 1], np.roll(hole, -k, axis=0), m[None], outer[p:]])


def triangles_of(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles (n, 3, 2) of a polygon (exterior ring, then holes), by cutting ears; none of a ring under 3 corners."""
    rings = _opened(rings)
    if not rings:
        return np.empty((0, 3, 2))
    ring = rings[0]
    # the rounding of coordinates leaves so much of a cross product that is 0; what is less lies on a line
    give = 4 * np.finfo(float).eps * np.abs(ring).max() * np.ptp(ring, axis=0).max()
    for hole in sorted(rings[1:], key=lambda h: -h[:, 0].max()):
        ring = _bridged(ring, hole)
    left, out = list(range(len(ring))), []
    while len(left) > 3:
        at = ring[left]
        before, after = np.roll(at, 1, axis=0), np.roll(at, -1, axis=0)
        turn = _cross(before, at, after)
        cut = None
        for i in np.flatnonzero(turn > give):
            a, b, c = before[i], at[i], after[i]
            others = ~((at == a).all(axis=1) | (at == b).all(axis=1) | (at == c).all(axis=1))
            within = (_cross(a, b, at) >= -give) & (_cross(b, c, at) >= -give) & (_cross(c, a, at) >= -give) & others
            if not within.any():
                cut = int(i)
                break
        if cut is None:
            # corners on a line, or rings that touch: what has no area goes first
            cut = int(np.abs(turn).argmin())
        if turn[cut] > give:
            out.append((before[cut], at[cut], after[cut]))
        left.pop(cut)
    last = ring[left]
    if _cross(*last) > give:
        out.append(tuple(last))
    return np.array(out).reshape(-1, 3, 2)


def triangulated(features: DataFrame, *keys: str) -> DataFrame:
    """keys, polygon, triangle (from 0), corner (0 to 2), x, y of the triangles of each polygon. A polygon is a row, so a task's
    memory is a polygon's; features without polygons give none."""
    rings = features.select(*keys, F.explode(F.arrays_zip("parts", "roles", "polygons")).alias("r")).filter(F.col("r.roles").isin("exterior", "interior"))
    whole = rings.groupBy(*keys, F.col("r.polygons").alias("polygon")).agg(F.array_sort(F.collect_list(F.struct(F.col("r.roles").alias("role"), F.col("r.parts").alias("part")))).alias("rings"))
    whole = whole.filter("rings[0].role = 'exterior'")
    kinds = dict(whole.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            row, number, corner, xy = [], [], [], []
            for i, value in enumerate(column["rings"].to_pylist()):
                found = triangles_of([np.array([(v["x"], v["y"]) for v in r["part"]]) for r in value])
                n = len(found)
                row.append(np.full(3 * n, i))
                number.append(np.repeat(np.arange(n), 3))
                corner.append(np.tile(np.arange(3), n))
                xy.append(found.reshape(-1, 2))
            if not row:
                continue
            take = pa.array(np.concatenate(row))
            places = np.concatenate(xy)
            arrays = [column[c].take(take) for c in (*keys, "polygon")] + [pa.array(np.concatenate(v), pa.int32()) for v in (number, corner)] + [pa.array(places[:, k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "polygon", "triangle", "corner", "x", "y"])

    return whole.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "polygon")) + ", triangle int, corner int, x double, y double")


def draped_triangles(corners: DataFrame, segments: DataFrame, *keys: str) -> DataFrame:
    """The corners of triangulated() by keys, with z, the height in the plane of the nearest segment's centre line; 0 without
    segments."""
    named = corners.withColumn("pid", F.concat_ws("/", *keys, "polygon", "triangle", "corner"))
    return drape(named, segments).withColumnRenamed("draped_z", "z").drop("pid")
