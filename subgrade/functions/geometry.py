"""Geometry of points and segments, as expressions on columns (or fields of a segment struct)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass
class Seg:
    """A segment's coordinates and half width."""

    x1: Column
    y1: Column
    z1: Column
    x2: Column
    y2: Column
    z2: Column
    hw: Column

    @classmethod
    def of(cls, get) -> "Seg":
        """From get(name), such as F.col or a struct's getField."""
        return cls(*[get(n) for n in ("x1", "y1", "z1", "x2", "y2", "z2", "hw")])


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def along(s: Seg, x: Column, y: Column, z: Column) -> Column:
    """Share of the way along the segment of the point's projection, held to 0..1; 0 on a segment without length."""
    dx, dy, dz = s.x2 - s.x1, s.y2 - s.y1, s.z2 - s.z1
    length2 = dx * dx + dy * dy + dz * dz
    t = ((x - s.x1) * dx + (y - s.y1) * dy + (z - s.z1) * dz) / F.nullif(F.when(length2 > 1e-12, length2).otherwise(F.lit(0.0)), F.lit(0.0))
    return F.coalesce(clamp(t, F.lit(0.0), F.lit(1.0)), F.lit(0.0))


def offsets(s: Seg, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(horizontal distance squared, vertical distance) from the point to the segment's nearest point.

    With a half width over 1e-9 the segment is a ribbon: horizontally only what lies across it counts, less the half
    width; what lies beyond its ends along it doesn't.
    """
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    t = along(s, x, y, z)
    ex, ey, ez = x - (s.x1 + t * dx), y - (s.y1 + t * dy), z - (s.z1 + t * (s.z2 - s.z1))
    flat = F.sqrt(dx * dx + dy * dy)
    # a vertical ribbon has no direction across
    across = F.when(flat > 1e-12, F.abs(ey * dx - ex * dy) / F.when(flat > 1e-12, flat).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    lateral = F.greatest(across - s.hw, F.lit(0.0))
    return F.when(s.hw > 1e-9, lateral * lateral).otherwise(ex * ex + ey * ey), F.abs(ez)


def rect_clip(s: Seg, minx, miny, maxx, maxy) -> Column:
    """struct(t0, t1) of the part inside the rectangle, null where there is none."""
    t0, t1 = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for a, d, low, high in ((s.x1, s.x2 - s.x1, minx, maxx), (s.y1, s.y2 - s.y1, miny, maxy)):
        flat = F.abs(d) < 1e-12
        step = F.when(flat, F.lit(1.0)).otherwise(d)
        ta, tb = (F.lit(low) - a) / step, (F.lit(high) - a) / step
        t0 = F.when(flat, t0).otherwise(F.greatest(t0, F.least(ta, tb)))
        t1 = F.when(flat, t1).otherwise(F.least(t1, F.greatest(ta, tb)))
        outside = outside | (flat & ((a < low) | (a > high)))
    return F.when(~outside & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def circle_clip(s: Seg, cx, cy, r) -> Column:
    """struct(t0, t1) of the part inside the circle, null where there is none."""
    dx, dy, fx, fy = s.x2 - s.x1, s.y2 - s.y1, s.x1 - cx, s.y1 - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    point = a < 1e-12
    a_ = F.when(point, F.lit(1.0)).otherwise(a)
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t0, t1 = F.greatest((-b - root) / (2 * a_), F.lit(0.0)), F.least((-b + root) / (2 * a_), F.lit(1.0))
    whole = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))
    return F.when(point, F.when(c <= 0, whole)).when((disc >= 0) & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def at(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def box_meets_rect(low_x, low_y, high_x, high_y, minx, miny, maxx, maxy) -> Column:
    """Whether two boxes share a point, edges included."""
    return (high_x >= minx) & (low_x <= maxx) & (high_y >= miny) & (low_y <= maxy)


def crosses(ax, ay, bx, by, x: Column, y: Column) -> Column:
    """Whether the edge a-b is crossed by the ray from (x, y) to the right; half open, so vertices count once."""
    rise = F.when(by == ay, F.lit(1.0)).otherwise(by - ay)
    return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / rise + ax)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Crossing number over a ring given as plain numbers; without one (fewer than 3 corners) everything is inside."""
    if len(ring) < 3:
        return F.lit(True)
    n = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        n = n + crosses(F.lit(float(ax)), F.lit(float(ay)), F.lit(float(bx)), F.lit(float(by)), x, y).cast("int")
    return n % 2 == 1


def near_polygon(x: Column, y: Column, ring: list[tuple[float, float]], width: float) -> Column:
    """Whether a point lies in the ring or no farther than width from its edge: the ring's buffer, which is not drawn."""
    inside = in_polygon(x, y, ring)
    zero = F.lit(0.0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        edge = Seg(F.lit(float(ax)), F.lit(float(ay)), zero, F.lit(float(bx)), F.lit(float(by)), zero, zero)
        inside = inside | (offsets(edge, x, y, zero)[0] <= width * width)
    return inside
