"""Clouds put together, and the shapes that are drawn around instances and segments."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

MAIN_UTILITY, WATER = 0, 7


def joined_clouds(clouds: dict[str, DataFrame]) -> DataFrame:
    """The points of several sites with site_id; points of a cloud without classes have class -1."""
    named = [c.withColumn("site_id", F.lit(name)) for name, c in clouds.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return rows.withColumn("class", F.coalesce("class", F.lit(-1)) if "class" in rows.columns else F.lit(-1))


def main_to_water(points: DataFrame) -> DataFrame:
    """The points of the main utility as one instance of a water line."""
    return points.filter(F.col("class") == MAIN_UTILITY).withColumns({"instance_id": F.lit(0), "utility_type": F.lit(WATER)})


def next_unlabelled(instances: DataFrame, current: int) -> int | None:
    """The first instance without a type behind `current`, from the start again after the last; None if all have one."""
    turn = F.struct((F.col("idx") <= current).alias("behind"), "idx")
    row = instances.filter("utility_type = 0").agg(F.min(turn).alias("m")).first()
    return row.m.idx if row.m else None


def _chain(xy: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise from the leftmost; points on an edge are left out."""
    rows = sorted(set(map(tuple, xy.tolist())))
    if len(rows) < 3:
        return rows

    def half(run):
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(rows) + half(rows[::-1])


def convex_hull(points: DataFrame, by: str) -> DataFrame:
    """by, ring: the corners of the hull in the plane of each group's points.

    Each task first reduces its own points to the corners of their hull, so that what meets in one group are corners of
    parts and not points.
    """
    kind = dict(points.dtypes)[by]
    schema = f"{by} {kind}, x double, y double"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(k, *p) for k, g in pdf.groupby(by, dropna=False) for p in _chain(g[["x", "y"]].to_numpy())]
        return pd.DataFrame(found, columns=[by, "x", "y"])

    parts = points.select(by, "x", "y").mapInPandas(lambda batches: map(corners, batches), schema)

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [{"x": x, "y": y} for x, y in _chain(pdf[["x", "y"]].to_numpy())]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "ring": [made]})

    return parts.groupBy(by).applyInPandas(ring, f"{by} {kind}, ring array<struct<x:double,y:double>>")


def oriented_boxes(points: DataFrame, by: str) -> DataFrame:
    """by, centre, axes (three directions, the longest first) and extent of a box along each group's principal axes.

    The axes come from the group's moments, which combine before the shuffle; the extents from a second aggregation.
    """
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    moments = points.groupBy(by).agg(*[F.coalesce(F.covar_pop(a, b), F.lit(0.0)).alias(a + b) for a, b in pairs])
    kind = dict(points.dtypes)[by]

    def turn(batches):
        for pdf in batches:
            full = np.zeros((len(pdf), 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                full[:, i, j] = full[:, j, i] = pdf[a + b]
            _, vectors = np.linalg.eigh(full)
            yield pd.DataFrame({by: pdf[by], "axes": [v.T[::-1].tolist() for v in vectors]})

    axes = moments.mapInPandas(turn, f"{by} {kind}, axes array<array<double>>")
    joined = points.join(axes, by)
    along = [sum((F.col("axes")[i][j] * F.col(c) for j, c in enumerate("xyz")), F.lit(0.0)) for i in range(3)]
    spans = joined.groupBy(by).agg(F.first("axes").alias("axes"), *[f(a).alias(f"{n}{i}") for i, a in enumerate(along) for n, f in (("low", F.min), ("high", F.max))])
    middle = [(F.col(f"low{i}") + F.col(f"high{i}")) / 2 for i in range(3)]
    centre = F.array(*[sum((middle[i] * F.col("axes")[i][j] for i in range(3)), F.lit(0.0)) for j in range(3)])
    return spans.select(by, centre.alias("centre"), "axes", F.array(*[F.col(f"high{i}") - F.col(f"low{i}") for i in range(3)]).alias("extent"))


def ribbon_corners(segments: DataFrame) -> DataFrame:
    """segments with corners, the four of a level ribbon of 2 * half_width; a vertical one lies along x."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    flat = F.sqrt(dx * dx + dy * dy)
    safe = F.when(flat > 1e-9, flat).otherwise(F.lit(1.0))
    sx, sy = F.when(flat > 1e-9, -dy / safe).otherwise(F.lit(1.0)), F.when(flat > 1e-9, dx / safe).otherwise(F.lit(0.0))
    corner = lambda i, side: F.struct((F.col(f"x{i}") + side * F.col("half_width") * sx + 0.0).alias("x"), (F.col(f"y{i}") + side * F.col("half_width") * sy).alias("y"), F.col(f"z{i}").alias("z"))
    return segments.withColumn("corners", F.array(corner(1, -1), corner(1, 1), corner(2, 1), corner(2, -1)))


def fan(rings: DataFrame, by: str) -> DataFrame:
    """The triangles of each ring (array of corners) from its first corner: by, i, and the corners' places a, b, c."""
    rows = rings.filter(F.size("ring") >= 3).select(by, F.explode(F.sequence(F.lit(1), F.size("ring") - 2)).alias("i"))
    return rows.select(by, (F.col("i") - 1).alias("triangle"), F.lit(0).alias("a"), F.col("i").alias("b"), (F.col("i") + 1).alias("c"))


def merged_vertices(shapes: DataFrame, order: str) -> DataFrame:
    """shapes (n_vertices, ...) with offset, by which the shape's indices move when all are put into one.

    The running sum is over sums of blocks of 4,096 shapes in order, so that no task holds more than a block and the table
    of blocks, a row for each, is what meets in one place.
    """
    block = shapes.withColumn("block__", F.floor(F.col(order) / 4096))
    sums = block.groupBy("block__").agg(F.sum("n_vertices").alias("n__"))
    before = sums.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    inside = F.coalesce(F.sum("n_vertices").over(Window.partitionBy("block__").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn("inside__", inside).join(before, "block__").withColumn("offset", F.col("before__") + F.col("inside__")).drop("block__", "inside__", "before__")


def representative_points(vertex_rows: DataFrame, by: str, closed: Column) -> DataFrame:
    """by, x, y, z: where a component that isn't a point is drawn. vertex_rows: by, vid, x, y, z of one ring or line.

    x, y are the centroid: by area of a closed ring, by length of a line, of the vertices where these have neither; z is the
    first vertex's, 0 if that has none.
    """
    w = Window.partitionBy(by).orderBy("vid")
    rows = vertex_rows.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "ox": F.first("x").over(w), "oy": F.first("y").over(w), "closed": closed})
    # about the first vertex, as coordinates may be large
    ax, ay, bx, by_ = F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("nx") - F.col("ox"), F.col("ny") - F.col("oy")
    weight = F.when(F.col("closed"), ax * by_ - bx * ay).otherwise(F.sqrt((bx - ax) ** 2 + (by_ - ay) ** 2))
    part = F.when(F.col("closed"), F.lit(3.0)).otherwise(F.lit(2.0))
    rows = rows.withColumns({"w": F.when(F.col("nx").isNotNull(), weight), "mx": (ax + bx) / part, "my": (ay + by_) / part})
    total = F.nullif(F.sum("w"), F.lit(0.0))
    centre = lambda c: (F.first(f"o{c}") + F.coalesce(F.sum(F.col("w") * F.col(f"m{c}")) / total, F.avg(F.col(c) - F.col(f"o{c}")))).alias(c)
    return rows.groupBy(by).agg(centre("x"), centre("y"), F.coalesce(F.min_by("z", "vid"), F.lit(0.0)).alias("z"))
