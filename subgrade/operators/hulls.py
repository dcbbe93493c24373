"""Convex hulls in space, the boxes along their axes, and the edges of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: What lies no farther from a face than this, relative to the extent, lies on it.
FLAT = 1e-10


def _spread(p: np.ndarray) -> list[int] | None:
    """Four points that span a body, each the farthest from those before; None if all lie in a plane."""
    size = np.ptp(p, axis=0).max()
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(axis=1).argmax())
    along = p[b] - p[a]
    if not along.any():
        return None
    off = np.cross(p - p[a], along)
    c = int((off**2).sum(axis=1).argmax())
    normal = np.cross(along, p[c] - p[a])
    if np.linalg.norm(normal) <= FLAT * size * size:
        return None
    height = (p - p[a]) @ (normal / np.linalg.norm(normal))
    d = int(np.abs(height).argmax())
    return None if abs(height[d]) <= FLAT * size * 10 else [a, b, c, d]


def _planar(p: np.ndarray) -> np.ndarray:
    """Corners of the hull of points in one plane or line, in that plane."""
    centred = p - p.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    flat = centred @ axes[:2].T if len(axes) > 1 else np.c_[centred[:, 0], np.zeros(len(p))]
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    least = FLAT * np.ptp(flat, axis=0).max() ** 2

    def half(run: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in run:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = flat[out[-2]], flat[out[-1]], flat[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > least:
                    break
                out.pop()
            out.append(int(i))
        return out

    return p[sorted({*half(order), *half(order[::-1])})]


def corners_of(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (n, 3). Points in one plane give the corners of their hull there."""
    p = np.unique(points[np.isfinite(points).all(axis=1)], axis=0)
    if len(p) <= 4:
        return p
    first = _spread(p)
    if first is None:
        return _planar(p)
    size = np.ptp(p, axis=0).max()
    middle = p[first].mean(axis=0)

    def faces_of(triples: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = np.array(triples)
        normal = np.cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]])
        inward = ((middle - p[t[:, 0]]) * normal).sum(axis=1) > 0
        t[inward] = t[inward][:, [0, 2, 1]]
        normal[inward] *= -1
        length = np.linalg.norm(normal, axis=1, keepdims=True)
        normal = normal / np.where(length > 0, length, 1)
        return t, normal, (normal * p[t[:, 0]]).sum(axis=1)

    a, b, c, d = first
    face, normal, offset = faces_of([(a, b, c), (a, b, d), (a, c, d), (b, c, d)])
    rest = np.arange(len(p))
    while len(rest):
        # of all points still outside of some face, the farthest one is a corner
        above = p[rest] @ normal.T - offset
        rest, above = rest[(above > FLAT * size).any(axis=1)], above[(above > FLAT * size).any(axis=1)]
        if not len(rest):
            break
        k = int(np.unravel_index(above.argmax(), above.shape)[0])
        seen = above[k] > FLAT * size
        edges = np.sort(np.concatenate([face[seen][:, [0, 1]], face[seen][:, [1, 2]], face[seen][:, [2, 0]]]), axis=1)
        # an edge of one face only that the new corner sees is on the horizon
        rim, times = np.unique(edges, axis=0, return_counts=True)
        new, n_new, o_new = faces_of([(int(u), int(v), int(rest[k])) for u, v in rim[times == 1]])
        face, normal, offset = np.concatenate([face[~seen], new]), np.concatenate([normal[~seen], n_new]), np.concatenate([offset[~seen], o_new])
        rest = np.delete(rest, k)
    return p[np.unique(face)]


def hull_corners(points: DataFrame, by: str) -> DataFrame:
    """by, x, y, z: the corners of each group's hull in space, as rows.

    Each task reduces its own points to corners before the exchange, so that what meets are corners of parts.
    """
    kind = dict(points.dtypes)[by]
    schema = f"{by} {kind}, x double, y double, z double"

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, dropna=False):
                xyz = g[["x", "y", "z"]].to_numpy(float)
                held[key] = corners_of(np.concatenate([held[key], xyz]) if key in held else xyz)
            if sum(map(len, held.values())) > 200_000:
                yield framed(held)
        if held:
            yield framed(held)

    def framed(held: dict) -> pd.DataFrame:
        out = pd.DataFrame([(k, *map(float, c)) for k, v in held.items() for c in v], columns=[by, "x", "y", "z"])
        held.clear()
        return out

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        got = corners_of(pdf[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(got), **{c: got[:, i] for i, c in enumerate("xyz")}})

    return points.select(by, "x", "y", "z").mapInPandas(reduced, schema).groupBy(by).applyInPandas(merged, schema)


def hull_boxes(points: DataFrame, by: str) -> DataFrame:
    """by, centre, axes (the longest spread first), extent: each group's box along the principal axes of its hull's corners, so
    that how dense a cloud is has no part in its direction. The box holds all the group's points."""
    kind = dict(points.dtypes)[by]

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        centred = xyz - xyz.mean(axis=0)
        _, vectors = np.linalg.eigh(centred.T @ centred / len(xyz))
        axes = vectors.T[::-1]
        axes[2] = np.cross(axes[0], axes[1])
        along = xyz @ axes.T
        low, high = along.min(axis=0), along.max(axis=0)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "centre": [((low + high) / 2 @ axes).tolist()], "axes": [axes.tolist()], "extent": [(high - low).tolist()]})

    return hull_corners(points, by).groupBy(by).applyInPandas(box, f"{by} {kind}, centre array<double>, axes array<array<double>>, extent array<double>")


def outside_box(slack: float = 1e-6) -> Column:
    """Whether a point x, y, z lies out of the box of its row (centre, axes, extent)."""
    d = [F.col(c) - F.col("centre")[i] for i, c in enumerate("xyz")]
    along = [sum((F.col("axes")[i][j] * d[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    return F.greatest(*[F.abs(a) - F.col("extent")[i] / 2 for i, a in enumerate(along)]) > slack


def box_edges(boxes: DataFrame, by: str) -> DataFrame:
    """by, seg_id (edge, 0 to 11) and the ends x1..z2 of the edges of boxes, to be cut into dots by discretise.dashes."""
    signs = [(i, u, v) for i in range(3) for u in (-1, 1) for v in (-1, 1)]

    def end(i: int, u: int, v: int, side: int) -> list[Column]:
        j, k = [n for n in range(3) if n != i]
        half = lambda n: F.col("extent")[n] / 2
        return [F.col("centre")[c] + F.col("axes")[i][c] * half(i) * side + F.col("axes")[j][c] * half(j) * u + F.col("axes")[k][c] * half(k) * v for c in range(3)]

    edges = [F.struct(F.lit(n).alias("seg_id"), *[e.alias(f"{c}{s}") for s, side in ((1, -1), (2, 1)) for c, e in zip("xyz", end(i, u, v, side))]) for n, (i, u, v) in enumerate(signs)]
    return boxes.select(by, F.inline(F.array(*edges)))
