"""Segmentation of points into instances.

Sites are independent, and one site's voxels are bounded by its trench, so the density hierarchy of a site is built in
one task; sites are spread over the cluster. Voxels, labels, sizes and numbering are DataFrame operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from subgrade.functions.dims import MIN_CLUSTER_SIZE, MIN_INSTANCE_POINTS, MIN_SAMPLES, VOXEL
from subgrade.operators import sections
from subgrade.operators.nearest import nearest_segment
from subgrade.tables import written


def voxels(points: DataFrame, size: float = VOXEL, by: str = "site_id") -> DataFrame:
    """One point a voxel, the mean of its points; voxels are counted from the site's least coordinates less half a voxel."""
    origin = points.groupBy(by).agg(*[(F.min(c) - size / 2).alias(f"o{c}") for c in "xyz"])
    cells = points.join(origin, by).withColumns({f"v{c}": F.floor((F.col(c) - F.col(f"o{c}")) / size) for c in "xyz"})
    return cells.groupBy(by, "vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n_points"), F.min("pid").alias("pid"))


def _core_distances(x: np.ndarray, k: int, most: int = 2**20) -> np.ndarray:
    """Distances to the k-th of all points, itself included; `most` of them are held at a time."""
    n, k = len(x), min(k, len(x)) - 1
    block = max(1, most // n)
    out = np.empty(n)
    for a in range(0, n, block):
        d2 = np.zeros((len(x[a : a + block]), n))
        for c in x.T:
            apart = c[a : a + block, None] - c
            d2 += np.multiply(apart, apart, out=apart)
        out[a : a + block] = np.sqrt(np.partition(d2, k, axis=1)[:, k])
    return out


def _spanning_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Prim's tree of mutual reachability, one point's distances at a time."""
    n = len(x)
    best, source = np.full(n, np.inf), np.zeros(n, dtype=int)
    out, done, now = [], np.zeros(n, dtype=bool), 0
    for _ in range(n - 1):
        done[now] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[now]) ** 2).sum(axis=1)), core), core[now])
        nearer = ~done & (d < best)
        best[nearer], source[nearer] = d[nearer], now
        following = int(np.argmin(np.where(done, np.inf, best)))
        out.append((float(best[following]), int(source[following]), following))
        now = following
    return sorted(out)


def density_labels(x: np.ndarray, min_cluster_size: int, min_samples: int) -> np.ndarray:
    """Labels of the most stable clusters of the density hierarchy, -1 for noise."""
    n = len(x)
    labels = np.full(n, -1)
    if n < max(min_cluster_size, 2):
        return labels
    tree = _spanning_tree(x, _core_distances(x, min_samples))
    # merge upward; a node is (children, level), leaves are points
    parent, node_of = list(range(n)), list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    children: dict[int, tuple[int, int, float]] = {}
    size = dict.fromkeys(range(n), 1)
    following = n
    for d, a, b in tree:
        ra, rb = root(a), root(b)
        left, right = node_of[ra], node_of[rb]
        children[following] = (left, right, d)
        size[following] = size[left] + size[right]
        parent[rb] = ra
        node_of[ra] = following
        following += 1

    def points_under(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += children[k][:2]
        return out

    # walk down: a cluster goes on while only one side is large enough, and splits where both are
    clusters: list[dict] = []
    stack = [(following - 1, -1, 0.0)]
    while stack:
        top, above, birth = stack.pop()
        stability, node, split = 0.0, top, None
        while node >= n:
            left, right, d = children[node]
            level = 1 / d if d > 0 else 1e12
            big = [k for k in (left, right) if size[k] >= min_cluster_size]
            if len(big) == 1:
                stability += (size[node] - size[big[0]]) * (level - birth)
                node = big[0]
            else:
                stability += size[node] * (level - birth)
                split = (big, level)
                break
        clusters.append({"top": top, "above": above, "stability": stability, "below": []})
        me = len(clusters) - 1
        if above >= 0:
            clusters[above]["below"].append(me)
        if split and len(split[0]) == 2:
            stack += [(k, me, split[1]) for k in split[0]]
    # from the bottom: a cluster stands if it is more stable than what stands below it; the root never does
    chosen: dict[int, list[int]] = {}
    for k in range(len(clusters) - 1, -1, -1):
        c = clusters[k]
        below = sum(clusters[j]["total"] for j in c["below"])
        if k and (not c["below"] or c["stability"] >= below):
            c["total"], chosen[k] = c["stability"], [k]
        else:
            c["total"], chosen[k] = below, [x for j in c["below"] for x in chosen[j]]
    for label, k in enumerate(sorted(chosen[0])):
        labels[points_under(clusters[k]["top"])] = label
    return labels


def cluster_voxels(cells: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int = MIN_SAMPLES, by: str = "site_id") -> DataFrame:
    """The site's voxels with label."""
    kind = dict(cells.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", kind="stable")
        return pdf.assign(label=density_labels(pdf[["x", "y", "z"]].to_numpy(), min_cluster_size, min_samples))

    return cells.select(by, "pid", "x", "y", "z").groupBy(by).applyInPandas(run, f"{by} {kind}, pid long, x double, y double, z double, label int")


def label_points(points: DataFrame, labelled: DataFrame, by: str = "site_id") -> DataFrame:
    """points with the label of the nearest labelled voxel point, the smaller pid on ties. A voxel point is a segment without
    length, so points and voxel points travel as in the search of segments."""
    ends = labelled.select(by, F.col("pid").alias("seg_id"), *[F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in "xyz"], F.lit(0.0).alias("hw"))
    near = nearest_segment(points.select("pid", by, "x", "y", "z"), ends, [by]).select("pid", F.col("seg_id").alias("near"))
    return points.join(near.join(labelled.select(F.col("pid").alias("near"), "label"), "near").select("pid", "label"), "pid")


def drop_small(points: DataFrame, least: int = MIN_INSTANCE_POINTS, by: str = "site_id") -> DataFrame:
    """Labels with fewer points become noise."""
    sizes = points.groupBy(by, "label").agg(F.count("*").alias("label__n"))
    kept = F.when(F.col("label__n") >= least, F.col("label")).otherwise(F.lit(-1))
    return points.join(sizes, [by, "label"]).withColumn("label", kept).drop("label__n")


def renumber(points: DataFrame, by: str = "site_id") -> DataFrame:
    """Labels from 0 by size, the largest first, the larger old label on ties; noise stays -1."""
    sizes = points.filter("label >= 0").groupBy(by, "label").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.desc("label"))) - 1
    new = sizes.select(by, "label", place.alias("label__new"))
    return points.join(new, [by, "label"], "left").withColumn("label", F.coalesce("label__new", F.lit(-1))).drop("label__new")


def split_parallel(labelled: DataFrame, eps: float = 0.03, min_points: int = 20, min_split: int = 200, by: str = "site_id") -> DataFrame:
    """Instances that lie side by side, split by their distance across the main axis (see sections).

    Parts with fewer than min_split points become noise; an instance with fewer than two other parts, or fewer than
    2 * min_points points, stays as it is. The first part, by least pid, keeps the label; the others get the next ones.
    """
    keys = [by, "label"]
    points = written(labelled.select(*keys, "pid", "x", "y", "z"), "split-points")
    large = points.filter("label >= 0").groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * min_points).select(*keys)
    split = written(sections.parts(points.join(large, keys), eps, min_points, min_split, keys), "split-parts")
    top = points.groupBy(by).agg(F.max("label").alias("top"))
    number = F.row_number().over(Window.partitionBy(by).orderBy("label", "part"))
    fresh = split.filter("part > 0").select(*keys, "part").distinct().withColumn("nth", number).join(top, by)
    fresh = fresh.select(*keys, "part", (F.col("top") + F.col("nth")).alias("fresh"))
    joined = points.join(split, [*keys, "pid"], "left").join(fresh, [*keys, "part"], "left")
    label = F.when(F.col("part") < 0, F.lit(-1)).otherwise(F.coalesce("fresh", "label"))
    return joined.withColumn("label", label.cast("int")).select(*keys, "pid", "x", "y", "z")


def label_counts(points: DataFrame) -> DataFrame:
    """site_id, label, n and whether the label is noise."""
    rows = points.groupBy("site_id", "label").agg(F.count("*").alias("n"))
    return rows.withColumn("is_noise", F.col("label") < 0)
