"""Clusters of points in the plane across an instance's main axis, by density.

All of a long pipe lies over a few cells of that plane, so no group of points is compared pair by pair. Cells are so small
that two points of one are within reach; a cell with enough points has nothing but core points. What is left to count
are the points of sparse cells, fewer than min_points in each, against which the points of the cells around are held
where they are. Whether two dense cells touch is found by halving both into ever smaller squares, of which only those at
the very distance are opened.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from subgrade.tables import written

#: Squares are opened into FAN x FAN (a power of two) and their points compared after LEVELS - 1 openings.
FAN_BITS, LEVELS = 4, 4
_MARGIN = 1e-9
_PAIRS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]


@F.pandas_udf(StructType([StructField(e + c, DoubleType()) for e in "ab" for c in "xyz"]))
def _minor_axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """The second and third principal axis of each covariance matrix."""
    m = np.nan_to_num(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]], dtype=float).transpose(2, 0, 1))
    _, vectors = np.linalg.eigh(m)
    return pd.DataFrame(np.concatenate([vectors[:, :, 1], vectors[:, :, 0]], axis=1), columns=["ax", "ay", "az", "bx", "by", "bz"])


def across(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with u, v: the second and third principal component of the instance that keys name, from its moments."""
    moments = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a, b in _PAIRS])
    axes = moments.select(*keys, "mx", "my", "mz", _minor_axes(*[a + b for a, b in _PAIRS]).alias("e"))
    joined = points.join(axes, keys)
    parts = {to: sum(((F.col(c) - F.col(f"m{c}")) * F.col(f"e.{e}{c}") for c in "xyz"), F.lit(0.0)) for to, e in (("u", "a"), ("v", "b"))}
    return joined.withColumns(parts).drop("mx", "my", "mz", "e")


def _shifted(df: DataFrame, keys: list[str], offsets: list[tuple[int, int]], *columns) -> DataFrame:
    """df once for each offset, at the cell that lies there."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    dealt = df.select("*", each.alias("o"))
    return dealt.select(*keys, *columns, (F.col("cu") + F.col("o.i")).alias("cu"), (F.col("cv") + F.col("o.j")).alias("cv"))


def _within(s, eps: float):
    return (s["u"] - F.col("u")) ** 2 + (s["v"] - F.col("v")) ** 2 <= eps * eps


def _touching(rows: DataFrame, pairs: DataFrame, side: float, eps: float, keys: list[str]) -> DataFrame:
    """The pairs (keys, cu, cv, du, dv) of dense cells that have two points within eps. rows: their points."""
    roots = [*keys, "cu", "cv", "du", "dv"]
    now = pairs.select(*roots, F.col("cu").alias("pu"), F.col("cv").alias("pv"), F.col("du").alias("qu"), F.col("dv").alias("qv"))
    found = pairs.select(*roots).filter("false")
    for level in range(1, LEVELS + 1):
        now = written(now, "section-pairs")
        if now.isEmpty():
            break
        up, here = FAN_BITS * (LEVELS - level + 1), FAN_BITS * (LEVELS - level)
        width, last = side / 2 ** (FAN_BITS * level), level == LEVELS
        nodes = now.select(*keys, F.col("pu").alias("nu"), F.col("pv").alias("nv")).unionByName(now.select(*keys, F.col("qu").alias("nu"), F.col("qv").alias("nv"))).distinct()
        inside = F.struct("u", "v") if last else F.struct(F.shiftright("fu", here).alias("u"), F.shiftright("fv", here).alias("v"))
        opened = rows.select(*keys, F.shiftright("fu", up).alias("nu"), F.shiftright("fv", up).alias("nv"), inside.alias("s")).join(nodes, [*keys, "nu", "nv"], "left_semi")
        opened = written(opened.groupBy(*keys, "nu", "nv").agg(F.collect_set("s").alias("s")), "section-squares")
        met = now.join(opened.select(*keys, F.col("nu").alias("pu"), F.col("nv").alias("pv"), F.col("s").alias("ps")), [*keys, "pu", "pv"])
        met = met.join(opened.select(*keys, F.col("nu").alias("qu"), F.col("nv").alias("qv"), F.col("s").alias("qs")), [*keys, "qu", "qv"])

        def far(a, b, extra: int):
            if last:
                return (a["u"] - b["u"]) ** 2 + (a["v"] - b["v"]) ** 2
            du, dv = (F.greatest(F.abs(a[c] - b[c]) + extra, F.lit(0)) * F.lit(width) for c in "uv")
            return du**2 + dv**2

        sure = eps * eps * (1 if last else 1 - _MARGIN)
        meets = F.exists("ps", lambda a: F.exists("qs", lambda b: far(a, b, 1) <= sure))
        linked = written(met.filter(meets).select(*roots).distinct(), "section-links")
        found = found.unionByName(linked)
        if last:
            break
        open_ = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("qs", lambda b: far(a, b, -1) <= eps * eps * (1 + _MARGIN)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        left = met.join(linked, roots, "left_anti").select(*roots, F.explode(open_).alias("x"))
        now = left.select(*roots, F.col("x.a.u").alias("pu"), F.col("x.a.v").alias("pv"), F.col("x.b.u").alias("qu"), F.col("x.b.v").alias("qv"))
    return found.distinct()


def _numbered(cells: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cu, cv, cluster of each core cell: cells that links join, numbered by their least pid. A group holds the cells of
    one instance's plane, however many points lie over them."""
    kinds = dict(cells.dtypes)

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        at = {k: i for i, k in enumerate(zip(nodes["cu"], nodes["cv"]))}
        parent = list(range(len(at)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for cu, cv, du, dv in edges[["cu", "cv", "du", "dv"]].itertuples(index=False):
            parent[root(at[cu, cv])] = root(at[du, dv])
        roots = pd.Series([root(i) for i in range(len(at))], index=nodes.index)
        first = nodes["pid"].groupby(roots).transform("min")
        return nodes.assign(cluster=np.unique(first, return_inverse=True)[1])[[*keys, "cu", "cv", "cluster"]]

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "cu long, cv long, cluster long"])
    return cells.groupBy(*keys).cogroup(links.groupBy(*keys)).applyInPandas(run, schema)


def reach_clusters(points: DataFrame, eps: float, min_points: int, keys: list[str]) -> DataFrame:
    """keys, pid, cluster of points (keys, pid, u, v) that a cluster reaches: those that have min_points within eps
    (themselves included), chained within eps, and what lies within eps of them; that goes to the first of several
    clusters. Clusters are numbered from 0 by their least core pid. pid names a point of its instance."""
    side = eps / math.sqrt(2) * (1 - _MARGIN)
    bits = FAN_BITS * LEVELS
    fine = {f"f{c}": F.floor(F.col(c) / side * 2**bits) for c in "uv"}
    placed = points.select(*keys, "pid", "u", "v").withColumns(fine).withColumns({f"c{c}": F.shiftright(f"f{c}", bits) for c in "uv"})
    cell = [*keys, "cu", "cv"]
    placed = written(placed, "section-points")
    sizes = written(placed.groupBy(*cell).agg(F.count("*").alias("held")), "section-cells")
    rows = placed.join(sizes, cell)
    sparse = rows.filter(F.col("held") < min_points)
    ring = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]

    near = _shifted(sparse, keys, ring, F.struct(F.col("pid").alias("q"), "u", "v").alias("s")).groupBy(*cell).agg(F.collect_list("s").alias("near"))
    met = placed.join(near, cell).select(*keys, F.explode(F.filter("near", lambda s: _within(s, eps))).alias("s"))
    counts = met.groupBy(*keys, F.col("s.q").alias("pid")).agg(F.count("*").alias("around"))
    judged = rows.join(counts, [*keys, "pid"], "left")
    judged = written(judged.withColumn("core", (F.col("held") >= min_points) | (F.coalesce("around", F.lit(0)) >= min_points)).drop("around"), "section-judged")

    held = F.struct(F.col("pid").alias("q"), "u", "v", "core", F.col("cu").alias("du"), F.col("cv").alias("dv")).alias("s")
    near = _shifted(judged.filter(F.col("held") < min_points), keys, ring, held).groupBy(*cell).agg(F.collect_list("s").alias("near"))
    met = judged.filter("core").join(near, cell).select(*cell, F.explode(F.filter("near", lambda s: _within(s, eps))).alias("s"))
    touched = written(met.select(*cell, "s.q", "s.core", "s.du", "s.dv").distinct(), "section-touched")

    dense = sizes.filter(F.col("held") >= min_points).select(*cell)
    half = [(i, j) for i, j in ring if (i, j) > (0, 0)]
    pairs = _shifted(dense, keys, half, F.col("cu").alias("du"), F.col("cv").alias("dv")).join(dense, cell)
    links = touched.filter("core").select(*cell, "du", "dv").distinct()
    links = links.unionByName(_touching(judged.filter(F.col("held") >= min_points), pairs, side, eps, keys))
    cores = judged.filter("core").groupBy(*cell).agg(F.min("pid").alias("pid"))
    clusters = written(_numbered(cores, links, keys), "section-clusters")
    inner = judged.filter("core").join(clusters, cell).select(*keys, "pid", "cluster")
    rim = touched.filter("not core").join(clusters, cell).groupBy(*keys, F.col("q").alias("pid")).agg(F.min("cluster").alias("cluster"))
    return inner.unionByName(rim)


def parts(points: DataFrame, eps: float, min_points: int, min_split: int, keys: list[str]) -> DataFrame:
    """keys, pid, part of the points of every instance that has several clusters of at least min_split points: the clusters
    from 0, -1 for all other points. Instances that have not are left out."""
    found = written(reach_clusters(across(points, keys), eps, min_points, keys), "section-found")
    sizes = found.groupBy(*keys, "cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_split)
    everyone = Window.partitionBy(*keys)
    kept = sizes.withColumns({"part": F.row_number().over(everyone.orderBy("cluster")) - 1, "several": F.count("*").over(everyone) > 1}).filter("several")
    split = kept.select(*keys).distinct()
    own = found.join(kept.select(*keys, "cluster", "part"), [*keys, "cluster"]).select(*keys, "pid", "part")
    return points.select(*keys, "pid").join(split, keys).join(own, [*keys, "pid"], "left").withColumn("part", F.coalesce("part", F.lit(-1)))
