"""Nearest segments and nearest points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from subgrade.functions.geometry import Seg, offsets
from subgrade.operators import packed
from subgrade.tables import written

FIELDS = ("seg_id", *packed.ENDS)
#: What bounds give way for the rounding of their own arithmetic.
SLACK = 1e-9
C = ("cx", "cy", "cz")


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _grouped(df: DataFrame, match: list[str], kinds: dict[str, str], *columns: str) -> DataFrame:
    """columns, and g: the match columns as one text, in the types that kinds has; rows with a null there match nothing."""
    known = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in match])) if match else df
    g = F.to_json(F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in match])) if match else F.lit("")
    return known.select(*columns, g.alias("g"))


def _search(points: DataFrame, segments: DataFrame, match: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    kinds = dict(segments.dtypes)
    segs = written(_grouped(segments, match, kinds, *FIELDS), "nearest-segments")
    at = _grouped(points, match, kinds, "pid", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return at, *packed.search(at, segs)


def nearest_segment(points: DataFrame, segments: DataFrame, match: list[str] | None = None) -> DataFrame:
    """points (pid, x, y, z, ...) with seg_id, dist, dist_xy, dist_z of the nearest segment; infinite where there is none.

    Equal distances go to the smaller seg_id. match: columns of both sides that have to be equal; with them a pid is told
    apart. dist**2 = dist_xy**2 + dist_z**2. The search is exact; see packed.
    """
    match = match or []
    kinds = dict(segments.dtypes)
    _, found, _ = _search(points, segments, match)
    keyed = points.withColumn("g", F.to_json(F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in match])) if match else F.lit(""))
    far = F.lit(float("inf"))
    parts = {"dist": F.coalesce(F.sqrt("d2"), far), "dist_xy": F.coalesce(F.sqrt("xy2"), far), "dist_z": F.coalesce("dz", far)}
    joined = keyed.join(packed.least(found), ["pid", "g"], "left")
    return joined.withColumns(parts).select(*[joined[c] for c in points.columns], "seg_id", *parts)


def nearest_distances(points: DataFrame, segments: DataFrame, match: list[str]) -> DataFrame:
    """pid, the match columns and dist of points that have a segment, without their other columns: a row for each row."""
    kinds = dict(segments.dtypes)
    _, found, _ = _search(points, segments, match)
    # the values that occur, by g
    named = points.select(*[F.col(c).cast(kinds[c]).alias(c) for c in match]).distinct().withColumn("g", F.to_json(F.struct(*match)))
    return found.join(named, "g").select("pid", *match, F.sqrt("d2").alias("dist"))


def comparisons(points: DataFrame, segments: DataFrame, match: list[str] | None = None) -> int:
    """How many distances of a point, or of a box of points, and a segment the search tells."""
    made = _search(points, segments, match or [])[2]
    return made.agg(F.sum("made")).first()[0] or 0


def _extent(*frames: DataFrame) -> float:
    """The diagonal of the box around all the frames' coordinates x, y, z; no two of them are farther apart."""
    rows = reduce(DataFrame.unionByName, frames)
    low, high = [f"low_{c}" for c in "xyz"], [f"high_{c}" for c in "xyz"]
    box = rows.agg(*[F.min(c).alias(n) for c, n in zip("xyz", low)], *[F.max(c).alias(n) for c, n in zip("xyz", high)]).first()
    return sum(((box[h] or 0.0) - (box[n] or 0.0)) ** 2 for n, h in zip(low, high)) ** 0.5


def nearest_points(queries: DataFrame, points: DataFrame, k: int, cell: float, match: list[str] | None = None, flat: bool = False, growth: float = 3.0) -> DataFrame:
    """qid, pid, d2, px, py, pz, rank: the k nearest points of each query, in 3D or (flat) in the plane; ties to the smaller pid.

    Queries and points share cells as wide as the radius; a query is settled once it has k points within the radius, and
    else goes to the next round with a wider one, until the radius covers everything: there, fewer than k are all there are.
    """
    match = match or []
    left = written(queries.select("qid", *match, *[F.col(c).alias(f"q{c}") for c in "xyz"]), "nearest-queries")
    p = written(points.select("pid", *match, *[F.col(c).alias(f"p{c}") for c in "xyz"]), "nearest-points")
    diff = [(F.col(f"q{c}") - F.col(f"p{c}")) for c in ("xy" if flat else "xyz")]
    d2 = reduce(lambda a, b: a + b, [x * x for x in diff])
    by = Window.partitionBy("qid")
    far = _extent(*[t.select(*[F.col(f"{n}{c}").alias(c) for c in "xyz"]) for t, n in ((left, "q"), (p, "p"))])
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    done, size = [], cell
    while True:
        here = left.withColumn("ix", around).withColumn("iy", around)
        here = here.withColumns({"cx": F.floor(F.col("qx") / size) + F.col("ix"), "cy": F.floor(F.col("qy") / size) + F.col("iy")})
        there = p.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
        near = here.join(there, [*match, "cx", "cy"]).withColumn("d2", d2).filter(F.col("d2") <= size * size)
        ranked = near.withColumn("rank", F.row_number().over(by.orderBy("d2", "pid"))).filter(F.col("rank") <= k)
        best = written(ranked.withColumn("n", F.count("*").over(by)).select("qid", "pid", "d2", "px", "py", "pz", "rank", "n"), "nearest-best")
        if size >= far:
            done.append(best)
            break
        done.append(best.filter(F.col("n") == k))
        left = written(left.join(best.filter(F.col("rank") == k).select("qid"), "qid", "left_anti"), "nearest-left")
        if left.isEmpty():
            break
        size *= growth
    return reduce(DataFrame.unionByName, done).drop("n")


def nearest_of_many(queries: DataFrame, points: DataFrame, match: list[str] | None = None, size: float = 0.25, chunk: int = 256) -> DataFrame:
    """queries (x, y, z, ...; far more than points) with dev, dev_xy, dev_z to the nearest point in 3D, ties to the smaller
    pid; NaN where no point matches.

    Queries lie in cubes. The point nearest to a cube's centre bounds how far the nearest of any query of the cube can be,
    so a cube meets the points within that reach only, in cells as wide as the reach. The points of a cube are dealt over
    arrays of about `chunk`, so a crowded cube is many rows and no group.
    """
    match = match or []
    keys = [*match, *C]
    at = queries.withColumns({n: F.floor(F.col(c) / size) for c, n in zip("xyz", C)})
    centres = at.select(*keys).distinct().withColumns({c: (F.col(n) + 0.5) * size for c, n in zip("xyz", C)})
    cubes = written(centres.withColumn("qid", F.to_json(F.struct(*keys))), "many-cubes")
    first = nearest_points(cubes, points, 1, 4 * size, match).select("qid", (F.sqrt("d2") * (1 + SLACK) + size * 3**0.5 + SLACK).alias("reach"))
    level = F.greatest(F.ceil(F.log2(F.col("reach") / size)), F.lit(0)).cast("int")
    near = written(cubes.join(first, "qid").drop("qid").withColumn("level", level), "many-reaches")
    top = near.agg(F.max("level")).first()[0] or 0
    width = F.lit(size) * F.pow(F.lit(2.0), "level")
    cell = lambda c: F.floor(F.col(c) / width)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = near.withColumn("ix", around).withColumn("iy", around).withColumns({"kx": cell("x") + F.col("ix"), "ky": cell("y") + F.col("iy")})
    there = points.select("pid", *match, *[F.col(c).alias(f"p{c}") for c in "xyz"]).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    there = there.withColumns({"kx": cell("px"), "ky": cell("py")})
    d2 = _sum([(F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"])
    met = near.join(there, [*match, "level", "kx", "ky"]).filter(d2 <= F.col("reach") ** 2).select(*keys, "pid", "px", "py", "pz")
    met = written(met, "many-met")
    parts = met.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = met.join(parts, keys).groupBy(*keys, F.pmod(F.xxhash64("pid"), "parts").alias("part"))
    lists = dealt.agg(F.collect_list(F.struct("pid", "px", "py", "pz")).alias("near"))
    apart = lambda p: F.struct(_sum([(F.col(c) - p[f"p{c}"]) * (F.col(c) - p[f"p{c}"]) for c in "xyz"]).alias("d2"), p["pid"].alias("pid"), *[p[f"p{c}"].alias(f"p{c}") for c in "xyz"])
    best = at.join(lists, keys, "left").withColumn("best", F.array_min(F.transform("near", apart)))
    found = best.groupBy(*keys, *[c for c in queries.columns if c not in keys]).agg(F.min("best").alias("best"))
    flat = F.sqrt(_sum([(F.col(c) - F.col(f"best.p{c}")) ** 2 for c in "xy"]))
    parts_of = {"dev": F.sqrt("best.d2"), "dev_xy": flat, "dev_z": F.abs(F.col("z") - F.col("best.pz"))}
    return found.withColumns({n: F.coalesce(v, F.lit(float("nan"))) for n, v in parts_of.items()}).select(*queries.columns, *parts_of)


def pick(hit: tuple[float, float, float], components: DataFrame, segments: DataFrame, near_component: float = 0.20, near_segment: float = 0.30) -> DataFrame:
    """One row: the feature nearest to a hit point. A component wins if it is strictly nearer and within its radius, else
    the segment if within its own; otherwise kind and id are null."""
    x, y, z = (F.lit(float(v)) for v in hit)
    dc = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 + (F.col("z") - z) ** 2)
    c = components.select(dc.alias("cd"), F.col("comp_id").alias("cid")).agg(F.min("cd").alias("cd"), F.min_by("cid", F.struct("cd", "cid")).alias("cid"))
    xy2, dz = offsets(Seg.of(F.col), x, y, z)
    s = segments.select(F.sqrt(xy2 + dz * dz).alias("sd"), F.col("seg_id").alias("sid")).agg(F.min("sd").alias("sd"), F.min_by("sid", F.struct("sd", "sid")).alias("sid"))
    wins = (F.col("cd") < F.coalesce("sd", F.lit(float("inf")))) & (F.col("cd") < near_component)
    kind = F.when(wins, "component").when(F.col("sd") < near_segment, "segment")
    chosen: Callable[[str, str], Column] = lambda a, b: F.when(kind == "component", F.col(a)).when(kind == "segment", F.col(b))
    return c.crossJoin(s).select(kind.alias("kind"), chosen("cid", "sid").alias("id"), chosen("cd", "sd").alias("distance"))
