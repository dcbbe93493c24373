"""The ground surface: top samples of cells, best-fit plane, local weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from subgrade.functions.dims import GROUND_CELL, GROUND_PERCENTILE, IDW_NEIGHBOURS
from subgrade.operators.nearest import nearest_points


def top_cells(points: DataFrame, cell: float = GROUND_CELL, share: float = GROUND_PERCENTILE) -> DataFrame:
    """Centre and percentile z of each cell."""
    cells = points.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    tops = cells.agg(F.percentile("z", F.lit(share)).alias("z"))
    return tops.select("cx", "cy", ((F.col("cx") + 0.5) * cell).alias("x"), ((F.col("cy") + 0.5) * cell).alias("y"), "z")


def _moments(rows: DataFrame):
    xx, yy, xy, xz, yz = (F.covar_pop(a, b).alias(a + b) for a, b in (("x", "x"), ("y", "y"), ("x", "y"), ("x", "z"), ("y", "z")))
    return rows.agg(xx, yy, xy, xz, yz, F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count("*").alias("n")).first()


def solve(m) -> tuple[float, float, float] | None:
    """a, b, c of z = ax + by + c from moments about the means; None without 3 points or with all in one line."""
    det = (m.xx * m.yy - m.xy**2) if m.n >= 3 else 0.0
    if abs(det) < 1e-18:
        return None
    a, b = (m.xz * m.yy - m.yz * m.xy) / det, (m.yz * m.xx - m.xz * m.xy) / det
    return a, b, m.mz - a * m.mx - b * m.my


def residual(plane: tuple[float, float, float]) -> Column:
    a, b, c = plane
    return F.col("z") - (F.col("x") * a + F.col("y") * b + c)


def fit_plane(points: DataFrame, rounds: int = 3, sigmas: float = 2.0) -> tuple[float, float, float] | None:
    return robust_fit(points, rounds, sigmas)[0]


def robust_fit(points: DataFrame, rounds: int = 3, sigmas: float = 2.0) -> tuple[tuple[float, float, float] | None, DataFrame]:
    """The plane, and the points that are kept by it. Least squares over all points, then over those within `sigmas` deviations of the last plane; each round is one
    aggregation, of which a handful of sums reach the driver."""
    plane, kept, inside = None, points, None
    for _ in range(rounds):
        m = _moments(kept)
        found = solve(m)
        if found is None or m.n == inside:
            break
        plane, inside = found, m.n
        s = kept.agg(F.stddev_pop(residual(plane))).first()[0]
        if not s or s < 1e-9:
            break
        kept = points.filter(F.abs(residual(plane)) <= sigmas * s)
    return plane, kept


def idw(queries: DataFrame, samples: DataFrame, k: int = IDW_NEIGHBOURS, cell: float = GROUND_CELL) -> DataFrame:
    """qid, ground_z: samples' z weighted by the inverse squared distance of the k nearest; one nearer than 1e-9 decides."""
    near = nearest_points(queries, samples, k, 2 * cell, flat=True)
    w = 1 / F.nullif("d2", F.lit(0.0))
    exact = F.max(F.when((F.col("rank") == 1) & (F.sqrt("d2") < 1e-9), F.col("pz")))
    return near.groupBy("qid").agg(F.coalesce(exact, F.sum(w * F.col("pz")) / F.sum(w)).alias("ground_z"))


def ground_scalars(samples: DataFrame, points: DataFrame, share: float = GROUND_PERCENTILE) -> DataFrame:
    """One row: ground_z (the samples' median, else a percentile of all points), n_samples, z_spread, and the fitted plane's
    slope_pct and plane_rms over the samples it keeps; null without a plane."""
    plane, kept = robust_fit(samples)
    told = samples.agg(F.median("z").alias("m"), F.count("*").alias("n_samples"), (F.max("z") - F.min("z")).alias("z_spread"))
    level = ground_level(points, share=share).select(F.col("ground_z").alias("p"))
    if plane is None:
        fit = told.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in ("slope_pct", "plane_rms")])
    else:
        fit = kept.agg(F.lit(100 * (plane[0] ** 2 + plane[1] ** 2) ** 0.5).alias("slope_pct"), F.sqrt(F.avg(residual(plane) ** 2)).alias("plane_rms"))
    # one row each
    return told.crossJoin(level).crossJoin(fit).select(F.coalesce("m", "p").alias("ground_z"), "n_samples", "z_spread", "slope_pct", "plane_rms")


def ground_at(queries: DataFrame, samples: DataFrame, plane: tuple[float, float, float] | None, level: float) -> DataFrame:
    """queries (qid, x, y, z) with ground_z: from the samples around; where there are none from the plane; else the level."""
    near = idw(queries, samples)
    a, b, c = plane or (0.0, 0.0, level)
    return queries.join(near, "qid", "left").withColumn("ground_z", F.coalesce("ground_z", F.col("x") * a + F.col("y") * b + c))


def ground_level(points: DataFrame, picked: DataFrame | None = None, share: float = GROUND_PERCENTILE) -> DataFrame:
    """One row ground_z: the mean of picked points, else a percentile of all."""
    level = points.agg(F.percentile("z", F.lit(share)).alias("p"))
    if picked is None:
        return level.select(F.col("p").alias("ground_z"))
    return level.crossJoin(picked.agg(F.avg("z").alias("m"))).select(F.coalesce("m", "p").alias("ground_z"))
