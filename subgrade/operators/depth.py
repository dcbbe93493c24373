"""Missing depths, resolved by an ordered fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subgrade.functions.dims import FEATURE_MEAN, GROUND, INDICATIVE, LAYER_MEAN, NO_DEPTH, REGISTERED, SENTINEL_Z
from subgrade.operators.ground import ground_at

#: Up to what height a depth is missing in the overview, and how far beyond the cloud's span heights may lie.
OVERVIEW_MISSING, OVERVIEW_MARGIN = -98.0, 2.0
PIPE_LEVELS = (REGISTERED, INDICATIVE, FEATURE_MEAN, GROUND)
COMPONENT_LEVELS = (REGISTERED, LAYER_MEAN, GROUND)


def is_missing(z: Column, at_most: float | None = None) -> Column:
    """z equals the sentinel, or with at_most is no larger than that."""
    return (z <= at_most) if at_most is not None else (z == SENTINEL_Z)


def resolve(
    rows: DataFrame, ground: Column, part: list[str], levels: tuple[int, ...] = PIPE_LEVELS, at_most: float | None = None,
    indicative_mm: str | None = "indicative_mm", layer_mean: str | None = None, held: tuple[Column, Column] | None = None,
) -> DataFrame:
    """rows with z resolved and depth_source, the level that gave it.

    The levels in order: the registered z; ground less the indicative depth; the mean of the part's own registered z;
    the mean of the parent layer; the ground. held limits what was filled in to a range.
    """
    missing = is_missing(F.col("z"), at_most)
    known = F.when(~missing, F.col("z"))
    values = {
        REGISTERED: known,
        INDICATIVE: ground - F.col(indicative_mm) / 1000 if indicative_mm else F.lit(None).cast("double"),
        FEATURE_MEAN: F.avg(known).over(Window.partitionBy(*part)) if FEATURE_MEAN in levels else F.lit(None).cast("double"),
        LAYER_MEAN: F.col(layer_mean) if layer_mean else F.lit(None).cast("double"),
        GROUND: ground,
    }
    tried = rows.withColumns({f"z__{k}": values[k] for k in levels})
    z = F.coalesce(*[F.col(f"z__{k}") for k in levels], F.lit(None).cast("double"))
    source = F.coalesce(*[F.when(F.col(f"z__{k}").isNotNull(), F.lit(k)) for k in levels], F.lit(NO_DEPTH))
    if held:
        z = F.when(source == REGISTERED, z).otherwise(F.least(F.greatest(z, held[0]), held[1]))
    return tried.withColumns({"depth_source": source.cast("int"), "z": z}).drop(*[f"z__{k}" for k in levels])


def resolve_overview(rows: DataFrame, samples: DataFrame, plane: tuple[float, float, float] | None, level: float, span: tuple[float, float], part: list[str], keys: list[str], tz: float = 0.0) -> DataFrame:
    """rows (x, y, z of vertices that keys tell apart) with z over a ground that follows the samples, and depth_source.

    Heights up to OVERVIEW_MISSING count as missing, and the ground is searched for those vertices only. An indicative depth
    of 0 or less counts as none. All heights, the registered ones too, are held to the cloud's span and OVERVIEW_MARGIN
    beyond it. tz: what the vertices' registered heights have yet to lose to be local.
    """
    named = rows.withColumn("qid", F.to_json(F.struct(*keys)))
    missing = is_missing(F.col("z"), OVERVIEW_MISSING)
    lost = named.filter(missing).select("qid", "x", "y", F.lit(0.0).alias("z"))
    found = ground_at(lost, samples, plane, level).select("qid", "ground_z")
    local = named.withColumns({"z": F.when(missing, F.col("z")).otherwise(F.col("z") - tz), "is_missing": missing}).join(found, "qid", "left")
    local = local.withColumn("indicative__mm", F.when(F.col("indicative_mm") > 0, F.col("indicative_mm")))
    marked = local.withColumn("z", F.when(F.col("is_missing"), F.lit(SENTINEL_Z)).otherwise(F.when(F.col("z") == SENTINEL_Z, F.lit(SENTINEL_Z) + 1e-9).otherwise(F.col("z"))))
    out = resolve(marked, F.col("ground_z"), part, indicative_mm="indicative__mm")
    low, high = span[0] - OVERVIEW_MARGIN, span[1] + OVERVIEW_MARGIN
    return out.withColumn("z", F.least(F.greatest("z", F.lit(low)), F.lit(high))).drop("qid", "ground_z", "is_missing", "indicative__mm")


def source_counts(vertex_rows: DataFrame, by: list[str], order: str = "vid") -> DataFrame:
    """How many segments each source gave; a segment has the worse source of its ends."""
    ahead = F.lead("depth_source").over(Window.partitionBy(*by).orderBy(order))
    rows = vertex_rows.withColumn("after", ahead).filter("after is not null")
    return rows.groupBy(F.greatest("depth_source", "after").alias("depth_source")).agg(F.count("*").alias("n_segments"))


def component_layer_means(components: DataFrame, vertex_rows: DataFrame, parents: DataFrame) -> DataFrame:
    """components with layer_mean, the mean z of all vertices of the parent line layer, null where there is none."""
    means = vertex_rows.groupBy("layer").agg(F.avg("z").alias("layer_mean")).withColumnRenamed("layer", "line_layer")
    named = components.join(F.broadcast(parents), components["layer"] == parents["component_layer"], "left").drop("component_layer")
    return named.join(F.broadcast(means), "line_layer", "left")
