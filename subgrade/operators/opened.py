"""A site opened from its paths: checks, area, offset, cloud, registry and instances, as DataFrames in local coordinates."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyarrow import fs

from subgrade.functions import scalars as S
from subgrade.functions.dims import COMPONENT_TO_LINE, CROP_RADIUS, LINE_LAYERS
from subgrade.operators import segments as G
from subgrade.operators.site import SiteSession
from subgrade.sources import clouddata, discovery, gml, vector
from subgrade.sources.stores import store_of

PREFIX = "spark.subgrade.site."


@dataclass
class SiteConfig:
    """Where a site's files are, and how its cloud is cropped. from_session reads spark.subgrade.site.<name> settings."""

    cloud: str = ""
    areas: str = ""
    registry: str = ""
    crop_mode: str = "rect"
    crop_radius: float = CROP_RADIUS
    buffer: float = 2.0

    @classmethod
    def from_session(cls, spark: SparkSession, **given) -> "SiteConfig":
        """The session's settings, those given instead of them."""
        found = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(cls)}
        values = {k: v for k, v in (found | {k: v for k, v in given.items() if v is not None}).items() if v is not None}
        for k in ("crop_radius", "buffer"):
            if k in values:
                values[k] = float(values[k])
        return cls(**values)

    def check(self, with_registry: bool = True) -> None:
        """FileNotFoundError that names every path that isn't there; ValueError for an unknown crop mode."""
        if self.crop_mode not in ("rect", "circle"):
            raise ValueError(f"crop_mode is rect or circle, not {self.crop_mode!r}")
        wanted = {"cloud": self.cloud, "areas": self.areas} | ({"registry": self.registry} if with_registry else {})
        missing = [f"{n} = {p or '(not set)'}" for n, p in wanted.items() if not p or _absent(p)]
        if missing:
            raise FileNotFoundError("missing: " + ", ".join(missing))


def _absent(path: str) -> bool:
    store, at = store_of(path)
    return store.get_file_info(at).type == fs.FileType.NotFound


@dataclass
class OpenedSite:
    """area, the offset from local to global coordinates, the session, the crop's centre in global coordinates, and the
    instances' files (None where there are none)."""

    area: str
    offset: tuple[float, float, float]
    session: SiteSession
    centre: tuple[float, float]
    crop_radius: float
    instances: DataFrame | None


def area_of(spark: SparkSession, cloud: str) -> str:
    """Area<n> from a cloud's folder or name; ValueError where neither tells."""
    parts = cloud.rstrip("/").split("/")
    row = spark.range(1).select(S.area_number(F.lit(parts[-2] if len(parts) > 1 else ""), F.lit(parts[-1])).alias("n")).first()
    if row["n"] is None:
        raise ValueError(f"no area in {cloud!r}")
    return f"Area{row['n']}"


def to_local(features: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    """features with their parts in local coordinates. A missing height stays the sentinel, so depths can be resolved."""
    def moved(p):
        x, y, z = G.to_local(p["x"], p["y"], p["z"], *offset)
        return F.struct(x.alias("x"), y.alias("y"), F.when(p["z"] == -99.0, p["z"]).otherwise(z).alias("z"))

    return features.withColumn("parts", F.transform("parts", lambda part: F.transform(part, moved)))


def open_site(spark: SparkSession, config: SiteConfig | None = None, with_registry: bool = True, with_instances: bool = True, **given) -> OpenedSite:
    """The site that config (else the session's settings, with those given) names.

    Errors are defined: FileNotFoundError for paths, ValueError for a cloud without an area in its name or a crop mode,
    LookupError for an area that the reference has no origin of. A crop to a circle about the cloud's centroid drops points; the rectangle keeps all.
    """
    config = config or SiteConfig.from_session(spark, **given)
    config.check(with_registry)
    area = area_of(spark, config.cloud)
    offset = vector.area_offset(vector.read_areas(spark, config.areas), area)
    points = clouddata.scan(spark, "ply", config.cloud)
    middle = points.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    radius = config.crop_radius if config.crop_mode == "circle" else 0.0
    if radius > 0:
        points = G.crop_circle(points, radius)
    empty = spark.createDataFrame([], G.FEATURE_SCHEMA)
    features = components = empty
    if with_registry:
        every = to_local(gml.read_features(spark, config.registry, [*LINE_LAYERS, *COMPONENT_TO_LINE]), offset)
        features, components = every.filter(F.col("layer").isin(*LINE_LAYERS)), every.filter(F.col("layer").isin(*COMPONENT_TO_LINE))
    first = F.element_at(F.element_at("parts", 1), 1)
    placed = components.filter(F.size("parts") > 0).select("layer", F.col("feature_id").alias("comp_id"), *[first[c].alias(c) for c in "xyz"], "attrs")
    found = None
    if with_instances:
        parent = config.cloud.rstrip("/").rsplit("/", 1)[0]
        try:
            found = discovery.instances_of(discovery.list_files(spark, parent), config.cloud)
        except LookupError:
            found = None
    centre = ((middle["x"] or 0.0) + offset[0], (middle["y"] or 0.0) + offset[1])
    return OpenedSite(area, offset, SiteSession(spark, points, features, placed, config.buffer), centre, radius, found)
