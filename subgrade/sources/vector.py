"""Registry layers from GML, areas from GeoJSON, sidecar documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from subgrade.operators.segments import FEATURE_SCHEMA

_POSITIONS = r"(?s)<(?:\w+:)?pos(?:List)?(?:\s[^>]*)?>([^<]*)<"


def _corners(text: Column, size: Column) -> Column:
    """A part's vertices from its numbers; a height that is not given is 0."""
    n = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    count = F.floor(F.size(n) / size).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i, k: F.try_element_at(n, (i * size + k + 1).cast("int"))
    return F.transform(places, lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), F.when(size == 3, at(i, 2)).otherwise(F.lit(0.0)).alias("z")))


def read_layer(spark: SparkSession, path: str, layer: str, geometry: str = "geometri") -> DataFrame | None:
    """One layer's features as FEATURE_SCHEMA, None where the file has no such layer; features without geometry have no parts."""
    reader = spark.read.format("xml").option("rowTag", layer).option("ignoreNamespace", True).option("inferSchema", False).option("attributePrefix", "_")
    found = reader.load(path).schema
    if not found.fields:
        return None
    # as text, the geometry is its own markup
    schema = StructType([StructField(f.name, StringType()) for f in found.fields])
    rows = reader.schema(schema).load(path)
    names = [f.name for f in schema.fields if f.name != geometry]
    shape = F.col(geometry) if geometry in rows.columns else F.lit(None).cast("string")
    size = F.coalesce(F.nullif(F.regexp_extract(shape, r'srsDimension="(\d)"', 1), F.lit("")).cast("int"), F.lit(3))
    kind = F.nullif(F.regexp_extract(shape, r"(Point|MultiCurve|MultiLineString|LineString|Curve|MultiSurface|Polygon)", 1), F.lit(""))
    entries = [F.struct(F.lit(n.lstrip("_")).alias("key"), F.col(f"`{n}`").alias("value")) for n in names]
    attrs = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())) if entries else F.create_map().cast("map<string,string>")
    parts = F.when(shape.isNotNull(), F.transform(F.regexp_extract_all(shape, F.lit(_POSITIONS), 1), lambda t: _corners(t, size)))
    id_ = F.coalesce(*[F.col(f"`{n}`") for n in names if n in ("_id", "id", "_fid")], F.sha2(F.concat_ws("|", shape, F.to_json(attrs)), 256))
    return rows.select(F.lit(layer).alias("layer"), id_.alias("feature_id"), kind.alias("geom_type"), parts.alias("parts"), attrs.alias("attrs"))


def read_layers(spark: SparkSession, path: str, layers: list[str] | tuple[str, ...], geometry: str = "geometri") -> DataFrame:
    """All layers that the file has; those it lacks are left out."""
    found = [f for f in (read_layer(spark, path, name, geometry) for name in layers) if f is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FEATURE_SCHEMA)


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """area_name, area_number, tx, ty, tz of a GeoJSON's points."""
    schema = "features array<struct<properties:struct<name:string>,geometry:struct<coordinates:array<double>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    name = F.col("f.properties.name")
    number = F.regexp_extract(name, r"(\d+)", 1).try_cast("int")
    return rows.select(name.alias("area_name"), number.alias("area_number"), *[F.coalesce(F.try_element_at(c, F.lit(i + 1)), F.lit(0.0)).alias(n) for i, n in enumerate(("tx", "ty", "tz"))])


def area_offset(areas: DataFrame, name: str) -> tuple[float, float, float]:
    row = areas.filter(F.col("area_name") == name).select("tx", "ty", "tz").first()
    if row is None:
        raise LookupError(f"no area {name!r}")
    return tuple(row)


def read_ground(spark: SparkSession, path: str) -> DataFrame:
    """path, ground_z, method of sidecars; a broken one has a null ground_z."""
    rows = spark.read.schema("ground_z double, method string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "ground_z", F.coalesce("method", F.lit("loaded from cache")).alias("method"))


def read_trench(spark: SparkSession, path: str) -> DataFrame:
    """path, mode, vertices of sidecars with at least three vertices."""
    rows = spark.read.schema("vertices array<array<double>>, mode string").option("multiLine", True).json(path)
    return rows.filter("size(vertices) >= 3").select(F.col("_metadata.file_path").alias("path"), "mode", "vertices")
