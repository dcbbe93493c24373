"""Queries over polygons that the given parts plant: an L of three squares, every third with a square hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.operators import polygons
from subgrade.plans import sites
from subgrade.plans.catalogue import _rounded, query
from subgrade.plans.sites import SEG, VX
from subgrade.sources import gml
from subgrade.tables import new_path

#: Rectangles that plots meet or don't; the small ones fit into holes.
RECTS = ((2.0, 2.0, 6.0, 7.0), (4.31, 5.31, 4.33, 5.33), (1.0, 7.0, 1.01, 7.01), (3.07, 6.07, 3.08, 6.08))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with rings, as sources.gml gives them: corner at (x, y) of each part, squares of side a."""
    k = F.col("p_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), (F.col("p_size").cast("double") / 5).alias("x"), (k % 97).cast("double").alias("y10"), (0.5 + (k % 7) / 10).alias("a"))
    at = lambda *xy: F.array(*[F.struct((F.col("x") + F.col("a") * i).alias("x"), (F.col("y10") / 10 + F.col("a") * j).alias("y"), F.lit(0.0).alias("z")) for i, j in xy])
    outer = at((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0))
    hole = at((0.25, 0.25), (0.25, 0.5), (0.5, 0.5), (0.5, 0.25), (0.25, 0.25))
    holed = F.col("k") % 3 == 0
    return part.select(
        F.lit("Graveforesp").alias("layer"), F.col("k").cast("string").alias("feature_id"), F.lit("MultiSurface").alias("geom_type"),
        F.when(holed, F.array(outer, hole)).otherwise(F.array(outer)).alias("parts"), F.when(holed, F.array(F.lit("exterior"), F.lit("interior"))).otherwise(F.array(F.lit("exterior"))).alias("roles"),
        F.when(holed, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))).alias("polygons"), F.create_map(F.lit("note"), F.concat(F.lit("a < b & "), F.col("k").cast("string"))).alias("attrs"),
    )


PLOTS = """plots AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) / 5 AS x, CAST(p_partkey % 97 AS DOUBLE) / 10 AS y, 0.5 + CAST(p_partkey % 7 AS DOUBLE) / 10 AS a FROM part)"""
_HOLE = "CASE WHEN k % 3 = 0 THEN a * a / 16 ELSE 0 END"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered lines, each part a line."""
    rows = sites.features(spark, sf_dir)
    return rows.select(*[F.col(c.split()[0]) for c in ("layer", "feature_id", "geom_type", "parts")], F.array(F.lit("line")).alias("roles"), F.array(F.lit(None).cast("int")).alias("polygons"), "attrs")


def _round_trip(spark: SparkSession, features: DataFrame, layers: list[str]) -> DataFrame:
    at = new_path(spark, "registry")
    gml.member_lines(features).write.text(at)
    return gml.read_features(spark, at, layers, end="</gml:featureMember>")


@query(f"""WITH {PLOTS}, {VX} SELECT 'Graveforesp' AS layer, k::VARCHAR AS feature_id, 'MultiSurface' AS geom_type, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n_parts,
  CASE WHEN k % 3 = 0 THEN 12 ELSE 7 END AS n_vertices, floor((3 * a * a - {_HOLE}) * 1e6 + 0.5) / 1e6 AS area, 'a < b & ' || k AS note FROM plots
UNION ALL SELECT any_value(layer), fid::VARCHAR, 'LineString', 1, count(*), 0.0, NULL FROM vx WHERE layer <> 'Gasledning' GROUP BY fid""")
def registry_in_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and plots as one registry file, of which all layers but one are read in one scan."""
    every = plots(spark, sf_dir).unionByName(lines(spark, sf_dir))
    layers = ["Graveforesp", "Vandledning", "Afloebsledning", "Elledning", "Ledningstrace", "Olieledning"]
    back = _round_trip(spark, every, layers)
    n = F.aggregate(F.transform("parts", lambda p: F.size(p)), F.lit(0), lambda a, b: a + b).cast("long")
    return _rounded(back.select("layer", "feature_id", "geom_type", F.size("parts").alias("n_parts"), n.alias("n_vertices"), polygons.area().alias("area"), F.col("attrs")["note"].alias("note")), "area")


def _rects() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("rect"), *[F.lit(v).alias(n) for n, v in zip(("minx", "miny", "maxx", "maxy"), r)]) for i, r in enumerate(RECTS)]))


_RECTS_SQL = ", ".join(f"({i}, {', '.join(f'{v}::DOUBLE' for v in r)})" for i, r in enumerate(RECTS))


@query(f"""WITH {PLOTS} SELECT rect, k::VARCHAR AS feature_id FROM plots, (VALUES {_RECTS_SQL}) AS r(rect, minx, miny, maxx, maxy)
WHERE ((x + 2 * a >= minx AND x <= maxx AND y + a >= miny AND y <= maxy) OR (x + a >= minx AND x <= maxx AND y + 2 * a >= miny AND y <= maxy))
  AND NOT (k % 3 = 0 AND minx > x + a / 4 AND maxx < x + a / 2 AND miny > y + a / 4 AND maxy < y + a / 2)""")
def plots_meeting_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plots truly meet each rectangle; one in a plot's hole or notch is not met."""
    rows = polygons.of_kind(plots(spark, sf_dir).unionByName(lines(spark, sf_dir)), "polygon").select("*", _rects().alias("r"))
    met = rows.filter(polygons.meets_rect(F.col("r.minx"), F.col("r.miny"), F.col("r.maxx"), F.col("r.maxy")))
    return met.select("r.rect", "feature_id")


@query(f"""WITH {VX} SELECT layer, 'LineString' AS geom_type, count(DISTINCT fid) AS n FROM vx GROUP BY layer""")
def skipped_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left out, by layer and type, where polygons are asked for."""
    return polygons.skipped(plots(spark, sf_dir).unionByName(lines(spark, sf_dir)), "polygon")


@query(f"""WITH {PLOTS} SELECT k::VARCHAR AS feature_id, CASE WHEN k % 3 = 0 THEN 10 ELSE 6 END::BIGINT AS n_corners, floor((3 * a * a - {_HOLE}) * 1e6 + 0.5) / 1e6 AS area FROM plots""")
def triangulated_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles of each plot meet all its corners, and their areas are the plot's."""
    corners = polygons.triangulated(plots(spark, sf_dir), "feature_id")
    place = lambda i: F.max(F.when(F.col("corner") == i, F.struct("x", "y")))
    each = corners.groupBy("feature_id", "polygon", "triangle").agg(*[place(i).alias(f"c{i}") for i in range(3)])
    twice = (F.col("c1.x") - F.col("c0.x")) * (F.col("c2.y") - F.col("c0.y")) - (F.col("c1.y") - F.col("c0.y")) * (F.col("c2.x") - F.col("c0.x"))
    areas = each.groupBy("feature_id").agg(F.sum(F.abs(twice) / 2).alias("area"))
    used = corners.groupBy("feature_id").agg(F.countDistinct("x", "y").alias("n_corners"))
    return _rounded(areas.join(used, "feature_id"), "area")


@query(f"""WITH {SEG}, {PLOTS}, base AS (SELECT k, x + i * a AS x, y + j * a AS y FROM plots, (VALUES (0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)) AS c(i, j)),
met AS (SELECT k, b.x, b.y, seg_id, z1, z2, CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 > 1e-12 THEN least(greatest(((b.x - x1) * (x2 - x1) + (b.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0.0), 1.0) ELSE 0.0 END AS t, x1, y1, x2, y2 FROM base b, seg WHERE k % 3 <> 0),
near AS (SELECT k, x, y, arg_min(z1 + t * (z2 - z1), {{'d': (x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1))), 's': seg_id}}) AS z FROM met GROUP BY k, x, y)
SELECT k::VARCHAR AS feature_id, floor(x * 1e6 + 0.5) / 1e6 AS x, floor(y * 1e6 + 0.5) / 1e6 AS y, floor(z * 1e6 + 0.5) / 1e6 AS z FROM near""")
def draped_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of the plots without holes, with the height of the nearest registered line."""
    corners = polygons.triangulated(plots(spark, sf_dir).filter("size(parts) = 1"), "feature_id")
    placed = polygons.draped_triangles(corners, sites.segments(spark, sf_dir), "feature_id")
    return _rounded(placed.select("feature_id", "x", "y", "z"), "x", "y", "z").distinct()
