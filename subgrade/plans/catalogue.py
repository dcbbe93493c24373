"""Queries over the given tables by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from subgrade.functions import dims, scalars as S
from subgrade.functions.geometry import in_polygon
from subgrade.operators import accuracy, adhoc, cluster, depth, deviation, discretise, ground, match, nearest, samples, segments as G
from subgrade.plans import sites
from subgrade.plans.sites import COMP, FEAT, PTS, SAMPLE_STEP, SEG, TRENCH, TX, TY, TZ, VX, nearest_sql
from subgrade.sinks.clouds import colour_table as colours
from subgrade.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    """Sums depend on their order in the last digits."""
    return df.withColumns({n: F.floor(F.col(n) * 10.0**to + 0.5) / 10.0**to for n in names})


def _r(*names: str, to: int = 6) -> str:
    return ", ".join(f"floor(({n}) * 1e{to} + 0.5) / 1e{to} AS {n}" for n in names)


def _inside() -> Column:
    return in_polygon(F.col("x"), F.col("y"), TRENCH)


_EDGES = ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(TRENCH, [*TRENCH[1:], TRENCH[0]]))
IN_TRENCH = f"""(SELECT count(*) FROM (VALUES {_EDGES}) AS e(ax, ay, bx, by_)
  WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax) % 2 = 1"""
STATS_SQL = """avg(dist) AS mean, quantile_cont(dist, 0.5) AS median, stddev_pop(dist) AS std, quantile_cont(dist, 0.95) AS p95,
  max(dist) AS max, min(dist) AS min, count(dist) AS n"""
STATS = ("mean", "median", "std", "p95", "max", "min")
FOUND_SQL = f"WITH {PTS}, {SEG}, {nearest_sql()}, found AS (SELECT pid, any_value(instance) AS instance, any_value(utility_type) AS utility_type, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, sqrt(min(xy2 + ez * ez)) AS dist FROM pairs GROUP BY pid)"


@query(f"""WITH {PTS}, {SEG}, {nearest_sql()}, best AS (SELECT pid, arg_min({{'a': sqrt(xy2), 'b': abs(ez)}}, {{'d': xy2 + ez * ez, 's': seg_id}}) AS m,
  sqrt(min(xy2 + ez * ez)) AS dist FROM pairs GROUP BY pid)
SELECT pid, floor((dist) * 1e6 + 0.5) / 1e6 AS dist, floor((m.a) * 1e6 + 0.5) / 1e6 AS dist_xy, floor((m.b) * 1e6 + 0.5) / 1e6 AS dist_z FROM best""")
def nearest_segment_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_segment(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    return _rounded(found.select("pid", "dist", "dist_xy", "dist_z"), "dist", "dist_xy", "dist_z")


@query(f"{FOUND_SQL} SELECT instance, n, {_r(*STATS)} FROM (SELECT instance, {STATS_SQL} FROM found GROUP BY instance)")
def nearest_segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_segment(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    return _rounded(deviation.instance_stats(found), *STATS)


@query(f"""WITH {PTS}, {SEG}, {nearest_sql()}, found AS (SELECT pid, any_value(instance) AS instance,
  sqrt(min(CASE WHEN is_active THEN xy2 + ez * ez END)) AS a, sqrt(min(CASE WHEN NOT is_active THEN xy2 + ez * ez END)) AS i FROM pairs GROUP BY pid)
SELECT instance, floor((avg(a)) * 1e6 + 0.5) / 1e6 AS active_mean, floor((max(a)) * 1e6 + 0.5) / 1e6 AS active_max, floor((avg(i)) * 1e6 + 0.5) / 1e6 AS inactive_mean, floor((max(i)) * 1e6 + 0.5) / 1e6 AS inactive_max
FROM found GROUP BY instance""")
def deviation_active_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deviation.by_status(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    out = found.groupBy("instance").agg(*[f(f"dist_{n}").alias(f"{n}_{k}") for n in ("active", "inactive") for k, f in (("mean", F.avg), ("max", F.max))])
    return _rounded(out, "active_mean", "active_max", "inactive_mean", "inactive_max")


@query(f"""{FOUND_SQL} SELECT utility_type, count(*) AS n_points, count(d) AS n_matched, floor((avg(d)) * 1e6 + 0.5) / 1e6 AS mean,
  floor((quantile_cont(d, 0.95)) * 1e6 + 0.5) / 1e6 AS p95, floor((max(d)) * 1e6 + 0.5) / 1e6 AS max
FROM (SELECT utility_type, CASE WHEN {IN_TRENCH} THEN dist END AS d FROM found) GROUP BY utility_type""")
def class_summary_in_trench(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_segment(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    return _rounded(deviation.class_summary(found, _inside()), "mean", "p95", "max")


_TYPE_LAYERS = ", ".join(f"({k}, '{v}')" for k, v in dims.TYPE_TO_LAYER.items())
_SUPPLY = ", ".join(f"('{k}', '{v}')" for k, v in dims.SUPPLY_TO_LINE.items())
MATCH_SQL = f"""types AS (SELECT * FROM (VALUES {_TYPE_LAYERS}) AS t(utility_type, line)),
supply_line AS (SELECT * FROM (VALUES {_SUPPLY}) AS t(value, line)),
lined AS (SELECT s.*, CASE WHEN layer = 'Ledningstrace' THEN (SELECT l.line FROM supply_line l WHERE l.value = lower(s.supply)) ELSE layer END AS line FROM seg s),
matched AS (SELECT t.utility_type, l.* FROM lined l JOIN types t USING (line)
  UNION ALL BY NAME SELECT u.utility_type, l.* FROM lined l, (SELECT DISTINCT utility_type FROM pts WHERE utility_type NOT IN (SELECT utility_type FROM types)) u)"""


@query(f"""WITH {PTS}, {SEG}, {MATCH_SQL}, {nearest_sql(segments_="matched", on="p.utility_type = s.utility_type")},
found AS (SELECT pid, any_value(utility_type) AS utility_type, sqrt(min(xy2 + ez * ez)) AS dist FROM pairs GROUP BY pid),
every AS (SELECT p.utility_type, f.dist FROM pts p LEFT JOIN found f USING (pid))
SELECT utility_type, count(*) AS n_points, count(dist) AS n_matched, floor((avg(dist)) * 1e6 + 0.5) / 1e6 AS mean, floor((max(dist)) * 1e6 + 0.5) / 1e6 AS max FROM every GROUP BY utility_type""")
def matched_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = sites.points(spark, sf_dir)
    segs = match.matched_segments(sites.segments(spark, sf_dir), pts)
    found = nearest.nearest_segment(pts, segs, ["utility_type"])
    d = F.when(F.col("dist") < float("inf"), F.col("dist"))
    out = found.groupBy("utility_type").agg(F.count("*").alias("n_points"), F.count(d).alias("n_matched"), F.avg(d).alias("mean"), F.max(d).alias("max"))
    return _rounded(out, "mean", "max")


@query(f"{FOUND_SQL} SELECT class, r, g, b, count(*) AS n FROM (SELECT CASE WHEN dist <= 0.25 THEN 1 WHEN dist <= 0.5 THEN 2 WHEN dist <= 1 THEN 3 WHEN dist <= 2 THEN 4 ELSE 5 END AS class FROM found) JOIN (VALUES (1, 0.0, 0.7, 0.2), (2, 0.6, 0.9, 0.0), (3, 1.0, 0.8, 0.0), (4, 1.0, 0.4, 0.0), (5, 0.8, 0.0, 0.0)) AS c(class, r, g, b) USING (class) GROUP BY ALL".replace("SELECT class, r, g, b,", "SELECT class::INTEGER AS class, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b,"))
def deviation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_segment(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    d = F.col("dist")
    rows = found.select(S.deviation_class(d).alias("class"), S.deviation_colour(d).alias("c"))
    return rows.groupBy("class", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b")).agg(F.count("*").alias("n"))


def _srgb16(c: str) -> str:
    return f"CAST(floor(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE pow({c}, 1 / 2.4) * 1.055 - 0.055 END * 65535) AS INTEGER)"


@query(f"""{FOUND_SQL}, classed AS (SELECT *, CASE WHEN dist <= 0.25 THEN 1 WHEN dist <= 0.5 THEN 2 WHEN dist <= 1 THEN 3 WHEN dist <= 2 THEN 4 ELSE 5 END AS classification FROM found WHERE {IN_TRENCH})
SELECT pid, x + {TX} AS x, y + {TY} AS y, floor((z + {TZ}) * 1e6 + 0.5) / 1e6 AS z, {_srgb16('r::DOUBLE')} AS red, {_srgb16('g::DOUBLE')} AS green, {_srgb16('b::DOUBLE')} AS blue,
  classification, CAST(least(greatest(round_even(dist * 1000, 0), 0), 65535) AS INTEGER) AS intensity
FROM classed JOIN (VALUES (1, 0.0, 0.7, 0.2), (2, 0.6, 0.9, 0.0), (3, 1.0, 0.8, 0.0), (4, 1.0, 0.4, 0.0), (5, 0.8, 0.0, 0.0)) AS c(classification, r, g, b) USING (classification)""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest_segment(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    rows = deviation.export_rows(found, _inside(), "dist", TX, TY, TZ)
    return _rounded(rows.drop("deviation_m"), "z")


@query(f"WITH {PTS} SELECT pid FROM pts WHERE {IN_TRENCH}")
def point_in_trench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.points(spark, sf_dir).filter(_inside()).select("pid")


@query(f"WITH {PTS}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM pts) SELECT pid, x, y FROM pts, c WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 4.0")
def circle_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.crop_circle(sites.points(spark, sf_dir), dims.CROP_RADIUS).select("pid", "x", "y")


RECT = (2.0, 2.0, 6.0, 7.0)


@query(f"""WITH {SEG}, d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM seg),
t AS (SELECT *, greatest(0.0, CASE WHEN abs(dx) < 1e-12 THEN 0.0 ELSE least((2.0 - x1) / dx, (6.0 - x1) / dx) END, CASE WHEN abs(dy) < 1e-12 THEN 0.0 ELSE least((2.0 - y1) / dy, (7.0 - y1) / dy) END) AS t0,
  least(1.0, CASE WHEN abs(dx) < 1e-12 THEN 1.0 ELSE greatest((2.0 - x1) / dx, (6.0 - x1) / dx) END, CASE WHEN abs(dy) < 1e-12 THEN 1.0 ELSE greatest((2.0 - y1) / dy, (7.0 - y1) / dy) END) AS t1 FROM d
  WHERE NOT (abs(dx) < 1e-12 AND (x1 < 2 OR x1 > 6)) AND NOT (abs(dy) < 1e-12 AND (y1 < 2 OR y1 > 7)))
SELECT seg_id, floor((x1 + t0 * dx) * 1e6 + 0.5) / 1e6 AS x1, floor((y1 + t0 * dy) * 1e6 + 0.5) / 1e6 AS y1, floor((z1 + t0 * (z2 - z1)) * 1e6 + 0.5) / 1e6 AS z1,
  floor((x1 + t1 * dx) * 1e6 + 0.5) / 1e6 AS x2, floor((y1 + t1 * dy) * 1e6 + 0.5) / 1e6 AS y2, floor((z1 + t1 * (z2 - z1)) * 1e6 + 0.5) / 1e6 AS z2 FROM t WHERE t0 <= t1""")
def rect_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = G.clip_rect(sites.segments(spark, sf_dir), *RECT)
    return _rounded(cut.select("seg_id", "x1", "y1", "z1", "x2", "y2", "z2"), "x1", "y1", "z1", "x2", "y2", "z2")


@query(f"""WITH {SEG}, d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, x1 - 5.0 AS fx, y1 - 5.0 AS fy FROM seg),
q AS (SELECT *, dx * dx + dy * dy AS a, 2 * (fx * dx + fy * dy) AS b, fx * fx + fy * fy - 4.0 AS c FROM d),
t AS (SELECT *, CASE WHEN a < 1e-12 THEN CASE WHEN c <= 0 THEN 0.0 END WHEN b * b - 4 * a * c >= 0 THEN greatest((-b - sqrt(b * b - 4 * a * c)) / (2 * a), 0.0) END AS t0,
  CASE WHEN a < 1e-12 THEN CASE WHEN c <= 0 THEN 1.0 END WHEN b * b - 4 * a * c >= 0 THEN least((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 1.0) END AS t1 FROM q)
SELECT seg_id, floor((x1 + t0 * dx) * 1e6 + 0.5) / 1e6 AS x1, floor((y1 + t0 * dy) * 1e6 + 0.5) / 1e6 AS y1, floor((z1 + t0 * (z2 - z1)) * 1e6 + 0.5) / 1e6 AS z1,
  floor((x1 + t1 * dx) * 1e6 + 0.5) / 1e6 AS x2, floor((y1 + t1 * dy) * 1e6 + 0.5) / 1e6 AS y2, floor((z1 + t1 * (z2 - z1)) * 1e6 + 0.5) / 1e6 AS z2 FROM t WHERE t0 <= t1""")
def circle_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = G.clip_circle(sites.segments(spark, sf_dir), 5.0, 5.0, 2.0)
    return _rounded(cut.select("seg_id", "x1", "y1", "z1", "x2", "y2", "z2"), "x1", "y1", "z1", "x2", "y2", "z2")


@query(f"""WITH {VX}, b AS (SELECT fid, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM vx GROUP BY fid)
SELECT fid, lx, ly, hx, hy FROM b WHERE hx >= 2 AND lx <= 6 AND hy >= 2 AND ly <= 7""")
def segment_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = G.boxes(sites.vertices(spark, sf_dir), "fid", "part_idx")
    kept = G.parts_in_rect(parts, *RECT)
    return kept.select("fid", F.col("low_x").alias("lx"), F.col("low_y").alias("ly"), F.col("high_x").alias("hx"), F.col("high_y").alias("hy"))


@query(f"""WITH {VX} SELECT DISTINCT fid FROM vx WHERE (x - 5) * (x - 5) + (y - 5) * (y - 5) <= 4
UNION SELECT fid FROM (SELECT fid, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM vx GROUP BY fid) WHERE hx >= 3 AND lx <= 7 AND hy >= 3 AND ly <= 7""")
def circle_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parts_in_circle(sites.vertices(spark, sf_dir), 5.0, 5.0, 2.0, "fid").select("fid")


@query(f"WITH {VX} SELECT fid, vid, floor((z) * 1e6 + 0.5) / 1e6 AS z, depth_source FROM vx")
def depth_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sites.vertices(spark, sf_dir).select("fid", "vid", "z", "depth_source"), "z")


@query(f"""WITH {VX}, p AS (SELECT greatest(depth_source, lead(depth_source) OVER (PARTITION BY fid ORDER BY vid)) AS s, lead(depth_source) OVER (PARTITION BY fid ORDER BY vid) AS n FROM vx)
SELECT s AS depth_source, count(*) AS n_segments FROM p WHERE n IS NOT NULL GROUP BY s""")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.source_counts(sites.vertices(spark, sf_dir), ["fid", "part_idx"])


@query(f"""WITH {SEG} SELECT layer, count(DISTINCT fid) AS n_features, count(*) AS n_segments, count(DISTINCT CASE WHEN is_active THEN fid END) AS n_active_features,
  count(*) FILTER (WHERE is_active) AS n_active_segments FROM seg GROUP BY layer""")
def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.layer_stats(sites.segments(spark, sf_dir))


@query(f"""WITH {SEG} SELECT CASE WHEN layer = 'Ledningstrace' THEN 'Ledningstrace (' || supply || ')' ELSE layer END AS storage_key, count(DISTINCT fid) AS n_features, count(*) AS n_segments,
  count(DISTINCT CASE WHEN is_active THEN fid END) AS n_active_features, count(DISTINCT CASE WHEN NOT is_active THEN fid END) AS n_inactive_features FROM seg GROUP BY 1""")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.key_stats(sites.segments(spark, sf_dir))


_PARENTS = ", ".join(f"('{k}', '{v}')" for k, v in dims.COMPONENT_TO_LINE.items())


@query(f"""WITH {VX}, {COMP}, m AS (SELECT layer AS line, avg(z) AS layer_mean FROM vx GROUP BY layer),
c AS (SELECT comp.*, m.layer_mean FROM comp LEFT JOIN (VALUES {_PARENTS}) AS p(cl, line) ON p.cl = comp.layer LEFT JOIN m USING (line))
SELECT comp_id, floor((CASE WHEN z <> -99 THEN z ELSE coalesce(layer_mean, -0.25) END) * 1e6 + 0.5) / 1e6 AS z,
  CASE WHEN z <> -99 THEN 1 WHEN layer_mean IS NOT NULL THEN 4 ELSE 5 END AS depth_source FROM c""")
def component_layer_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_mean = depth.component_layer_means(sites.components(spark, sf_dir), sites.vertices(spark, sf_dir), dims.component_lines(spark))
    out = depth.resolve(with_mean, F.lit(-0.25), ["comp_id"], depth.COMPONENT_LEVELS, indicative_mm=None, layer_mean="layer_mean")
    return _rounded(out.select("comp_id", "z", "depth_source"), "z")


CELLS_SQL = f"{PTS}, cells AS (SELECT cx, cy, (cx + 0.5) * 2.0 AS x, (cy + 0.5) * 2.0 AS y, quantile_cont(z, 0.95) AS z FROM (SELECT CAST(floor(x / 2.0) AS BIGINT) AS cx, CAST(floor(y / 2.0) AS BIGINT) AS cy, z FROM pts) GROUP BY cx, cy)"


@query(f"WITH {CELLS_SQL} SELECT cx, cy, x::DOUBLE AS x, y::DOUBLE AS y, floor((z) * 1e6 + 0.5) / 1e6 AS z FROM cells")
def top_surface_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ground.top_cells(sites.points(spark, sf_dir)), "z")


@query(f"""WITH {CELLS_SQL}, d AS (SELECT s.pid, c.z, (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) AS d2, c.cx * 1000 + c.cy AS cid FROM pts s, cells c),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, cid) AS rank FROM d)
SELECT pid AS qid, floor((coalesce(max(CASE WHEN rank = 1 AND sqrt(d2) < 1e-9 THEN z END), sum(z / nullif(d2, 0)) / sum(1 / nullif(d2, 0)))) * 1e5 + 0.5) / 1e5 AS ground_z FROM r WHERE rank <= 8 GROUP BY pid""")
def ground_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = sites.points(spark, sf_dir)
    samples = ground.top_cells(pts).withColumn("pid", F.col("cx") * 1000 + F.col("cy"))
    return _rounded(ground.idw(pts.withColumnRenamed("pid", "qid"), samples), "ground_z", to=5)


@query(f"WITH {PTS} SELECT floor((quantile_cont(z, 0.95)) * 1e6 + 0.5) / 1e6 AS ground_z FROM pts")
def ground_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ground.ground_level(sites.points(spark, sf_dir)), "ground_z")


def _fit_sql(source: str) -> str:
    return f"""(SELECT (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b,
      mz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * mx - (yz * xx - xz * xy) / (xx * yy - xy * xy) * my AS c
    FROM (SELECT covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz,
      avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {source}))"""


_KEPT = "(SELECT p.* FROM pts p, {f} f, (SELECT stddev_pop(k.z - (k.x * f.a + k.y * f.b + f.c)) AS s FROM {k} k, {f} f) d WHERE abs(p.z - (p.x * f.a + p.y * f.b + f.c)) <= 2 * d.s)"


@query(f"WITH {PTS}, f1 AS {_fit_sql('pts')}, k1 AS {_KEPT.format(f='f1', k='pts')}, f2 AS {_fit_sql('k1')}, k2 AS {_KEPT.format(f='f2', k='k1')}, f3 AS {_fit_sql('k2')} SELECT {_r('a', 'b', 'c')} FROM f3")
def ground_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = ground.fit_plane(sites.points(spark, sf_dir))
    return _rounded(spark.createDataFrame([plane], "a double, b double, c double"), "a", "b", "c")


@query("""SELECT s_suppkey, n_nationkey AS area, floor((d) * 1e6 + 0.5) / 1e6 AS distance FROM (SELECT s_suppkey, n_nationkey, sqrt((sx - nx) ** 2 + (sy - ny) ** 2) AS d,
  row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt((sx - nx) ** 2 + (sy - ny) ** 2), n_nationkey) AS r
  FROM (SELECT s_suppkey, CAST(s_suppkey % 17 AS DOUBLE) AS sx, s_acctbal / 1000 AS sy FROM supplier), (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS nx, CAST(n_regionkey AS DOUBLE) AS ny FROM nation)) WHERE r = 1""")
def nearest_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a fixed handful of areas each polygon's centre is nearest to."""
    polygons = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 17).cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    areas = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.collect_list(F.struct("n_nationkey", "n_regionkey")).alias("areas"))
    d = lambda a: F.sqrt((F.col("x") - a["n_nationkey"].cast("double")) ** 2 + (F.col("y") - a["n_regionkey"].cast("double")) ** 2)
    best = F.array_min(F.transform("areas", lambda a: F.struct(d(a).alias("d"), a["n_nationkey"].alias("k"))))
    out = polygons.crossJoin(F.broadcast(areas)).select("s_suppkey", best["k"].alias("area"), best["d"].alias("distance"))
    return _rounded(out, "distance")


@query(f"WITH {PTS}, found AS (SELECT instance, abs(z) AS dist FROM pts) SELECT instance, n, {_r(*STATS)} FROM (SELECT instance, {STATS_SQL} FROM found GROUP BY instance)")
def instance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(deviation.instance_stats(sites.points(spark, sf_dir).withColumn("dist", F.abs("z"))), *STATS)


@query(f"WITH {PTS}, c AS (SELECT instance, site_id, utility_type, count(*) AS n FROM pts GROUP BY ALL) SELECT instance, site_id, arg_min(utility_type, {{'n': -n, 't': utility_type}}) AS utility_type FROM c GROUP BY instance, site_id")
def majority_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = sites.points(spark, sf_dir)
    return pts.groupBy("instance", "site_id").agg(F.mode("utility_type", True).alias("utility_type"))


@query(f"WITH {FEAT} SELECT fid, acc_width::DOUBLE AS half_width, acc_class AS class FROM feat")
def accuracy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.accuracy_class(F.col("attrs")[accuracy.FIELD])
    return sites.features(spark, sf_dir).select("fid", c["half_width"].alias("half_width"), c["class"].alias("class"))


@query(f"WITH {FEAT} SELECT layer, count(accuracy) > 0 AS has_column, count(acc_class) AS n_parseable, count(*) AS n_total FROM feat GROUP BY layer")
def accuracy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.coverage(sites.features(spark, sf_dir))


@query(f"""WITH {PTS}, {SEG}, flat AS (SELECT fid, acc_width, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM seg WHERE acc_width > 0),
t AS (SELECT pid, fid, acc_width, x, y, x1, y1, dx, dy, CASE WHEN dx * dx + dy * dy > 1e-12 THEN least(greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0) ELSE 0.0 END AS t FROM pts, flat)
SELECT fid, count(*) AS n_points, floor((min(d)) * 1e6 + 0.5) / 1e6 AS nearest FROM (SELECT pid, fid, sqrt(min((x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2)) AS d, any_value(acc_width) AS w FROM t GROUP BY pid, fid) WHERE d <= w GROUP BY fid""")
def buffer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = S.accuracy_class(F.col("attrs")[accuracy.FIELD])["half_width"]
    segs = sites.segments(spark, sf_dir).withColumn("half_width", width).drop("hw")
    counts = accuracy.buffer_counts(sites.points(spark, sf_dir), segs)
    return _rounded(counts.select(F.col("feature_id").cast("long").alias("fid"), "n_points", "nearest"), "nearest")


_L = "sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2 + (z2 - z1) ** 2)"
SAMPLES_SQL = f"""sized AS (SELECT *, {_L} AS len, greatest(2, CAST(ceil({_L} / {SAMPLE_STEP}) AS INTEGER) + 1) AS na,
    CASE WHEN hw > 1e-9 THEN greatest(2, CAST(ceil(2 * hw / {SAMPLE_STEP}) AS INTEGER) + 1) ELSE greatest(3, CAST(ceil(2 * pi() * 0.01 / {SAMPLE_STEP}) AS INTEGER)) END AS nr FROM seg WHERE {_L} >= 1e-6),
st AS (SELECT *, unnest(range(0, na)) AS station FROM sized), ri AS (SELECT *, unnest(range(0, nr)) AS ring FROM st),
ax AS (SELECT *, (x2 - x1) / len AS ux, (y2 - y1) / len AS uy, (z2 - z1) / len AS uz, station / (na - 1) AS t,
  x1 + station / (na - 1) * (x2 - x1) AS cx, y1 + station / (na - 1) * (y2 - y1) AS cy, z1 + station / (na - 1) * (z2 - z1) AS cz FROM ri),
ay AS (SELECT *, sqrt(ux * ux + uy * uy) AS fl, CASE WHEN abs(ux) < 0.9 THEN 0.0 ELSE -uz END AS ax_, CASE WHEN abs(ux) < 0.9 THEN uz ELSE 0.0 END AS ay_, CASE WHEN abs(ux) < 0.9 THEN -uy ELSE ux END AS az_ FROM ax),
az AS (SELECT *, ax_ / sqrt(ax_ ** 2 + ay_ ** 2 + az_ ** 2) AS px, ay_ / sqrt(ax_ ** 2 + ay_ ** 2 + az_ ** 2) AS py, az_ / sqrt(ax_ ** 2 + ay_ ** 2 + az_ ** 2) AS pz, 2 * pi() * ring / nr AS ang, -hw + 2 * hw * ring / (nr - 1) AS o FROM ay),
samples AS (SELECT seg_id, station, ring,
  CASE WHEN hw > 1e-9 THEN cx + o * CASE WHEN fl > 1e-9 THEN -uy / fl ELSE 1 END ELSE cx + 0.01 * (cos(ang) * px + sin(ang) * (uy * pz - uz * py)) END AS x,
  CASE WHEN hw > 1e-9 THEN cy + o * CASE WHEN fl > 1e-9 THEN ux / fl ELSE 0 END ELSE cy + 0.01 * (cos(ang) * py + sin(ang) * (uz * px - ux * pz)) END AS y,
  CASE WHEN hw > 1e-9 THEN cz ELSE cz + 0.01 * (cos(ang) * pz + sin(ang) * (ux * py - uy * px)) END AS z FROM az)"""


_EXTENTS = ", ".join(f"floor(({f}({c})) * 1e6 + 0.5) / 1e6 AS {n}_{c}" for c in "xyz" for n, f in (("low", "min"), ("mean", "avg"), ("high", "max")))


@query(f"WITH {SEG}, {SAMPLES_SQL} SELECT seg_id, count(*) AS n, {_EXTENTS} FROM samples GROUP BY seg_id")
def registry_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples 0.02 m apart, told by segment: their number, and the extent and mean of their coordinates."""
    segs = sites.segments(spark, sf_dir).select("seg_id", "x1", "y1", "z1", "x2", "y2", "z2", "radius", "half_width")
    out = samples.extents(segs, SAMPLE_STEP, SAMPLE_STEP)
    return _rounded(out, *[c for c in out.columns if c not in ("seg_id", "n")])


@query()
def registry_sample_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each segment's samples, 0.02 m apart, the distance to the nearest point of a type that its layer is compared with, and
    that distance's parts in the plane and in height. The SQL would be all pairs; the test compares with brute force."""
    return deviation.sample_deviation(sites.segments(spark, sf_dir), sites.points(spark, sf_dir), SAMPLE_STEP)


@query(f"WITH {PTS}, known AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in dims.CLASSES.items()) + ") AS t(class, class_name)) SELECT p.class, coalesce(k.class_name, 'unknown') AS class_name, count(*) AS n FROM pts p LEFT JOIN known k USING (class) GROUP BY ALL")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = sites.points(spark, sf_dir).join(F.broadcast(dims.classes(spark)), "class", "left")
    return joined.groupBy("class", F.coalesce("class_name", F.lit("unknown")).alias("class_name")).agg(F.count("*").alias("n"))


@query(f"""WITH {PTS}, o AS (SELECT site_id, min(x) - 0.25 AS ox, min(y) - 0.25 AS oy, min(z) - 0.25 AS oz FROM pts GROUP BY site_id)
SELECT site_id, CAST(floor((x - ox) / 0.5) AS BIGINT) AS vx, CAST(floor((y - oy) / 0.5) AS BIGINT) AS vy, CAST(floor((z - oz) / 0.5) AS BIGINT) AS vz,
  floor((avg(x)) * 1e6 + 0.5) / 1e6 AS x, floor((avg(y)) * 1e6 + 0.5) / 1e6 AS y, floor((avg(z)) * 1e6 + 0.5) / 1e6 AS z, count(*) AS n_points, min(pid) AS pid FROM pts JOIN o USING (site_id) GROUP BY ALL""")
def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cluster.voxels(sites.points(spark, sf_dir), 0.5), "x", "y", "z")


@query(f"""WITH {PTS}, l AS (SELECT pid, site_id, CASE WHEN class = 5 THEN -1 ELSE class END AS label FROM pts),
n AS (SELECT site_id, label, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT site_id, label, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, label DESC) - 1 AS fresh FROM n WHERE label >= 0 AND n >= 100)
SELECT pid, coalesce(fresh, -1)::INTEGER AS label FROM l LEFT JOIN k USING (site_id, label)""")
def renumbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("class") == 5, F.lit(-1)).otherwise(F.col("class"))
    labelled = cluster.drop_small(sites.points(spark, sf_dir).withColumn("label", label), 100)
    return cluster.renumber(labelled).select("pid", F.col("label").cast("int").alias("label"))


@query(f"WITH {PTS} SELECT site_id, count(*) AS n_read, count(*) FILTER (WHERE {IN_TRENCH}) AS n_kept FROM pts GROUP BY ROLLUP (site_id)")
def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.points(spark, sf_dir).rollup("site_id").agg(F.count("*").alias("n_read"), F.count_if(_inside()).alias("n_kept"))


@query(f"WITH {PTS} SELECT pid, x, y, z FROM pts WHERE pid % 60 = 0")
def stride_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 60th vertex of a cloud: sampling by ordinal is the operator here."""
    return sites.points(spark, sf_dir).filter(F.col("pid") % 60 == 0).select("pid", "x", "y", "z")


@query(f"WITH {PTS} SELECT instance, row_number() OVER (ORDER BY count(*) DESC, instance)::INTEGER AS place, ((row_number() OVER (ORDER BY count(*) DESC, instance) - 1) % 10)::INTEGER AS colour, count(*) AS n FROM pts GROUP BY instance")
def instance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sites.points(spark, sf_dir).groupBy("instance").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "instance"))  # one row an instance
    return sizes.select("instance", place.alias("place"), ((place - 1) % 10).alias("colour"), "n")


@query(f"WITH {PTS} SELECT pid, site_id, instance, row_number() OVER (PARTITION BY site_id, instance ORDER BY pid)::INTEGER AS ordinal, count(*) OVER (PARTITION BY site_id, instance) AS of FROM pts")
def instance_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("site_id", "instance")
    return sites.points(spark, sf_dir).select("pid", "site_id", "instance", F.row_number().over(w.orderBy("pid")).alias("ordinal"), F.count("*").over(w).alias("of"))


_SUPPLIES = ("tele og data", "Fjernvarme", "Vand", "ukendt", None)


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey % 20 AS area, p_retailprice / 500 AS d FROM part)
SELECT k AS id, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 12 END::INTEGER AS utility_type, CASE WHEN k % 2 = 0 THEN 'Site_' || k ELSE 'Cloud_' || k END AS base,
  CASE k % 5 WHEN 1 THEN 'TermiskLedning' WHEN 2 THEN 'Vandledning' END AS line, ([0.98, 1.0, 0.0, 0.5, 0.5])[k % 5 + 1]::DOUBLE AS red, CASE WHEN k % 4 <> 3 THEN area WHEN k % 2 = 0 THEN area END::INTEGER AS area,
  CASE WHEN k % 4 = 1 THEN 'Ledningspakke ' || k END AS package, coalesce(([NULL, 'Vand', '', NULL])[k % 4 + 1], '—') AS shown FROM t""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names, folders and supplies tell, of names made of the parts' keys."""
    k = F.col("p_partkey")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    chosen = lambda n, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % n).cast("int"))
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"), F.when(k % 3 == 0, text("1_instance_", k, ".ply")).otherwise(text("1_instance_", k, "_type_", k % 12, ".ply")).alias("file"),
        F.when(k % 2 == 0, text("Area_", k % 20, "_Site_", k)).otherwise(text("Cloud_", k)).alias("stem"), chosen(5, *_SUPPLIES).alias("supply"),
        F.when(k % 4 == 3, F.lit("elsewhere")).when(k % 4 == 0, text("area ", k % 20)).otherwise(text("Water_Area_", k % 20)).alias("folder"),
        F.when(k % 4 == 1, text("ledningspakke_", k)).otherwise(F.lit("pakke")).alias("package"), chosen(4, None, "Vand", "", "nan").alias("raw"),
    )
    grey = F.struct(*[F.lit(0.5).alias(c) for c in "rgb"])
    return t.select(
        "id", S.type_of_file(F.col("file")).alias("utility_type"), S.base_name(F.col("stem")).alias("base"), S.supply_line(F.col("supply")).alias("line"),
        S.supply_colour(F.col("supply"), grey)["r"].alias("red"), S.area_number(F.col("folder"), F.col("stem")).alias("area"),
        S.package_label(F.col("package")).alias("package"), S.shown(F.col("raw")).alias("shown"),
    )


@query(f"""WITH {PTS}, n AS (SELECT CASE WHEN abs(z) <= 0.25 THEN 1 WHEN abs(z) <= 0.5 THEN 2 WHEN abs(z) <= 1 THEN 3 WHEN abs(z) <= 2 THEN 4 ELSE 5 END AS value, count(*) AS n FROM pts GROUP BY 1)
SELECT value, red, green, blue, 255 AS alpha, label, coalesce(n, 0) AS n FROM (VALUES (1, 0, 218, 124, 'Class 1:  <= 250 mm'), (2, 203, 243, 0, 'Class 2:  <= 500 mm'),
  (3, 255, 231, 0, 'Class 3:  <= 1000 mm'), (4, 255, 170, 0, 'Class 4:  <= 2000 mm'), (5, 231, 0, 0, 'Class 5:  > 2000 mm')) AS t(value, red, green, blue, label) LEFT JOIN n USING (value)""")
def colour_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colours of the classes, and how many points have a height of each class."""
    n = sites.points(spark, sf_dir).groupBy(S.deviation_class(F.abs("z")).alias("value")).agg(F.count("*").alias("n"))
    table = colours(spark).join(n, "value", "left")
    return table.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(f"""WITH {SEG}, {COMP}, c AS (SELECT min(d) AS d, arg_min(comp_id, {{'d': d, 'i': comp_id}}) AS id FROM (SELECT comp_id, sqrt((x - 5.0) * (x - 5.0) + (y - 4.6) * (y - 4.6) + (z - -0.5) * (z - -0.5)) AS d FROM comp)),
h AS (SELECT 0 AS pid, 5.0::DOUBLE AS x, 4.6::DOUBLE AS y, -0.5::DOUBLE AS z), {nearest_sql(points_="h")}, s AS (SELECT min(sqrt(xy2 + ez * ez)) AS d, arg_min(seg_id, {{'d': sqrt(xy2 + ez * ez), 'i': seg_id}}) AS id FROM pairs)
SELECT CASE WHEN c.d < s.d AND c.d < 0.2 THEN 'component' WHEN s.d < 0.3 THEN 'segment' END AS kind, CASE WHEN c.d < s.d AND c.d < 0.2 THEN c.id WHEN s.d < 0.3 THEN s.id END AS id, floor((CASE WHEN c.d < s.d AND c.d < 0.2 THEN c.d WHEN s.d < 0.3 THEN s.d END) * 1e6 + 0.5) / 1e6 AS distance FROM c, s""")
def pick_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest.pick((5.0, 4.6, -0.5), sites.components(spark, sf_dir), sites.segments(spark, sf_dir))
    return _rounded(out.select("kind", "id", "distance"), "distance")


@query(f"""WITH {FEAT}, kv AS (SELECT layer, 'noejagtighedsklasse' AS attribute, accuracy AS value FROM feat UNION ALL SELECT layer, 'forsyningsart', supply FROM feat
  UNION ALL SELECT layer, 'driftsstatus', CASE WHEN is_active THEN 'i drift' ELSE ' Ude af Drift' END FROM feat UNION ALL SELECT layer, 'vejledendeDybde', CASE WHEN fid % 7 = 0 THEN '1500' END FROM feat
  UNION ALL SELECT layer, 'bredde', CASE WHEN fid % 100 = 4 THEN '500' END FROM feat UNION ALL SELECT layer, 'ledningsejer', 'Ejer ' || fid % 9 FROM feat),
known AS (SELECT DISTINCT attribute FROM kv WHERE value IS NOT NULL), every AS (SELECT DISTINCT layer, attribute FROM feat, known),
c AS (SELECT layer, attribute, value, count(*) AS n, row_number() OVER (PARTITION BY layer, attribute ORDER BY value) AS r FROM kv WHERE value IS NOT NULL GROUP BY layer, attribute, value),
t AS (SELECT layer, attribute, sum(n)::BIGINT AS n_given, string_agg(value, '|' ORDER BY value) FILTER (WHERE r <= 3) AS samples, bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS numbers FROM c GROUP BY layer, attribute)
SELECT layer, attribute, coalesce(n_given, 0) AS n_given, coalesce(samples, '') AS samples, CASE WHEN n_given IS NULL THEN 'unknown' WHEN numbers THEN 'double' ELSE 'string' END AS kind, n_given IS NULL AS all_null
FROM every LEFT JOIN t USING (layer, attribute)""")
def attribute_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute of every layer: how many have it, the first values, whether they are numbers, whether all are null."""
    rows = adhoc.schema_of(sites.features(spark, sf_dir))
    return rows.select("layer", "attribute", "n_given", F.array_join("samples", "|").alias("samples"), "kind", "all_null")


@query(f"""WITH {FEAT}, a AS (SELECT fid, unnest([['bredde', CASE WHEN fid % 100 = 4 THEN '500' END], ['driftsstatus', CASE WHEN is_active THEN 'i drift' ELSE ' Ude af Drift' END], ['forsyningsart', supply],
  ['ledningsejer', 'Ejer ' || fid % 9], ['noejagtighedsklasse', accuracy], ['vejledendeDybde', CASE WHEN fid % 7 = 0 THEN '1500' END]]) AS kv FROM feat)
SELECT fid, kv[1] AS name, coalesce(kv[2], '—') AS text FROM a""")
def attribute_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's attributes as text, a dash for what it lacks."""
    return adhoc.texts(sites.features(spark, sf_dir), "fid")


@query(f"WITH {PTS} SELECT pid, x, y FROM pts WHERE x BETWEEN {RECT[0]} AND {RECT[2]} AND y BETWEEN {RECT[1]} AND {RECT[3]}")
def rect_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.crop_rect(sites.points(spark, sf_dir), *RECT).select("pid", "x", "y")


@query(f"WITH {PTS} SELECT pid, x, y FROM pts WHERE {IN_TRENCH}")
def trench_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the polygon, those out of its box dropped before its edges are looked at."""
    return G.crop_polygon(sites.points(spark, sf_dir), TRENCH).select("pid", "x", "y")


@query(f"""WITH {PTS}, known AS (SELECT * FROM (VALUES {', '.join(f'({k}, {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)' for k, (r, g, b) in dims.CLASS_COLOURS.items())}) AS t(class, r, g, b))
SELECT p.class, coalesce(k.r, {dims.UNKNOWN_CLASS_COLOUR[0]})::DOUBLE AS r, coalesce(k.g, {dims.UNKNOWN_CLASS_COLOUR[1]})::DOUBLE AS g, coalesce(k.b, {dims.UNKNOWN_CLASS_COLOUR[2]})::DOUBLE AS b, count(*) AS n FROM pts p LEFT JOIN known k USING (class) GROUP BY ALL""")
def class_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by class and colour, that of classes without one the default."""
    return dims.coloured(sites.points(spark, sf_dir)).groupBy("class", "r", "g", "b").agg(F.count("*").alias("n"))


@query(f"""WITH {VX} SELECT fid, vid, floor((x + {TX} - {TX}) * 1e6 + 0.5) / 1e6 AS x, floor((y + {TY} - {TY}) * 1e6 + 0.5) / 1e6 AS y, floor((CASE WHEN vid % 2 = 0 THEN z + {TZ} ELSE 0 END - {TZ}) * 1e6 + 0.5) / 1e6 AS z FROM vx""")
def local_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices to global coordinates, every other one without its height, and back."""
    v = sites.vertices(spark, sf_dir)
    x, y, z = G.to_local(F.col("x") + TX, F.col("y") + TY, F.when(F.col("vid") % 2 == 0, F.col("z") + TZ), TX, TY, TZ)
    return _rounded(v.select("fid", "vid", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


@query(f"WITH {FEAT} SELECT layer, count(*) AS n FROM feat WHERE acc_class IS NOT NULL AND is_active GROUP BY layer")
def adhoc_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question in SQL over a view of the features."""
    G.derived(sites.features(spark, sf_dir)).withColumn("accuracy_class", S.accuracy_class(F.col("attrs")[accuracy.FIELD])["class"]).createOrReplaceTempView("site_features")
    return adhoc.ask(spark, "SELECT layer, count(*) AS n FROM site_features WHERE accuracy_class IS NOT NULL AND is_active GROUP BY layer")


@query(f"""WITH {SEG}, n AS (SELECT *, {_L} AS len FROM seg WHERE {_L} >= 1e-6), d AS (SELECT seg_id, len, unnest(range(0, greatest(CAST(ceil(len / 1.5) AS INTEGER), 1))) AS dash_idx FROM n)
SELECT seg_id, dash_idx::INTEGER AS dash_idx, floor((dash_idx * 1.5 / len) * 1e6 + 0.5) / 1e6 AS t0, floor((least((dash_idx * 1.5 + 1.0) / len, 1.0)) * 1e6 + 0.5) / 1e6 AS t1 FROM d""")
def dashed_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(discretise.dashes(sites.segments(spark, sf_dir), 1.0, 0.5), "t0", "t1")


@query()
def density_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels, density clusters by site, points' labels, small ones to noise, numbering."""
    pts = sites.points(spark, sf_dir)
    cells = cluster.voxels(pts, 0.5)
    labelled = cluster.label_points(pts, written(cluster.cluster_voxels(cells, 10, 5), "density-voxels"))
    return cluster.renumber(cluster.drop_small(labelled, 25)).select("pid", "site_id", F.col("label").cast("int").alias("label"))


@query()
def split_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by site, each site's classes taken as instances, split where they lie side by side, numbered by size."""
    pts = sites.points(spark, sf_dir).withColumn("label", F.col("utility_type").cast("int"))
    split = cluster.split_parallel(pts.filter("label >= 0"), 0.5, 5, 10)
    return cluster.renumber(split).select("pid", "site_id", F.col("label").cast("int").alias("label"))
