"""Further queries over the given tables: what of a site is seen, chosen and coloured. Registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.functions import dims, scalars as S
from subgrade.functions.geometry import near_polygon
from subgrade.operators import accuracy, cluster, deviation, ground, nearest, segments as G, shapes, site
from subgrade.plans import sites
from subgrade.plans.catalogue import CELLS_SQL, IN_TRENCH, MATCH_SQL, RECT, _EDGES, _KEPT, _fit_sql, _inside, _r, _rounded, query
from subgrade.plans.sites import COMP, FEAT, PTS, SEG, TRENCH, VX, nearest_sql

STATUS = ("mean", "median", "std", "p95", "max", "min")
_STATUS_SQL = "avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_pop(d) AS std, quantile_cont(d, 0.95) AS p95, max(d) AS max, min(d) AS min, count(d) AS n"
_KEY = "CASE WHEN layer = 'Ledningstrace' THEN 'Ledningstrace (' || supply || ')' ELSE layer END AS storage_key"


@query(f"""WITH {PTS}, {SEG}, {nearest_sql()}, found AS (SELECT pid, any_value(instance) AS instance, is_active, sqrt(min(xy2 + ez * ez)) AS d FROM pairs GROUP BY pid, is_active)
SELECT instance, status, n, {_r(*STATUS)} FROM (SELECT instance, CASE WHEN is_active THEN 'active' ELSE 'inactive' END AS status, {_STATUS_SQL} FROM found GROUP BY ALL)""")
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deviation.by_status(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    return _rounded(deviation.status_stats(found), *STATUS)


_POOLED = [f"{s}_{n}" for s in ("active", "inactive") for n in ("mean", "p95", "max")]


def _pool(status: str, column: str) -> str:
    return f"avg({column}) AS {status}_mean, quantile_cont({column}, 0.95) AS {status}_p95, max({column}) AS {status}_max"


@query(f"""WITH {PTS}, {SEG}, {MATCH_SQL}, {nearest_sql(segments_="matched", on="p.utility_type = s.utility_type")},
dists AS (SELECT pid, sqrt(min(CASE WHEN is_active THEN xy2 + ez * ez END)) AS a, sqrt(min(CASE WHEN NOT is_active THEN xy2 + ez * ez END)) AS i FROM pairs GROUP BY pid),
every AS (SELECT p.utility_type, p.instance, {IN_TRENCH} AS inside, d.a, d.i, least(d.a, d.i) AS b FROM pts p LEFT JOIN dists d USING (pid)),
held AS (SELECT utility_type, instance, inside, CASE WHEN inside THEN b END AS b, CASE WHEN inside THEN a END AS a, CASE WHEN inside THEN i END AS i FROM every),
told AS (SELECT utility_type, count(DISTINCT instance) AS n_instances, count(*) FILTER (WHERE inside) AS n_points, avg(b) AS mean, quantile_cont(b, 0.5) AS median, stddev_pop(b) AS std,
  quantile_cont(b, 0.95) AS p95, max(b) AS max, {_pool("active", "a")}, {_pool("inactive", "i")} FROM held GROUP BY utility_type),
counts AS (SELECT utility_type, count(*) FILTER (WHERE is_active) AS na, count(*) FILTER (WHERE NOT is_active) AS ni FROM matched GROUP BY utility_type)
SELECT utility_type, n_instances, n_points, {_r("mean", "median", "std", "p95", "max", *_POOLED)}, na IS NOT NULL AS has_registry,
  coalesce(na, 0) * n_instances AS n_active_segs, coalesce(ni, 0) * n_instances AS n_inactive_segs FROM told LEFT JOIN counts USING (utility_type)""")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deviation.full_class_summary(sites.points(spark, sf_dir), sites.segments(spark, sf_dir), _inside())
    return _rounded(out, "mean", "median", "std", "p95", "max", *_POOLED)


@query(f"""WITH {CELLS_SQL}, f1 AS {_fit_sql('cells')}, k1 AS {_KEPT.format(f='f1', k='cells').replace('FROM pts p', 'FROM cells p')}, f2 AS {_fit_sql('k1')}, k2 AS {_KEPT.format(f='f2', k='k1').replace('FROM pts p', 'FROM cells p')}, f3 AS {_fit_sql('k2')},
k3 AS {_KEPT.format(f='f3', k='k2').replace('FROM pts p', 'FROM cells p')}, t AS (SELECT quantile_cont(z, 0.5) AS ground_z, count(*) AS n_samples, max(z) - min(z) AS z_spread FROM cells),
s AS (SELECT sqrt(avg((k.z - (k.x * f.a + k.y * f.b + f.c)) ** 2)) AS plane_rms, 100 * sqrt(any_value(f.a) ** 2 + any_value(f.b) ** 2) AS slope_pct FROM k3 k, f3 f)
SELECT n_samples, {_r('ground_z', 'z_spread', 'slope_pct', 'plane_rms')} FROM t, s""")
def ground_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = sites.points(spark, sf_dir)
    return _rounded(ground.ground_scalars(ground.top_cells(pts), pts), "ground_z", "z_spread", "slope_pct", "plane_rms")


def _cut_sql(low_x: str, low_y: str, high_x: str, high_y: str, source: str = "d") -> str:
    """A segment meets a box: its shares within both slabs overlap."""
    return f"""greatest(0.0, CASE WHEN abs(dx) < 1e-12 THEN CASE WHEN x1 BETWEEN {low_x} AND {high_x} THEN 0.0 ELSE 9.0 END ELSE least(({low_x} - x1) / dx, ({high_x} - x1) / dx) END,
    CASE WHEN abs(dy) < 1e-12 THEN CASE WHEN y1 BETWEEN {low_y} AND {high_y} THEN 0.0 ELSE 9.0 END ELSE least(({low_y} - y1) / dy, ({high_y} - y1) / dy) END)
  <= least(1.0, CASE WHEN abs(dx) < 1e-12 THEN 1.0 ELSE greatest(({low_x} - x1) / dx, ({high_x} - x1) / dx) END, CASE WHEN abs(dy) < 1e-12 THEN 1.0 ELSE greatest(({low_y} - y1) / dy, ({high_y} - y1) / dy) END)"""


@query(f"""WITH {PTS}, {SEG}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM pts), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM pts, c WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 0.25),
d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM seg, b)
SELECT layer, count(DISTINCT fid) AS n_near, count(DISTINCT CASE WHEN {_cut_sql('lx', 'ly', 'hx', 'hy')} THEN fid END) AS n_crossing FROM d WHERE {_cut_sql('(lx - 2)', '(ly - 2)', '(hx + 2)', '(hy + 2)')} GROUP BY layer""")
def features_near_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a cloud half a metre around the centroid: features that meet its box and 2 m around, and those that cross the box."""
    cloud = G.crop_circle(sites.points(spark, sf_dir), 0.5)
    segs = sites.segments(spark, sf_dir)
    near = site.meeting(segs, site.cloud_box(cloud), "fid")
    crossing = site.meeting(segs, site.cloud_box(cloud, 0.0), "fid").withColumn("crosses", F.lit(True))
    layers = segs.select("fid", "layer").distinct()
    return layers.join(near, "fid").join(crossing, "fid", "left").groupBy("layer").agg(F.count("*").alias("n_near"), F.count("crosses").alias("n_crossing"))


@query(f"""WITH {PTS}, {SEG}, {MATCH_SQL} SELECT 'instance' AS kind, utility_type, instance AS name, utility_type = 7 AND instance = 'click' AS is_visible FROM (SELECT DISTINCT utility_type, instance FROM pts)
UNION ALL SELECT 'layer', NULL, storage_key, bool_or(coalesce(line = 'Vandledning', FALSE)) FROM (SELECT {_KEY}, line FROM lined) GROUP BY storage_key""")
def utility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The water instance of clicks alone, and the layers that water is compared with."""
    return site.utility_filter(sites.points(spark, sf_dir), sites.segments(spark, sf_dir), (7, "click"))


_SEEN = "seen AS (SELECT DISTINCT fid FROM vx WHERE (x - 5) * (x - 5) + (y - 5) * (y - 5) <= 4 UNION SELECT fid FROM (SELECT fid, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM vx GROUP BY fid) WHERE hx >= 3 AND lx <= 7 AND hy >= 3 AND ly <= 7)"


@query(f"WITH {VX}, {_SEEN} SELECT {_KEY}, count(acc_class) AS n_registered, count(*) AS n_in_view FROM feat JOIN seen USING (fid) GROUP BY 1")
def accuracy_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = G.parts_in_circle(sites.vertices(spark, sf_dir), 5.0, 5.0, 2.0, "feature_id", "part_idx")
    return accuracy.in_view(G.derived(sites.features(spark, sf_dir)), seen)


@query(f"""WITH {PTS}, {SEG}, flat AS (SELECT {_KEY}, acc_width, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM seg WHERE acc_width > 0),
t AS (SELECT pid, storage_key, acc_width, x, y, x1, y1, dx, dy, CASE WHEN dx * dx + dy * dy > 1e-12 THEN least(greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0) ELSE 0.0 END AS t
  FROM pts, flat WHERE (x - 5.0) * (x - 5.0) + (y - 5.0) * (y - 5.0) <= 4.0)
SELECT storage_key, count(DISTINCT CASE WHEN sqrt((x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2) <= acc_width THEN pid END) AS n_points
FROM (SELECT DISTINCT storage_key FROM flat) LEFT JOIN t USING (storage_key) GROUP BY storage_key""")
def buffers_in_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the united buffers of each display name, within 2 m of (5, 5)."""
    segs = sites.segments(spark, sf_dir).withColumn("half_width", S.accuracy_class(F.col("attrs")[accuracy.FIELD])["half_width"]).drop("hw")
    x, y = F.col("x") - 5.0, F.col("y") - 5.0
    return accuracy.hits_by_name(sites.points(spark, sf_dir), segs, x * x + y * y <= 4.0)


@query(f"""WITH {SEG}, d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM seg),
t AS (SELECT *, greatest(0.0, CASE WHEN abs(dx) < 1e-12 THEN 0.0 ELSE least((2.0 - x1) / dx, (6.0 - x1) / dx) END, CASE WHEN abs(dy) < 1e-12 THEN 0.0 ELSE least((2.0 - y1) / dy, (7.0 - y1) / dy) END) AS t0,
  least(1.0, CASE WHEN abs(dx) < 1e-12 THEN 1.0 ELSE greatest((2.0 - x1) / dx, (6.0 - x1) / dx) END, CASE WHEN abs(dy) < 1e-12 THEN 1.0 ELSE greatest((2.0 - y1) / dy, (7.0 - y1) / dy) END) AS t1 FROM d WHERE {_cut_sql('2.0', '2.0', '6.0', '7.0')}),
m AS (SELECT seg_id, ((x1 + t0 * dx) + (x1 + t1 * dx)) / 2 AS mx, ((y1 + t0 * dy) + (y1 + t1 * dy)) / 2 AS my, ((z1 + t0 * (z2 - z1)) + (z1 + t1 * (z2 - z1))) / 2 AS mz FROM t)
SELECT seg_id, {_r('mx', 'my', 'mz')} FROM m""")
def clipped_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = G.clip_rect(sites.segments(spark, sf_dir), *RECT)
    return _rounded(G.midpoints(cut), "mx", "my", "mz")


@query(f"WITH {VX}, {_SEEN}, m AS (SELECT fid, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM vx JOIN seen USING (fid) GROUP BY fid) SELECT fid, {_r('cx', 'cy', 'cz')} FROM m")
def pipe_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vertex of each feature's parts in view."""
    v = sites.vertices(spark, sf_dir)
    hit = G.parts_in_circle(v, 5.0, 5.0, 2.0, "fid", "part_idx").select("fid", "part_idx")
    return _rounded(G.centroids(v.join(hit, ["fid", "part_idx"]), "fid"), "cx", "cy", "cz")


@query(f"WITH {PTS} SELECT site_id, coalesce(class = 1, FALSE) AS is_target, count(*) AS n FROM pts GROUP BY ALL")
def target_and_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.target(sites.points(spark, sf_dir)).groupBy("site_id", "is_target").agg(F.count("*").alias("n"))


_LAYER_ROWS = ", ".join(f"('{n}', {i})" for i, n in enumerate(dims.LINE_LAYERS))


@query(f"""WITH {FEAT}, k AS (SELECT DISTINCT layer, {_KEY} FROM feat) SELECT row_number() OVER (ORDER BY layer = 'Ledningstrace', i, storage_key)::INTEGER AS place, layer, storage_key
FROM k JOIN (VALUES {_LAYER_ROWS}) AS l(layer, i) USING (layer)""")
def legend_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.legend(G.derived(sites.features(spark, sf_dir)))


_BANDS = [(0.0, 0.25), (0.25, 0.5), (0.5, 1.0), (1.0, 2.0)]


def _gradient_sql(d: str, channel: int) -> str:
    colours = dims.DEVIATION_COLOURS
    inner = " ".join(f"WHEN {d} < {hi} THEN {colours[i][channel]}::DOUBLE + ({d} - {lo}) / ({hi} - {lo}) * ({colours[i + 1][channel] - colours[i][channel]!r})::DOUBLE" for i, (lo, hi) in enumerate(_BANDS))
    return f"CASE WHEN {d} IS NULL OR {d} < 0 THEN 0.0::DOUBLE {inner} ELSE {colours[4][channel]}::DOUBLE END"


def _step_sql(d: str, channel: int) -> str:
    inner = " ".join(f"WHEN {d} <= {hi} THEN {dims.DEVIATION_COLOURS[i][channel]}::DOUBLE" for i, (_, hi) in enumerate(_BANDS))
    return f"CASE {inner} ELSE {dims.DEVIATION_COLOURS[4][channel]}::DOUBLE END"


@query(f"WITH {PTS}, t AS (SELECT (floor(abs(z) * 4) * 250)::INTEGER AS mm, count(*) AS n FROM pts GROUP BY 1) SELECT mm, n, {', '.join(f'floor(({_gradient_sql('mm / 1000.0::DOUBLE', i)}) * 1e6 + 0.5) / 1e6 AS {c}' for i, c in enumerate('rgb'))} FROM t")
def gradient_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient at each quarter of a metre that the heights reach, and how many points lie from there on."""
    ticks = sites.points(spark, sf_dir).groupBy((F.floor(F.abs("z") * 4) * 250).cast("int").alias("mm")).agg(F.count("*").alias("n"))
    c = S.deviation_gradient(F.col("mm") / 1000)
    return _rounded(ticks.select("mm", "n", *[c[n].alias(n) for n in "rgb"]), *"rgb")


#: What each of the fourteen modes shows: of points or registered lines, which distance, and how it is coloured.
MODES = [
    *[("points", d, style) for d in ("dist", "dist_xy", "dist_z") for style in ("classes", "gradient")], ("points", None, "original"), ("points", None, "utility"),
    *[("lines", d, style) for d in ("dev", "dev_xy", "dev_z") for style in ("classes", "gradient")],
]


def _mode_sql(mode: int) -> str:
    _, metric, style = MODES[mode]
    if metric is None:
        own = ("0.5", "0.25", "0.5") if style == "original" else ("(utility_type % 3) / 2.0", "0.0", "1.0")
        return f"SELECT {mode} AS mode, instance, " + ", ".join(f"{v}::DOUBLE AS {c}" for v, c in zip(own, "rgb")) + " FROM hue"
    of = _step_sql if style == "classes" else _gradient_sql
    shades = ", ".join(f"CASE WHEN inside THEN {of(metric, i)} ELSE {0.5 if c != 'g' else 0.25}::DOUBLE END AS {c}" for i, c in enumerate("rgb"))
    return f"SELECT {mode} AS mode, instance, {shades} FROM hue"


@query(f"""WITH {PTS}, {SEG}, {nearest_sql()}, best AS (SELECT pid, any_value(instance) AS instance, any_value(utility_type) AS utility_type, any_value(x) AS x, any_value(y) AS y, arg_min({{'a': sqrt(xy2), 'b': abs(ez)}}, {{'d': xy2 + ez * ez, 's': seg_id}}) AS m,
  sqrt(min(xy2 + ez * ez)) AS dist FROM pairs GROUP BY pid), hue AS (SELECT instance, utility_type, dist, m.a AS dist_xy, m.b AS dist_z, {IN_TRENCH} AS inside FROM best),
every AS ({' UNION ALL '.join(_mode_sql(i) for i in range(8))})
SELECT mode, instance, count(*) AS n, floor(avg(r) * 1e6 + 0.5) / 1e6 AS r, floor(avg(g) * 1e6 + 0.5) / 1e6 AS g, floor(avg(b) * 1e6 + 0.5) / 1e6 AS b FROM every GROUP BY mode, instance""")
def mode_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean colour of each instance's points in the eight modes of points: two styles of three distances, outside of the
    trench their own colour, and their own and their type's."""
    found = nearest.nearest_segment(sites.points(spark, sf_dir), sites.segments(spark, sf_dir))
    own = F.struct(F.lit(0.5).alias("r"), F.lit(0.25).alias("g"), F.lit(0.5).alias("b"))
    utility = F.struct(((F.col("utility_type") % 3).cast("double") / 2).alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"))
    # one pass over the points for all modes
    modes = F.explode(F.array(*[F.struct(F.lit(i).alias("mode"), deviation.mode_colour(MODES[i], _inside(), own, utility).alias("c")) for i in range(8)]))
    rows = found.select("instance", modes.alias("m"))
    out = rows.groupBy(F.col("m.mode").alias("mode"), "instance").agg(F.count("*").alias("n"), *[F.avg(f"m.c.{c}").alias(c) for c in "rgb"])
    return _rounded(out, *"rgb")


@query(f"""WITH {FEAT}, q AS (SELECT 'water pipes' AS question, count(*) AS answer FROM feat WHERE layer = 'Vandledning'
UNION ALL SELECT 'wider than 100 mm', count(*) FROM feat WHERE hw > 0 AND fid % 100 = 4 UNION ALL SELECT 'supplies of the traces', count(DISTINCT supply) FROM feat WHERE layer = 'Ledningstrace'
UNION ALL SELECT 'owners of gas pipes', count(DISTINCT fid % 9) FROM feat WHERE layer = 'Gasledning' UNION ALL SELECT 'left when all but water is hidden', count(*) FROM feat WHERE layer = 'Vandledning') SELECT * FROM q""")
def example_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's questions as SQL over a view."""
    G.derived(sites.features(spark, sf_dir)).createOrReplaceTempView("asked_features")
    asked = {
        "water pipes": "layer = 'Vandledning'", "wider than 100 mm": "TRY_CAST(attrs['bredde'] AS double) > 100", "left when all but water is hidden": "layer IN ('Vandledning')",
    }
    parts = [f"SELECT '{q}' AS question, count(*) AS answer FROM asked_features WHERE {where}" for q, where in asked.items()]
    parts.append("SELECT 'supplies of the traces' AS question, count(DISTINCT supply) AS answer FROM asked_features WHERE layer = 'Ledningstrace'")
    parts.append("SELECT 'owners of gas pipes' AS question, count(DISTINCT attrs['ledningsejer']) AS answer FROM asked_features WHERE layer = 'Gasledning'")
    return spark.sql(" UNION ALL ".join(parts))


@query(f"""WITH {SEG}, {COMP}, c AS (SELECT 'segment' AS kind, seg_id AS id, sqrt(((x1 + x2) / 2 - 5.0) ** 2 + ((y1 + y2) / 2 - 4.6) ** 2 + ((z1 + z2) / 2 - -0.5) ** 2) AS d, 2.0 AS w FROM seg
UNION ALL SELECT 'component', comp_id, sqrt((x - 5.0) ** 2 + (y - 4.6) ** 2 + (z - -0.5) ** 2), 1.0 FROM comp)
SELECT kind, id, floor(d * 1e6 + 0.5) / 1e6 AS distance FROM c WHERE d <= w ORDER BY d, kind, id LIMIT 1""")
def overview_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(site.overview_pick((5.0, 4.6, -0.5), sites.components(spark, sf_dir), sites.segments(spark, sf_dir)), "distance")


VIEW = [[1.0, 0.0, 0.0, -5.0], [0.0, 1.0, 0.0, -5.0], [0.0, 0.0, 1.0, -20.0], [0.0, 0.0, 0.0, 1.0]]
PROJECTION = [[1.5, 0.0, 0.0, 0.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, -1.0, -0.2], [0.0, 0.0, -1.0, 0.0]]


@query(f"""WITH {PTS}, e AS (SELECT pid, x - 5.0 AS ex, y - 5.0 AS ey, z - 20.0 AS ez FROM pts), c AS (SELECT pid, ez, 1.5 * ex / -ez AS nx, 2.0 * ey / -ez AS ny, (-ez - 0.2) / -ez AS nz FROM e WHERE abs(ez) > 1e-9)
SELECT pid, ez::DOUBLE AS depth FROM c WHERE nz BETWEEN -1 AND 1 AND ((nx * 0.5 + 0.5) * 800 - 400) ** 2 + ((1 - (ny * 0.5 + 0.5)) * 600 - 300) ** 2 <= 100 ORDER BY ez DESC, pid LIMIT 1""")
def screen_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.screen_pick(sites.points(spark, sf_dir), VIEW, PROJECTION, 800.0, 600.0, 400.0, 300.0)


@query(f"""WITH {VX}, w AS (SELECT fid, vid, x, y, z, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM vx WINDOW o AS (PARTITION BY fid ORDER BY vid)),
m AS (SELECT fid, coalesce(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2) * (x + nx) / 2) / nullif(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 0), avg(x)) AS x,
  coalesce(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2) * (y + ny) / 2) / nullif(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 0), avg(y)) AS y, arg_min(z, vid) AS z FROM w GROUP BY fid)
SELECT fid, {_r('x', 'y', 'z')} FROM m""")
def representative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(shapes.representative_points(sites.vertices(spark, sf_dir).select("fid", "vid", "x", "y", "z"), "fid", F.lit(False)), *"xyz")


@query(f"""WITH {PTS}, e AS (SELECT * FROM (VALUES {_EDGES}) AS e(ax, ay, bx, by_)), p AS (SELECT pid, x, y, {IN_TRENCH} AS inside FROM pts),
t AS (SELECT *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2), 0.0), 1.0) AS t FROM p, e),
d AS (SELECT pid, bool_or(inside) AS inside, min((x - (ax + t * (bx - ax))) ** 2 + (y - (ay + t * (by_ - ay))) ** 2) AS d2 FROM t GROUP BY pid) SELECT pid, inside FROM d WHERE inside OR d2 <= 4.0""")
def trench_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the trench's polygon or within 2 m of it."""
    return sites.points(spark, sf_dir).filter(near_polygon(F.col("x"), F.col("y"), TRENCH, 2.0)).select("pid", _inside().alias("inside"))


@query(f"""WITH {VX}, c AS (SELECT fid, count(*) AS n FROM vx GROUP BY fid HAVING count(*) >= 3), i AS (SELECT fid, unnest(range(1, n - 1)) AS i FROM c) SELECT fid, (i - 1)::INTEGER AS triangle, 0 AS a, i::INTEGER AS b, (i + 1)::INTEGER AS c FROM i""")
def ring_fans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.fan(sites.features(spark, sf_dir).select("fid", F.col("parts")[0].alias("ring")), "fid")


@query(f"WITH {VX}, n AS (SELECT fid, count(*) AS n_vertices FROM vx GROUP BY fid) SELECT fid, n_vertices, coalesce(sum(n_vertices) OVER (ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM n")
def merged_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.merged_vertices(sites.vertices(spark, sf_dir).groupBy("fid").agg(F.count("*").alias("n_vertices")), "fid")


@query(f"""WITH {PTS}, {SEG}, t AS (SELECT pid, seg_id, x, y, x1, y1, z1, z2, x2 - x1 AS dx, y2 - y1 AS dy,
  CASE WHEN (x2 - x1) ** 2 + (y2 - y1) ** 2 > 1e-12 THEN least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0.0), 1.0) ELSE 0.0 END AS t FROM pts, seg),
b AS (SELECT pid, arg_min(z1 + t * (z2 - z1), {{'d': (x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2, 's': seg_id}}) AS draped_z FROM t GROUP BY pid) SELECT pid, {_r('draped_z')} FROM b""")
def draped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = accuracy.drape(sites.points(spark, sf_dir).select("pid", "x", "y"), sites.segments(spark, sf_dir).drop("x", "y", "z"))
    return _rounded(out.select("pid", "draped_z"), "draped_z")


@query(f"WITH {PTS} SELECT site_id, CASE WHEN class = 5 THEN -1 ELSE class END AS label, count(*) AS n, class = 5 AS is_noise FROM pts GROUP BY ALL")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("class") == 5, F.lit(-1)).otherwise(F.col("class"))
    return cluster.label_counts(sites.points(spark, sf_dir).withColumn("label", label))


@query(f"WITH {PTS} SELECT site_id, 0 AS instance_id, 7 AS utility_type, count(*) AS n FROM pts WHERE class = 0 GROUP BY site_id")
def main_to_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.main_to_water(sites.points(spark, sf_dir)).groupBy("site_id", "instance_id", "utility_type").agg(F.count("*").alias("n"))


@query(f"WITH {PTS}, b AS (SELECT site_id, instance, min(z) AS low, max(z) AS high FROM pts GROUP BY ALL) SELECT site_id, instance, {_r('low', 'high')} FROM b")
def clouds_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clouds of seven sites put together, and each instance's heights."""
    pts = sites.points(spark, sf_dir)
    clouds = {str(i): pts.filter(F.col("site_id") == i).drop("site_id") for i in range(7)}
    rows = shapes.joined_clouds(clouds).withColumn("site_id", F.col("site_id").cast("int"))
    return _rounded(rows.groupBy("site_id", "instance").agg(F.min("z").alias("low"), F.max("z").alias("high")), "low", "high")


@query()
def instance_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.convex_hull(sites.points(spark, sf_dir), "instance")


@query()
def instance_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.oriented_boxes(sites.points(spark, sf_dir), "instance").select("instance", "centre", "extent")
