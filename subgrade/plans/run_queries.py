"""Queries over runs of labels and selections, and depths over a local ground."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.functions.dims import SUPPLY_COLOURS
from subgrade.operators import depth, discretise, ground, hulls, runs, segments as G
from subgrade.plans import sites
from subgrade.plans.catalogue import CELLS_SQL, _rounded, query
from subgrade.plans.sites import FEAT, PTS, SEG
from subgrade.tables import new_path, written

_LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in runs.LABELS) + "]"


@query(f"""WITH {PTS}, i AS (SELECT site_id, class AS instance, count(*) AS n FROM pts GROUP BY ALL)
SELECT site_id, instance, n, CASE WHEN site_id % 2 = 0 AND instance < 3 THEN {_LABELS_SQL}[site_id + instance + 1] WHEN site_id > 0 THEN CASE WHEN instance = 5 THEN 'none of them' ELSE {_LABELS_SQL}[instance + 1] END END AS label,
  CASE WHEN site_id % 2 = 0 AND instance < 3 THEN site_id + instance + 1 WHEN site_id > 0 AND instance < 5 THEN instance + 1 ELSE 0 END AS utility_type,
  CASE WHEN site_id % 2 = 0 AND instance < 3 THEN '20250102_080000' WHEN site_id > 0 THEN '20250101_080000' END AS run FROM i""")
def labels_after_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of all sites but one are labelled, some again in a later run, which counts for them."""
    store = runs.RunStore(spark, new_path(spark, "runs"))
    instances = sites.points(spark, sf_dir).groupBy("site_id", F.col("class").alias("instance")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(x) for x in runs.LABELS])
    first = instances.filter("site_id > 0").withColumn("label", F.when(F.col("instance") == 5, "none of them").otherwise(F.get(names, F.col("instance"))))
    second = instances.filter("site_id % 2 = 0 and instance < 3").withColumn("label", F.get(names, F.col("site_id") + F.col("instance")))
    runs.assign_labels(store, second, "20250102_080000")
    runs.assign_labels(store, first, "20250101_080000")
    return runs.labelled(instances, store)


_SUPPLY = " ".join(f"WHEN contains(lower(supply), '{k}') THEN {{'r': {c[0]}::DOUBLE, 'g': {c[1]}::DOUBLE, 'b': {c[2]}::DOUBLE}}" for k, c in SUPPLY_COLOURS)


@query(f"""WITH {SEG}, s AS (SELECT *, CASE WHEN layer = 'Ledningstrace' AND supply IS NOT NULL AND hw > 0 THEN CASE {_SUPPLY} ELSE {{'r': 1.0::DOUBLE, 'g': 1.0::DOUBLE, 'b': 0.0::DOUBLE}} END ELSE {{'r': 1.0::DOUBLE, 'g': 1.0::DOUBLE, 'b': 0.0::DOUBLE}} END AS c FROM seg WHERE fid % 10 = 4)
SELECT CASE WHEN hw > 0 THEN 'plane' ELSE 'cylinder' END AS shape, fid::VARCHAR AS feature_id, floor(x1 * 1e6 + 0.5) / 1e6 AS x1, floor(z2 * 1e6 + 0.5) / 1e6 AS z2, CASE WHEN hw > 0 THEN hw * 2 ELSE 0.02 END::DOUBLE AS size, c.r AS r, c.g AS g, c.b AS b FROM s
UNION ALL SELECT 'sphere', p_partkey::VARCHAR, floor(CAST(p_size AS DOUBLE) / 5 * 1e6 + 0.5) / 1e6, NULL, 0.1, 1.0, 1.0, 0.0 FROM part WHERE p_partkey % 10 = 4 AND p_partkey IN (SELECT fid FROM seg WHERE fid % 10 = 4)""")
def selection_of_the_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection that a second run makes anew, and what it looks like."""
    store = runs.RunStore(spark, new_path(spark, "runs"))
    segs = sites.segments(spark, sf_dir)
    runs.select_features(store, segs.filter("fid % 10 = 3"), "asked", "20250101_080000")
    runs.select_features(store, segs.filter("fid % 10 = 4"), "asked", "20250102_080000")
    runs.select_features(store, segs.filter("fid % 10 = 5"), "other", "20250103_080000")
    parts = sites.components(spark, sf_dir).withColumn("feature_id", F.col("comp_id").cast("string"))
    shown = runs.highlights(segs, parts, runs.selected(store, "asked"))
    return _rounded(shown.select("shape", "feature_id", "x1", F.when(F.col("shape") != "sphere", F.col("z2")).alias("z2"), "size", "r", "g", "b"), "x1", "z2")


@query(f"""WITH {CELLS_SQL}, {FEAT}, span AS (SELECT min(z) - 2 AS low, max(z) + 2 AS high FROM pts),
raw AS (SELECT f.*, row_number() OVER (PARTITION BY fid ORDER BY o_orderkey) - 1 AS vid, CAST(o_orderkey % 1009 AS DOUBLE) / 100 AS x,
  CAST(o_custkey % 101 AS DOUBLE) / 10 + CAST(o_orderkey % 7 AS DOUBLE) / 100 AS y, CASE WHEN o_orderpriority = '1-URGENT' THEN -99.0::DOUBLE ELSE o_totalprice / -100000 END AS z FROM orders JOIN feat f ON f.fid = o_custkey),
d AS (SELECT fid, vid, c.z, (r.x - c.x) * (r.x - c.x) + (r.y - c.y) * (r.y - c.y) AS d2, c.cx * 1000 + c.cy AS cid FROM raw r, cells c WHERE r.z <= -98),
k AS (SELECT *, row_number() OVER (PARTITION BY fid, vid ORDER BY d2, cid) AS rank FROM d),
g AS (SELECT fid, vid, coalesce(max(CASE WHEN rank = 1 AND sqrt(d2) < 1e-9 THEN z END), sum(z / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) AS ground FROM k WHERE rank <= 8 GROUP BY fid, vid),
m AS (SELECT *, avg(CASE WHEN z > -98 THEN z END) OVER (PARTITION BY fid) AS part_mean FROM raw)
SELECT fid, vid, CASE WHEN m.z > -98 THEN 1 WHEN indicative_mm > 0 THEN 2 WHEN part_mean IS NOT NULL THEN 3 ELSE 5 END AS depth_source,
  floor(least(greatest(CASE WHEN m.z > -98 THEN m.z WHEN indicative_mm > 0 THEN ground - indicative_mm / 1000 WHEN part_mean IS NOT NULL THEN part_mean ELSE ground END, low), high) * 1e5 + 0.5) / 1e5 AS z
FROM m LEFT JOIN g USING (fid, vid), span""")
def depth_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices over a ground that follows the cloud's top, which is searched for the missing ones only."""
    points = sites.points(spark, sf_dir)
    samples = ground.top_cells(points).withColumn("pid", F.col("cx") * 1000 + F.col("cy"))
    span = points.agg(F.min("z"), F.max("z")).first()
    level = ground.ground_level(points).first()[0]
    rows = G.vertices(G.derived(sites.features(spark, sf_dir)))
    found = depth.resolve_overview(rows, samples, ground.fit_plane(samples), level, (span[0], span[1]), ["feature_id", "part_idx"], ["feature_id", "part_idx", "vid"])
    return _rounded(found.select("fid", "vid", "depth_source", "z"), "z", to=5)


@query(f"WITH {PTS} SELECT site_id, count(*) AS n_points, 0::BIGINT AS n_outside, 12::BIGINT AS n_edges, TRUE AS is_dotted FROM pts GROUP BY site_id")
def boxes_of_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's box along its hull: how many of its points it leaves out, and its twelve edges as dots."""
    points = sites.points(spark, sf_dir).select("site_id", "x", "y", "z")
    boxes = written(hulls.hull_boxes(points, "site_id"), "hull-boxes")
    edges = hulls.box_edges(boxes, "site_id")
    dots = discretise.dashes(edges.withColumn("seg_id", F.struct("site_id", "seg_id")), 0.05, 0.05)
    told = dots.groupBy(F.col("seg_id.site_id").alias("site_id")).agg(F.countDistinct("seg_id.seg_id").alias("n_edges"), (F.max("dash_idx") > 0).alias("is_dotted"))
    counts = points.join(boxes, "site_id").groupBy("site_id").agg(F.count("*").alias("n_points"), F.count_if(hulls.outside_box()).alias("n_outside"))
    return counts.join(told, "site_id")


@query(f"""WITH {PTS}, e AS (SELECT site_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts GROUP BY site_id)
SELECT site_id, floor(lx * 1e6 + 0.5) / 1e6 AS lx, floor(hx * 1e6 + 0.5) / 1e6 AS hx, floor(ly * 1e6 + 0.5) / 1e6 AS ly, floor(hy * 1e6 + 0.5) / 1e6 AS hy, floor(lz * 1e6 + 0.5) / 1e6 AS lz, floor(hz * 1e6 + 0.5) / 1e6 AS hz, 0::BIGINT AS n_new FROM e""")
def hulls_in_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hulls' corners reach as far as the points do in each direction, and each is one of the points."""
    points = sites.points(spark, sf_dir).select("site_id", "x", "y", "z")
    corners = hulls.hull_corners(points, "site_id").withColumn("corner", F.lit(True))
    known = corners.join(points.distinct().withColumn("known", F.lit(True)), ["site_id", "x", "y", "z"], "left")
    ends = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]
    return _rounded(known.groupBy("site_id").agg(*ends, F.count_if(F.col("known").isNull()).alias("n_new")), *[f"{n}{c}" for c in "xyz" for n in "lh"])
