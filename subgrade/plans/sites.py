"""The given tables read as one site: events are measured points, customers' orders are registered features, parts are
components. The SQL beside each view is the same view for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.functions import scalars as S
from subgrade.operators import depth, segments as G

TRENCH = [(1.0, 1.0), (8.0, 2.0), (6.0, 7.0), (2.0, 6.0)]
TX, TY, TZ = 500000.0, 6200000.0, 30.0
SAMPLE_STEP = 0.02


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pid"), ((F.col("user_id") % 50).cast("double") / 5).alias("x"),
        ((F.col("event_id") % 997).cast("double") / 100).alias("y"), (F.col("value") / -10).alias("z"), F.col("event_type").alias("instance"),
        (F.col("event_id") % 6).cast("int").alias("class"), (F.col("user_id") % 12).cast("int").alias("utility_type"),
        (F.col("user_id") % 7).cast("int").alias("site_id"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEATURE_SCHEMA and fid, one part each, in local coordinates."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    z = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(-99.0)).otherwise(F.col("o_totalprice") / -100000)
    y = (c % 101).cast("double") / 10 + (k % 7).cast("double") / 100
    vertex = F.struct(k.alias("k"), ((k % 1009).cast("double") / 100).alias("x"), y.alias("y"), z.alias("z"))
    grouped = _table(spark, sf_dir, "orders").groupBy(c.alias("fid")).agg(F.array_sort(F.collect_list(vertex)).alias("part"))
    f = F.col("fid")
    layer = F.when(f % 50 == 4, "Ledningstrace").when(f % 4 == 0, "Vandledning").when(f % 4 == 1, "Afloebsledning").when(f % 4 == 2, "Elledning").otherwise("Gasledning")

    def pick(of: Column, *values: str | None) -> Column:
        return S.chain([(of == i, F.lit(v)) for i, v in enumerate(values)])

    attrs = {
        "driftsstatus": F.when(f % 4 == 0, " Ude af Drift").otherwise("i drift"),
        "vejledendeDybde": F.when(f % 7 == 0, "1500"),
        "bredde": F.when(f % 100 == 4, "500"),
        "forsyningsart": F.when(f % 50 == 4, pick(F.floor(f / 50) % 3, "vand", "El", "Fjernvarme")),
        "ledningsejer": F.concat(F.lit("Ejer "), (f % 9).cast("string")),
        "noejagtighedsklasse": pick(f % 6, "<= 0,50 m", "> 2.00 m", "> 1.00", "<= 3 m", "ukendt", None),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in attrs.items()])
    parts = F.array(F.transform("part", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))))
    return grouped.select(
        "fid", layer.alias("layer"), f.cast("string").alias("feature_id"), F.lit("LineString").alias("geom_type"), parts.alias("parts"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("attrs"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with their depths resolved over a ground at 0."""
    rows = G.vertices(G.derived(features(spark, sf_dir)))
    return depth.resolve(rows, F.lit(0.0), ["feature_id", "part_idx"])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.segments(vertices(spark, sf_dir), "feature_id", "part_idx")
    return rows.withColumns({"seg_id": F.col("fid") * 1000 + F.col("seg_idx"), "hw": F.col("half_width")})


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    layer = S.chain([(F.col("p_type") == t, F.lit(n)) for t, n in COMPONENT_OF_TYPE.items()])
    z = F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.lit(-99.0)).otherwise(F.col("p_size").cast("double") / -20)
    return _table(spark, sf_dir, "part").select(p.alias("comp_id"), layer.alias("layer"), (F.col("p_size").cast("double") / 5).alias("x"), (F.col("p_retailprice") / 200).alias("y"), z.alias("z"))


COMPONENT_OF_TYPE = {
    "STANDARD": "Vandkomponent", "LARGE": "Afloebskomponent", "SMALL": "Gaskomponent", "ECONOMY": "Elkomponent",
    "MEDIUM": "TermiskKomponent", "PROMO": "Oliekomponent",
}

PTS = """pts AS (SELECT event_id AS pid, CAST(user_id % 50 AS DOUBLE) / 5 AS x, CAST(event_id % 997 AS DOUBLE) / 100 AS y,
  value / -10 AS z, event_type AS instance, CAST(event_id % 6 AS INTEGER) AS class,
  CAST(user_id % 12 AS INTEGER) AS utility_type, CAST(user_id % 7 AS INTEGER) AS site_id FROM events)"""

FEAT = """feat AS (SELECT fid, CASE WHEN fid % 50 = 4 THEN 'Ledningstrace' WHEN fid % 4 = 0 THEN 'Vandledning'
    WHEN fid % 4 = 1 THEN 'Afloebsledning' WHEN fid % 4 = 2 THEN 'Elledning' ELSE 'Gasledning' END AS layer,
  fid % 4 <> 0 AS is_active, CASE WHEN fid % 7 = 0 THEN 1500.0 END AS indicative_mm,
  CASE WHEN fid % 100 = 4 THEN 0.25 WHEN fid % 50 = 4 THEN 0.125 ELSE 0.0 END AS hw,
  CASE WHEN fid % 50 = 4 THEN ['vand', 'El', 'Fjernvarme'][(fid // 50) % 3 + 1] END AS supply,
  ['<= 0,50 m', '> 2.00 m', '> 1.00', '<= 3 m', 'ukendt', NULL][fid % 6 + 1] AS accuracy,
  [0.5, 2.0, 1.0, 2.0, NULL, NULL][fid % 6 + 1] AS acc_width, [2, 5, 3, 4, NULL, NULL][fid % 6 + 1] AS acc_class
  FROM (SELECT DISTINCT o_custkey AS fid FROM orders))"""

VX = f"""{FEAT}, raw AS (SELECT f.*, row_number() OVER (PARTITION BY fid ORDER BY o_orderkey) - 1 AS vid,
    CAST(o_orderkey % 1009 AS DOUBLE) / 100 AS x,
    CAST(o_custkey % 101 AS DOUBLE) / 10 + CAST(o_orderkey % 7 AS DOUBLE) / 100 AS y,
    CASE WHEN o_orderpriority = '1-URGENT' THEN -99.0::DOUBLE ELSE o_totalprice / -100000 END AS z
  FROM orders JOIN feat f ON f.fid = o_custkey),
vx AS (SELECT * EXCLUDE (z, part_mean), CASE WHEN z <> -99 THEN z WHEN indicative_mm IS NOT NULL THEN 0 - indicative_mm / 1000
    WHEN part_mean IS NOT NULL THEN part_mean ELSE 0 END AS z,
    CASE WHEN z <> -99 THEN 1 WHEN indicative_mm IS NOT NULL THEN 2 WHEN part_mean IS NOT NULL THEN 3 ELSE 5 END AS depth_source
  FROM (SELECT *, avg(CASE WHEN z <> -99 THEN z END) OVER (PARTITION BY fid) AS part_mean FROM raw))"""

SEG = f"""{VX}, seg AS (SELECT * FROM (SELECT fid, fid * 1000 + vid AS seg_id, layer, supply, is_active, hw, acc_width,
    x AS x1, y AS y1, z AS z1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2
  FROM vx WINDOW w AS (PARTITION BY fid ORDER BY vid)) WHERE x2 IS NOT NULL)"""

COMP = "comp AS (SELECT p_partkey AS comp_id, CASE p_type " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in COMPONENT_OF_TYPE.items()) + """ END AS layer,
  CAST(p_size AS DOUBLE) / 5 AS x, p_retailprice / 200 AS y,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN -99.0::DOUBLE ELSE CAST(p_size AS DOUBLE) / -20 END AS z FROM part)"""


def nearest_sql(points_: str = "pts", segments_: str = "seg", on: str = "TRUE", active: bool = False) -> str:
    """pairs: every point with every segment, and d2, xy2, dz by the distance's definition."""
    return f"""pairs0 AS (SELECT p.*, s.seg_id, s.is_active, s.hw, x2 - x1 AS dx, y2 - y1 AS dy, z2 - z1 AS dz_, x1, y1, z1
    FROM {points_} p JOIN {segments_} s ON {on}),
pairs1 AS (SELECT *, CASE WHEN dx * dx + dy * dy + dz_ * dz_ > 1e-12 THEN least(greatest(
      ((x - x1) * dx + (y - y1) * dy + (z - z1) * dz_) / (dx * dx + dy * dy + dz_ * dz_), 0.0), 1.0) ELSE 0.0 END AS t FROM pairs0),
pairs2 AS (SELECT *, x - (x1 + t * dx) AS ex, y - (y1 + t * dy) AS ey, z - (z1 + t * dz_) AS ez, sqrt(dx * dx + dy * dy) AS flat FROM pairs1),
pairs AS (SELECT *, CASE WHEN hw > 1e-9 THEN greatest(CASE WHEN flat > 1e-12 THEN abs(ey * dx - ex * dy) / flat ELSE 0.0 END - hw, 0.0) ** 2
    ELSE ex * ex + ey * ey END AS xy2 FROM pairs2)"""
