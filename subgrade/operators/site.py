"""What of a site is looked at: its box, its layers, one instance and what belongs to it, and what is picked on the screen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.functions.dims import LINE_LAYERS, SITE_BUFFER, TARGET_CLASS, TRACE_LAYER
from subgrade.functions.geometry import Seg, box_meets_rect, rect_clip
from subgrade.operators import match, segments as G


def cloud_box(points: DataFrame, buffer: float = SITE_BUFFER) -> tuple[float, float, float, float] | None:
    """minx, miny, maxx, maxy of the points and `buffer` around; None without points."""
    row = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if row[0] is None else (row[0] - buffer, row[1] - buffer, row[2] + buffer, row[3] + buffer)


def box_near(box: tuple[float, float, float, float], minx: float, miny: float, maxx: float, maxy: float, buffer: float = 0.0) -> Column:
    """Whether a box, wider by buffer on each side, shares a point with a rectangle, edges included."""
    return box_meets_rect(F.lit(box[0] - buffer), F.lit(box[1] - buffer), F.lit(box[2] + buffer), F.lit(box[3] + buffer), minx, miny, maxx, maxy)


def meeting(segment_rows: DataFrame, box: tuple[float, float, float, float], by: str = "feature_id") -> DataFrame:
    """The features with a segment that truly meets the box; one whose own box only does is none."""
    return segment_rows.filter(rect_clip(Seg.of(F.col), *box).isNotNull()).select(by).distinct()


def target(points: DataFrame, wanted: int = TARGET_CLASS) -> DataFrame:
    """points with is_target; the others are the background."""
    return points.withColumn("is_target", F.coalesce(F.col("class") == wanted, F.lit(False)))


def visible(rows: DataFrame, layers: list[str] | None, by: str = "layer") -> DataFrame:
    """The rows of the layers that are shown; None shows all."""
    return rows if layers is None else rows.filter(F.col(by).isin(layers))


def utility_filter(instances: DataFrame, segments: DataFrame, chosen: tuple[int, str] | None) -> DataFrame:
    """kind, utility_type, name, is_visible of all instances (utility_type, instance) and all storage keys: with a choice only
    that instance and the keys its type is compared with, none if its type has no layers; without one everything."""
    rows = instances.select(F.lit("instance").alias("kind"), "utility_type", F.col("instance").alias("name")).distinct()
    keys = segments.select(F.lit("layer").alias("kind"), F.lit(None).cast("int").alias("utility_type"), F.col("storage_key").alias("name")).distinct()
    if chosen is None:
        return rows.unionByName(keys).withColumn("is_visible", F.lit(True))
    kind, name = chosen
    # keys are as many as layers and supplies
    belongs = match.bridge(segments).filter(F.col("utility_type") == kind).select(F.col("storage_key").alias("name"), F.lit(True).alias("hit"))
    shown = rows.withColumn("is_visible", (F.col("utility_type") == kind) & (F.col("name") == name))
    return shown.unionByName(keys.join(F.broadcast(belongs), "name", "left").withColumn("is_visible", F.coalesce("hit", F.lit(False))).drop("hit").select(*shown.columns))


def legend(segment_rows: DataFrame) -> DataFrame:
    """storage_key, place: in the order of the layers, those of the trace layer last, and by name within a layer."""
    at = F.array_position(F.array(*[F.lit(x) for x in LINE_LAYERS]), F.col("layer"))
    known = F.when(at > 0, at).otherwise(F.lit(len(LINE_LAYERS) + 1))
    keys = segment_rows.select("layer", "storage_key").distinct()
    order = F.struct((F.col("layer") == TRACE_LAYER).alias("trace"), known.alias("known"), F.col("layer"), F.col("storage_key"))
    listed = keys.agg(F.array_sort(F.collect_list(order)).alias("all"))  # a name for each layer and supply
    return listed.select(F.posexplode("all").alias("i", "o")).select((F.col("i") + 1).alias("place"), F.col("o.layer").alias("layer"), F.col("o.storage_key").alias("storage_key"))


def screen_pick(points: DataFrame, view: list[list[float]], projection: list[list[float]], width: float, height: float, sx: float, sy: float, radius: float = 10.0) -> DataFrame:
    """The front-most point (pid, depth) whose pixel lies within radius of (sx, sy), the smallest pid on ties; no row if none does.

    view and projection are 4 x 4 and act on columns; depth is the height in camera space, which is less the farther off.
    """
    turn = lambda m, v: [sum((F.lit(float(m[i][j])) * v[j] for j in range(1, 4)), F.lit(float(m[i][0])) * v[0]) for i in range(4)]
    eye = turn(view, [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)])
    clip = turn(projection, eye)
    rows = points.select("pid", eye[2].alias("depth"), *[c.alias(f"c{i}") for i, c in enumerate(clip)]).filter(F.abs("c3") > 1e-9)
    rows = rows.withColumns({f"n{i}": F.col(f"c{i}") / F.col("c3") for i in range(3)}).filter(F.col("n2").between(-1.0, 1.0))
    px, py = (F.col("n0") * 0.5 + 0.5) * width, (F.lit(1.0) - (F.col("n1") * 0.5 + 0.5)) * height
    hits = rows.filter((px - sx) ** 2 + (py - sy) ** 2 <= radius * radius)
    return hits.agg(F.max_by(F.struct("pid", "depth"), F.struct("depth", -F.col("pid"))).alias("b")).filter("b is not null").select("b.pid", "b.depth")


def overview_pick(hit: tuple[float, float, float], components: DataFrame, segments: DataFrame, near_segment: float = 2.0, near_component: float = 1.0) -> DataFrame:
    """One row kind, id, distance: the segment whose midpoint is nearest to the hit, or a nearer component, each within its
    radius; null where there is none."""
    far = lambda x, y, z: F.sqrt((x - hit[0]) ** 2 + (y - hit[1]) ** 2 + (z - hit[2]) ** 2)
    middle = [(F.col(f"{c}1") + F.col(f"{c}2")) / 2 for c in "xyz"]
    s = segments.select(F.lit("segment").alias("kind"), F.col("seg_id").alias("id"), far(*middle).alias("distance")).filter(F.col("distance") <= near_segment)
    c = components.select(F.lit("component").alias("kind"), F.col("comp_id").alias("id"), far(F.col("x"), F.col("y"), F.col("z")).alias("distance")).filter(F.col("distance") <= near_component)
    best = s.unionByName(c).agg(F.min(F.struct("distance", "kind", "id")).alias("b"))
    return best.select("b.kind", "b.id", "b.distance")


@dataclass
class SiteSession:
    """A site's cloud and registry in local coordinates; what it gives are DataFrames that nothing has been read for yet,
    but for the box, which is one row."""

    spark: SparkSession
    points: DataFrame
    features: DataFrame
    components: DataFrame
    buffer: float = SITE_BUFFER

    @property
    def box(self) -> tuple[float, float, float, float]:
        found = cloud_box(self.points, self.buffer)
        if found is None:
            raise ValueError("the site's cloud has no points")
        return found

    def segments(self) -> DataFrame:
        return G.segments(G.vertices(G.derived(self.features)), "feature_id", "part_idx")

    def features_near(self) -> DataFrame:
        """features with a segment within the box; layers without any have no rows."""
        rows = self.segments().withColumn("hw", F.lit(0.0))
        return self.features.join(meeting(rows, self.box), "feature_id", "left_semi")

    def components_near(self) -> DataFrame:
        b = self.box
        return self.components.filter(F.col("x").between(b[0], b[2]) & F.col("y").between(b[1], b[3]))
