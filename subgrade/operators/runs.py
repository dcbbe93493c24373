"""What is decided by hand, kept as runs: labels of instances and selections of features.

A store is a folder of append-only tables, a folder for each run; nothing that was written is changed. Of each key the last
run that has it counts, so a later run may decide about a few keys only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from subgrade.functions import scalars as S
from subgrade.functions.dims import TRACE_LAYER

# The labels, in the order of their numbers from 1; the colour of what is chosen.
LABELS = (
    "PowerLine", "DrainageLine", "OilPipeLine", "GasLine", "ThermalLine", "Conduit", "WaterLine", "TelecomunicationLine", "OtherLine",
    "LineUnknownServiceType",
)
CHOSEN_COLOUR, CHOSEN_RADIUS = (1.0, 1.0, 0.0), 0.02
# End of the fixed values.
_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


class RunStore:
    """Tables by kind, each of runs in order of their names (such as times written year first)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, kind: str, rows: DataFrame, run: str) -> None:
        """rows as a run of its own; FileExistsError if it is there, ValueError for a name that is no run's."""
        if not _RUN.fullmatch(run) or not _RUN.fullmatch(kind):
            raise ValueError(f"no name of a run or kind: {run!r}, {kind!r}")
        try:
            rows.write.mode("error").parquet(f"{self.path}/{kind}/run={run}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise FileExistsError(f"{kind} has a run {run!r}") from None
            raise

    def all(self, kind: str) -> DataFrame:
        """Every row of every run, with its run as text."""
        folder = f"{self.path}/{kind}"
        found = self.spark.read.option("mergeSchema", True).parquet(folder).schema
        # a run named by a number is text all the same
        schema = StructType([StructField(f.name, StringType() if f.name == "run" else f.dataType) for f in found.fields])
        return self.spark.read.schema(schema).parquet(folder)

    def latest(self, kind: str, *keys: str) -> DataFrame:
        """The rows of each key's last run. Within it, of rows that repeat a key the one greatest by its other columns."""
        rows = self.all(kind)
        rest = [c for c in rows.columns if c not in (*keys, "run")]
        best = rows.groupBy(*keys).agg(F.max(F.struct("run", *rest)).alias("last"))
        return best.select(*keys, *[F.col(f"last.{c}").alias(c) for c in ("run", *rest)])


def label_number(label: Column) -> Column:
    """A label's number; 0 for a name that is none of them."""
    return S.chain([(label == name, F.lit(i + 1)) for i, name in enumerate(LABELS)] + [(F.lit(True), F.lit(0))])


def assign_labels(store: RunStore, labels: DataFrame, run: str) -> None:
    """labels (site_id, instance, label) as a run, with their numbers as utility_type."""
    store.append("labels", labels.select("site_id", "instance", "label", label_number(F.col("label")).alias("utility_type")), run)


def labelled(instances: DataFrame, store: RunStore) -> DataFrame:
    """instances (site_id, instance, ...) with label, utility_type and run of the last label that each was given; type 0 and
    nulls for those without one."""
    last = store.latest("labels", "site_id", "instance").select("site_id", "instance", "label", F.col("utility_type").alias("given"), "run")
    # one row for each instance on the right, so the left may hold any number
    joined = instances.join(last, ["site_id", "instance"], "left")
    return joined.withColumn("utility_type", F.coalesce("given", F.lit(0))).drop("given")


def select_features(store: RunStore, features: DataFrame, name: str, run: str) -> None:
    """The features of an answer (feature_id) as a run's selection of that name."""
    store.append("selections", features.select(F.lit(name).alias("name"), "feature_id").distinct(), run)


def selected(store: RunStore, name: str) -> DataFrame:
    """feature_id of the last run in which the selection of that name was made; a whole run is replaced by the next."""
    rows = store.all("selections").filter(F.col("name") == name)
    last = rows.agg(F.max("run").alias("run"))
    return rows.join(F.broadcast(last), "run", "left_semi").select("feature_id")  # one row


def highlights(segments: DataFrame, components: DataFrame, chosen: DataFrame, colour: tuple[float, float, float] = CHOSEN_COLOUR, radius: float = CHOSEN_RADIUS) -> DataFrame:
    """What a selection looks like: shape (cylinder, plane, sphere), feature_id, ends, size (radius, or a plane's width) and
    colour of each segment (of a feature with a width a plane, of a trace in its supply's colour) and component chosen."""
    given = F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("rgb", colour)])
    trace = (F.col("layer") == TRACE_LAYER) & F.col("supply").isNotNull() & (F.col("half_width") > 0)
    c = F.when(trace, S.supply_colour(F.col("supply"), given)).otherwise(given)
    ids = chosen.select("feature_id").distinct()
    lines = segments.join(ids, "feature_id", "left_semi").select(
        F.when(F.col("half_width") > 0, "plane").otherwise("cylinder").alias("shape"), "feature_id", "x1", "y1", "z1", "x2", "y2", "z2",
        F.when(F.col("half_width") > 0, F.col("half_width") * 2).otherwise(radius).alias("size"), c.alias("c"),
    )
    points = components.join(ids, "feature_id", "left_semi").select(F.lit("sphere").alias("shape"), "feature_id", *[F.col(n).alias(f"{n}{i}") for i in (1, 2) for n in "xyz"], F.lit(radius * 5).alias("size"), given.alias("c"))
    both = reduce(DataFrame.unionByName, [lines, points])
    return both.select(*[n for n in both.columns if n != "c"], *[F.col(f"c.{n}").alias(n) for n in "rgb"])
