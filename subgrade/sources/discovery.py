"""Which files belong to a site: the rules by which runs of segmentation and labelling are found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*.ply") -> DataFrame:
    """path, folder and name of the files below path; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    p = F.col("path")
    return rows.select(p, F.element_at(F.split(p, "/"), -2).alias("folder"), F.element_at(F.split(p, "/"), -1).alias("name"))


def tier(folder: Column) -> Column:
    """A run folder's rank: a dated run, then labelled runs, then the plain labelled folder, then the older layout."""
    return F.when(folder.rlike(r"^\d"), 1).when(folder.startswith("labeled_"), 2).when(folder == "labeled", 3).when(folder.rlike(r"_instances_"), 4)


def latest_run(files: DataFrame, by: list[str] | None = None, ranks: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """The files of each base's best run folder: the first rank there is, and of that the last name."""
    by = by or []
    order = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("tier"))
    runs = files.withColumn("tier", tier(F.col("folder"))).filter(F.col("tier").isin(*ranks))
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(order, F.desc("folder")))
    return runs.withColumn("place", place).filter("place = 1").drop("place", "tier")


def labelled_run(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As latest_run, labelled folders only, and always the files at the top of the instances folder."""
    top = files.filter(F.col("folder").endswith("_Instances"))
    return latest_run(files, by, (2, 3)).unionByName(top)


def site_files(files: DataFrame, area: int) -> DataFrame:
    """An area's site clouds: not of folders for fine-tuning, and not copies in global coordinates. Area 1 isn't 10."""
    in_area = F.col("path").rlike(rf"Area_?{area}(?!\d)")
    return files.filter(in_area & ~F.col("path").contains("Finetuning") & F.col("name").rlike(r"^Area_.*_Site_.*\.ply$") & ~F.col("name").contains("_utm"))


def instances_of(files: DataFrame, cloud: str) -> DataFrame:
    """The instance files of the cloud at path `cloud`, out of all below its folder.

    Of <base>_Instances the best run (latest_run). Without such a folder, of the older <base>_instances_<stamp> or
    <stem>_instances_<stamp> the last by name: its labelled/ if there is one, else the files in it. LookupError if there is
    neither.
    """
    parent, name = cloud.rstrip("/").rsplit("/", 1)
    stem = name.rsplit(".", 1)[0]
    base = re.sub(r"^Area_\d+_", "", stem)
    below = F.element_at(F.split("path", re.escape(parent.rsplit("/", 1)[-1]) + "/"), -1)
    rows = files.filter(F.col("path").contains(f"{parent.split(':', 1)[-1].lstrip('/')}/")).withColumn("below", below)
    owner = F.split("below", "/")[0]
    kept = rows.filter(owner == f"{base}_Instances").drop("below")
    if not kept.isEmpty():
        return latest_run(kept)
    # the two spellings of an older folder are one list
    old = rows.filter(owner.startswith(f"{base}_instances_") | owner.startswith(f"{stem}_instances_")).withColumn("owner", owner)
    last = old.agg(F.max("owner").alias("owner"))
    own = old.join(F.broadcast(last), "owner", "left_semi")  # one row
    labelled = own.filter(F.col("folder") == "labeled")
    found = labelled if not labelled.isEmpty() else own.filter(F.col("folder") == F.col("owner"))
    if found.isEmpty():
        raise LookupError(f"no instances of {name}")
    return found.drop("below", "owner")
