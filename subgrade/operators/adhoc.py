"""Questions in SQL over a site's layers, in place of generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.functions.scalars import shown


def open_views(features: DataFrame, prefix: str = "") -> list[str]:
    """A temporary view for each layer; returns their names."""
    names = [r.layer for r in features.select("layer").distinct().collect()]  # eleven or so
    for n in names:
        features.filter(F.col("layer") == n).createOrReplaceTempView(f"{prefix}{n}")
    return names


def describe(features: DataFrame, samples: int = 3, width: int = 80) -> DataFrame:
    """layer, attribute, n_given, samples: the first values, in order of text, of each attribute."""
    rows = features.select("layer", F.explode("attrs").alias("attribute", "value"))
    counts = rows.groupBy("layer", "attribute", "value").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("layer", "attribute").orderBy("value")
    ranked = counts.withColumn("place", F.row_number().over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.substring("value", 1, width))))
    return ranked.groupBy("layer", "attribute").agg(F.sum("n").alias("n_given"), shown.alias("samples"))


def schema_of(features: DataFrame, samples: int = 3, width: int = 80) -> DataFrame:
    """As describe, for every layer and every attribute that any layer has: kind (double if all values are numbers, else
    string; unknown without values) and all_null where the layer gives none."""
    told = describe(features, samples, width)
    numbers = features.select("layer", F.explode("attrs").alias("attribute", "value")).groupBy("layer", "attribute").agg(F.every(F.col("value").try_cast("double").isNotNull()).alias("numbers"))
    # one row: the names of the attributes, which are as many as the registry's fields
    names = features.select(F.explode(F.map_keys("attrs")).alias("attribute")).agg(F.collect_set("attribute").alias("names"))
    every = features.select("layer").distinct().crossJoin(F.broadcast(names)).select("layer", F.explode("names").alias("attribute"))
    joined = every.join(told.join(numbers, ["layer", "attribute"]), ["layer", "attribute"], "left")
    kind = F.when(F.col("n_given").isNull(), "unknown").when(F.col("numbers"), "double").otherwise("string")
    return joined.select("layer", "attribute", F.coalesce("n_given", F.lit(0)).alias("n_given"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), kind.alias("kind"), F.col("n_given").isNull().alias("all_null"))


def texts(features: DataFrame, by: str) -> DataFrame:
    """by, name, text: every attribute that any feature has of each feature, a dash where it is null or 'nan'."""
    names = features.select(F.explode(F.map_keys("attrs")).alias("name")).agg(F.collect_set("name").alias("names"))
    rows = features.crossJoin(F.broadcast(names)).select(by, "attrs", F.explode("names").alias("name"))
    return rows.select(by, "name", shown(F.col("attrs")[F.col("name")]).alias("text"))


def ask(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
