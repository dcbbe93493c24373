"""Clouds to PLY, LAS and colour tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.functions import scalars as S
from subgrade.functions.dims import DEVIATION_COLOURS, DEVIATION_LABELS

_PLY_TYPES = {"double": "float", "float": "float", "int": "int", "bigint": "int", "smallint": "uchar", "tinyint": "uchar"}


def ply_lines(points: DataFrame, by: str, fields: list[str], order: str = "point_id") -> DataFrame:
    """by, place, line: an ASCII file's lines for each `by`. x, y, z have six decimals; red, green, blue are bytes."""
    kinds = dict(points.dtypes)
    names = {c: ("float" if c in "xyz" else "uchar" if c in ("red", "green", "blue") else _PLY_TYPES[kinds[c]]) for c in fields}
    head = [F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("n"))]
    head += [F.lit(f"property {t} {c}") for c, t in names.items()] + [F.lit("end_header")]
    heads = points.groupBy(by).agg(F.count("*").alias("n")).select(by, F.posexplode(F.array(*head)).alias("at", "line"))
    heads = heads.select(by, (F.col("at") - 1000).cast("long").alias("place"), "line")
    text = [F.format_string("%.6f", F.col(c).cast("double")) if c in "xyz" else F.col(c).cast("string") for c in fields]
    rows = points.select(by, F.col(order).cast("long").alias("place"), F.concat_ws(" ", *text).alias("line"))
    return heads.unionByName(rows)


def write_ply(points: DataFrame, path: str, by: str, fields: list[str], order: str = "point_id") -> None:
    """One folder for each `by`, with one file in it; a file is written by one task, as its rows have to be in order."""
    lines = ply_lines(points, by, fields, order)
    lines.repartition(by).sortWithinPartitions(by, "place").select(by, "line").write.partitionBy(by).text(path)


def las_file(rows: pd.DataFrame, has_colour: bool = True, scale: float = 0.001) -> bytes:
    """LAS 1.4 of rows x, y, z, classification, intensity and (point format 2) red, green, blue; offsets are whole metres."""
    xyz = rows[["x", "y", "z"]].to_numpy(float)
    offset = np.floor(xyz.min(axis=0)) if len(xyz) else np.zeros(3)
    kind = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
    kind += [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")] if has_colour else []
    body = np.zeros(len(rows), dtype=kind)
    for i, c in enumerate("xyz"):
        body[c] = np.rint((xyz[:, i] - offset[i]) / scale)
    for c in ("intensity", "classification", *(("red", "green", "blue") if has_colour else ())):
        body[c] = rows[c].to_numpy()
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if len(xyz) else (np.zeros(3), np.zeros(3))
    n = len(rows)
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 4, b"", b"subgrade", 1, 1, 375, 375, 0, 2 if has_colour else 0, body.itemsize, n, n, 0, 0, 0, 0)
    head += struct.pack("<12d", scale, scale, scale, *offset, *[v for i in range(3) for v in (high[i], low[i])])
    head += struct.pack("<QQIQ15Q", 0, 0, 0, n, n, *[0] * 14)
    return head + body.tobytes()


def las_files(rows: DataFrame, by: str) -> DataFrame:
    """by, content: a LAS file of each `by` (a site's metric and tile, so that a file fits a task). Empty ones aren't made."""
    kind = dict(rows.dtypes)[by]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [las_file(pdf, "red" in pdf)]})

    return rows.groupBy(by).applyInPandas(pack, f"{by} {kind}, content binary")


def write_binary(files: DataFrame, path: str, by: str, suffix: str) -> None:
    """Each content as <path>/<by><suffix>, written by the tasks to the store that path names."""

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r[by]}{suffix}") as out:
                out.write(bytes(r["content"]))

    files.foreachPartition(put)


def colour_table(spark: SparkSession) -> DataFrame:
    """value, red, green, blue, alpha, label of the five classes."""
    rows = [(i + 1, *c, label) for i, (c, label) in enumerate(zip(DEVIATION_COLOURS, DEVIATION_LABELS))]
    table = spark.createDataFrame(rows, "value int, r double, g double, b double, label string")
    return table.select("value", *[S.table_byte(F.col(c)).alias(n) for c, n in zip("rgb", ("red", "green", "blue"))], F.lit(255).alias("alpha"), "label")


def write_colour_table(spark: SparkSession, path: str) -> None:
    colour_table(spark).orderBy("value").select(F.concat_ws(",", "value", "red", "green", "blue", "alpha", "label").alias("line")).coalesce(1).write.text(path)


def write_sidecar(rows: DataFrame, path: str) -> None:
    """A JSON document of the row; a trench only with at least three vertices."""
    kept = rows.filter(F.size("vertices") >= 3) if "vertices" in rows.columns else rows
    kept.coalesce(1).write.json(path)
