"""Shared pieces: tables, written intermediate results, passes over texts, gapless numbering, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of bytes other than these; all are single bytes in UTF-8, so bytes.split() finds the same words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that Arrow hands to a Python worker at a time, and characters of the texts that a task works on at a time.
BATCH_ROWS, BLOCK_CHARS = 1000, 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="subgrade-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/subgrade/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that clashing extra columns never meet its own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows, and their texts, of about `most` characters; a longer text is a run of its own."""
    values = batch.column(column)
    size, first = 0, 0
    for i, n in enumerate(pa.compute.binary_length(values).to_pylist()):
        if i > first and size + (n or 0) > most:
            yield batch.slice(first, i - first), values.slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n or 0
    if first < len(values):
        yield batch.slice(first), values.slice(first).to_pylist()


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(f, schema) within bounded memory: the session's Arrow batches are held to BATCH_ROWS rows, since a
    row may be a long text, and a worker gives its free memory back when its task ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def groups_of(rows: int, per_group: int) -> int:
    return max(1, -(-rows // per_group))


def gapless_rank(df: DataFrame, by: list[str], spread: Column, order: list[str], groups: int, out: str) -> DataFrame:
    """Number the rows of each `by` from 0 without gaps, however many rows one `by` has.

    Rows are dealt to `groups` parts of each `by` by the hash `spread`; each part is numbered by a window, and the
    parts' counts, summed over the parts before, are added. The large side is exchanged once, on (by, part): the window
    and the join with the small table of counts share that exchange.
    """
    part = f"{out}__part"
    keyed = df.withColumn(part, F.pmod(spread, F.lit(groups)).cast("int"))
    counts = keyed.groupBy(*by, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{out}__before"))
    inside = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)) - 1
    ranked = keyed.withColumn(f"{out}__in", inside).join(offsets, [*by, part])
    return ranked.withColumn(out, (F.col(f"{out}__in") + F.col(f"{out}__before")).cast("long")).drop(part, f"{out}__in", f"{out}__before")
