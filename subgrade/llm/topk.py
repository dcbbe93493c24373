"""Exact top-k search by inner product: tiled matrix products, partial selection in each tile, tree merging.

Candidates and queries are packed into blocks, each one row with a matrix. Candidate blocks are dealt to stripes; a stripe's
task holds them and streams every query block past them, tile by tile, and a query keeps its k best of the stripe; the lists
of a query are then merged eight at a time. Components are scaled and floored to integers, and products are exact: in single or double precision where the
largest possible sum is exact there, else in whole numbers.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from subgrade.llm.common import table, written
from subgrade.tables import small_batches

CANDIDATE_ROWS, QUERY_ROWS = 8192, 1024
FAN_IN = 8
#: What a stripe holds of candidates: blocks, and bytes of their matrices.
STRIPE_BLOCKS, STRIPE_BYTES = 32, 64 << 20
#: What a scaled component beyond the doubles is held at.
LARGEST = np.finfo(np.float64).max
BLOCK_SCHEMA = "block long, dim int, ids binary, matrix binary, wide boolean"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector (array<double>) of the rows whose id and vector are not null and whose components are all finite."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    infinite = F.lit(float("inf"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return v.filter("id is not null and vector is not null and size(vector) > 0").filter(~odd)


def pack_blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """Blocks of at most `rows` floored vectors of one dimension, in order of id; each input row is in one block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nth = TaskContext.get().partitionId() << 32, 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, matrix = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], matrix[order]
            wide = not np.array_equal(matrix.astype(np.float32).astype(np.float64), matrix)
            raw = matrix.astype(np.float64 if wide else np.float32).tobytes()
            return pa.record_batch(
                [pa.array([first + nth]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([raw]), pa.array([wide])],
                ["block", "dim", "ids", "matrix", "wide"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                for part in np.array_split(mine, -(-len(mine) // rows)):
                    with np.errstate(over="ignore"):
                        matrix = np.clip(np.floor(scale * flat[starts[part][:, None] + np.arange(dim)]), -LARGEST, LARGEST)
                    held = waiting.setdefault(int(dim), [])
                    if sum(len(x) for x, _ in held) + len(part) > rows:
                        yield block(int(dim))
                        nth, held = nth + 1, waiting.setdefault(int(dim), [])
                    held.append((ids[part], matrix))
        for dim in list(waiting):
            yield block(dim)
            nth += 1

    return vectors.mapInArrow(pack, BLOCK_SCHEMA)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T in whole numbers."""
    with np.errstate(over="ignore"):
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if bound < 2**53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    whole = [[int(x) for x in row] for row in c]
    sums = [[sum(int(a) * b for a, b in zip(row, other)) for other in whole] for row in q]
    return np.array(sums, dtype=object)


def select_top(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best columns, ties to the left; own marks what takes no part."""
    out_r, out_c = [], []
    if scores.dtype == object:
        for i, row in enumerate(scores):
            best = sorted(np.flatnonzero(~own[i]).tolist(), key=lambda j: (-row[j], j))[:k]
            out_r += [i] * len(best)
            out_c += best
        return np.array(out_r, dtype=np.int64), np.array(out_c, dtype=np.int64)
    s = np.where(own, -np.inf, scores)
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    r, c = np.nonzero((s >= least[:, None]) & ~own)
    order = np.lexsort((c, -s[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
    return r[rank < k], c[rank < k]


def _tiles(blocks: DataFrame, q_blocks: DataFrame, stripes: int, k: int) -> DataFrame:
    """stripe, query_id, vec_id, score: each query's k best candidates of each stripe. A stripe's task holds its candidate
    blocks and streams all query blocks past them, so no row has two matrices and nothing is broadcast."""
    content = ["dim", "ids", "matrix", "wide"]
    dealt = blocks.select(F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(0).alias("turn"), *content)
    copies = q_blocks.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(1).alias("turn"), *content)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                stripe, dim = column["stripe"][i].as_py(), column["dim"][i].as_py()
                ids = np.frombuffer(column["ids"][i].as_buffer(), np.int64)
                matrix = np.frombuffer(column["matrix"][i].as_buffer(), np.float64 if column["wide"][i].as_py() else np.float32).reshape(-1, dim)
                if now != (stripe, dim):
                    held, now = [], (stripe, dim)
                if not column["turn"][i].as_py():
                    held.append((ids.copy(), matrix.copy()))
                    continue
                for at in range(0, len(matrix) if held else 0, 256):
                    found: list[list[np.ndarray]] = [[], [], []]
                    for c_ids, c in held:
                        scores = _products(matrix[at : at + 256], c)
                        r, col = select_top(scores, ids[at : at + 256, None] == c_ids[None], k)
                        best = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores[r, col]], dtype=np.int64)
                        for into, v in zip(found, (r, c_ids[col], best)):
                            into.append(v)
                    r, vec, best = (np.concatenate(v) for v in found)
                    # ~x turns the order of longs around without overflow
                    order = np.lexsort((vec, ~best, r))
                    r, vec, best = r[order], vec[order], best[order]
                    kept = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
                    yield pa.record_batch(
                        [pa.array(np.full(int(kept.sum()), stripe), pa.int32()), pa.array(ids[at + r[kept]]), pa.array(vec[kept]), pa.array(best[kept])],
                        ["stripe", "query_id", "vec_id", "score"],
                    )

    rows = dealt.unionByName(copies).repartition(stripes, "stripe").sortWithinPartitions("stripe", "dim", "turn")
    return rows.mapInArrow(multiply, "stripe int, query_id long, vec_id long, score long")


def _best(lists: DataFrame, k: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", place).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products with each query, of all rows but the query's own.

    is_query is a condition on the column `id`. Rows with a null id or vector, or a null or not finite component, take
    no part; vectors meet only those of their dimension; equal scores go to the smaller vec_id; rows that repeat an id
    are a candidate each, and one query (with the least of their vectors); scaled components beyond a double are held at the
    largest one, scores beyond a long at its ends; vectors of any length take part;
    an empty table gives no rows; other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    blocks = written(pack_blocks(rows, CANDIDATE_ROWS, scale), "topk-candidates")
    n_blocks, largest = blocks.agg(F.count("*"), F.coalesce(F.max(F.length("matrix")), F.lit(1))).first()
    queries = rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    q_blocks = written(pack_blocks(queries, QUERY_ROWS, scale), "topk-queries")
    # a stripe holds so many blocks, so copies of the queries grow with the stripes only
    stripes = max(8, -(-n_blocks // max(1, min(STRIPE_BLOCKS, STRIPE_BYTES // largest))))
    # few rows at a time, as each is a matrix
    with small_batches(vectors.sparkSession, 16):
        lists = written(_tiles(blocks, q_blocks, stripes, k), "topk-lists")
    levels = 0
    while FAN_IN**levels < stripes:
        levels += 1
    lists = lists.withColumnRenamed("stripe", "node")
    for _ in range(levels - 1):
        lists = _best(lists.withColumn("node", F.floor(F.col("node") / FAN_IN)), k, "node").drop("rank")
    return _best(lists, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
