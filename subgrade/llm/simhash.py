"""SimHash near-duplicates through sharded BK-trees.

Documents with one fingerprint are one point. Points are dealt to shards so that points within the radius meet in at
least one; each shard is a BK-tree that its own points are sent down. A tree is shipped to the task that holds its
queries and not broadcast to all, because all trees together grow with the corpus; each one's size has a bound.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.llm.bktree import spanning_links
from subgrade.llm.common import blocks, documents, map_batches, own_columns, written
from subgrade.llm.components import connected_components
from subgrade.llm.fingerprints import fingerprint
from subgrade.llm.shinglesets import long_lists, shingle_hashes

#: A shard with more points is split once more by the bits that its points may differ in.
SHARD_POINTS = 1024


def fingerprints(docs: DataFrame, width: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id and fp (array of `lanes` longs) of each row; null and empty texts have all bits zero."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 1):
                yield pa.record_batch([part.column(0), long_lists([fingerprint(shingle_hashes(t, width), lanes) for t in texts])], ["doc_id", "fp"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_batches(own_columns(docs, "doc_id", "text"), compute, f"doc_id {kind}, fp array<long>")


def _as_long(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def exact_shards(points: DataFrame, radius: int = 2) -> DataFrame:
    """shard, rep, fp: every two points of one 64-bit word within the radius share a shard.

    The word is cut into radius + 3 parts, and a shard is named by the values of three of them: at most `radius` parts
    differ, so three are equal. A shard of over SHARD_POINTS points is split again, named also by one of radius + 1 parts
    of its other bits; for radius 2 what is left to differ is then 18 bits, so no shard has more than 2**18 points.
    """
    edges = [round(64 * i / (radius + 3)) for i in range(radius + 4)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks, inner = [], []
    for chosen in combinations(range(len(parts)), 3):
        mask = sum(parts[i] for i in chosen)
        free = [i for i in range(64) if not mask >> i & 1]
        cuts = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
        masks.append(mask)
        inner.append([sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])])

    def masked(bits: list[int], nth: Column | int) -> Column:
        literal = F.array(*[F.lit(_as_long(x)) for x in bits])
        return F.element_at(literal, nth).bitwiseAND(F.element_at("fp", 1))

    k = F.col("k")
    keyed = points.select("rep", "fp", F.explode(F.sequence(F.lit(1), F.lit(len(masks)))).alias("k"))
    keyed = keyed.withColumn("shard", F.xxhash64("k", masked(masks, k)))
    crowd = keyed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    again = F.array(*[F.xxhash64("shard", F.lit(j), masked([x[j] for x in inner], k)) for j in range(radius + 1)])
    names = F.when(F.col("n") <= SHARD_POINTS, F.array("shard")).otherwise(again)
    return keyed.join(crowd, "shard").select(F.explode(names).alias("shard"), "rep", "fp")


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards in rows that come sorted by shard; a shard may go over several batches."""
    kept: list[pa.RecordBatch] = []

    def search(table: pa.Table) -> pa.RecordBatch:
        shard = table.column(0).combine_chunks().to_numpy()
        rep = table.column(1).combine_chunks().to_numpy()
        flat = table.column(2).combine_chunks().flatten().to_numpy().view(np.uint64)
        group = np.cumsum(np.concatenate(([False], shard[1:] != shard[:-1])))
        a, b = spanning_links(flat.reshape(len(rep), -1), group, radius)
        return pa.record_batch([pa.array(rep[a]), pa.array(rep[b])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column(0).to_numpy()
        begins = int(np.flatnonzero(shard == shard[-1])[0])
        if begins or (kept and kept[-1].column(0)[-1].as_py() != shard[0]):
            yield search(pa.Table.from_batches([*kept, batch.slice(0, begins)]))
            kept = []
        kept.append(batch.slice(begins))
    if kept:
        yield search(pa.Table.from_batches(kept))


def link_shards(shards: DataFrame, radius: int) -> DataFrame:
    """Long pairs u, v of points that hold together what the radius links within shards."""
    dealt = shards.repartition("shard").sortWithinPartitions("shard")
    return map_batches(dealt, lambda batches: _links(batches, radius), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that chains of fingerprints within the radius reach.

    Every link of the one word of 64 bits is found. Null, empty and one-word texts have fingerprints like any other, a
    text of any length its whole one; repeated rows share a component; rows with a null doc_id link others too, and have a
    null component_id where no row of their component has a doc_id; an empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, width), "simhash-fingerprints")
    # a point is known by its fingerprint, so that it needs no doc_id
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", F.element_at("fp", 1)), "simhash-points")
    groups = connected_components(link_shards(exact_shards(points, radius), radius))
    named = written(points.join(groups, points["rep"] == groups["node"], "left").withColumn("component", F.coalesce("component", "rep")), "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # both sides of each join as tables, so that what many rows share can be split in the join
    of_point = written(named.join(written(least, "simhash-components"), "component").select("fp", "component_id"), "simhash-points")
    return fps.join(of_point, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), width=3, radius=2)
    word = F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0"))
    return out.select("doc_id", word.alias("fingerprint"), "component_id")
