"""Near copies at an exact similarity: SimHash fingerprints in BK-trees name the candidates, shingle sets decide.

Two sets are near copies if they share at least 4/5 of their union. Each has a fingerprint of LANES * 64 bits. At that
similarity 0.15 of the bits differ, which no run of bits survives; so trees are dealt by bands of min-hashes, and a tree
links what lies within RADIUS in one. RADIUS is wide, so that links are candidates only; each is then compared shingle by
shingle, and only true ones join documents.

A crowded shard is not searched as long as stars help: its points are compared with one of them, and what that links is
one component, inside which no further pair is needed. The rest, between components, is searched in trees of bounded size.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from subgrade.llm.bktree import Forest, _labels
from subgrade.llm.common import blocks, map_batches, written
from subgrade.llm.components import connected_components
from subgrade.llm.fingerprints import fingerprint
from subgrade.llm.shinglesets import band_keys, long_lists, shingle_hashes, shingle_sets, similar_pairs

LANES = 4
#: Of 256 bits. At similarity 0.8, 38.8 differ on average with a deviation of 5.7, of very small sets up to 48 with 6.2;
#: of unrelated texts 128 with 8.
RADIUS = 76
#: Points of a tree, and of the queries that meet it, at most.
TREE_POINTS = 1024
#: Shingles of the sets that a task searches at a time, and of those that it multiplies at a time.
TASK_SHINGLES, COLUMNS = 1_000_000, 4096
#: Up to so many comparisons for each point of a shard, trees are searched without stars before; so, too, once a turn of
#: stars leaves more than STILL of them.
PAIRS_A_POINT, STILL = 2, 0.75


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, a key of the whole set (k1, k2), its size n, its fingerprint fp and bands, of each row with a word."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 1):
                sets = [np.unique(shingle_hashes(t, width)) for t in texts]
                k = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
                columns = [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array([len(s) for s in sets], pa.int32())]
                lists = [long_lists([made(s) for s in sets]) for made in (lambda s: fingerprint(s, LANES), band_keys)]
                yield pa.record_batch([part.column(0), *columns, *lists], ["doc_id", "k1", "k2", "n", "fp", "bands"])

    worded = docs.select("doc_id", "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return map_batches(worded, compute, "doc_id long, k1 long, k2 long, n int, fp array<long>, bands array<long>")


def _distance(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.fp")[i].bitwiseXOR(F.col(f"{b}.fp")[i])) for i in range(LANES)])


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs u, v of each shard's points with one of them, which an order that all shards share picks."""
    order = F.xxhash64("rep", F.lit(turn))
    # written, so that the join with a crowded shard has an exchange on both sides and Spark can split it
    centre = written(rows.groupBy("shard").agg(*[F.min_by(c, order).alias(c) for c in ("rep", "n", "comp", "fp")]), "near-centres")
    joined = rows.alias("a").join(centre.alias("b"), F.col("a.shard") == F.col("b.shard"))
    apart = (F.col("a.comp") != F.col("b.comp")) & (5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n"))
    return joined.filter(apart & (_distance("a", "b") <= RADIUS)).select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct()


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets of each pair share; sets hold distinct elements."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
    # many pairs of few sets: products of the sets' columns of zeros and ones, of elements that two sets have
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[code] > 1
    owner, code = owner[kept], (np.cumsum(times > 1) - 1)[code[kept]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        low, high = np.searchsorted(code, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[low:high], code[low:high] - at] = 1
        shared += has @ has.T
    return shared[a, b].astype(np.int64)


def _search(table: pa.Table, radius: int) -> pa.RecordBatch:
    """Links that hold together, within each group (shard, i, j) of the rows, which come sorted by group, what near copies
    connect: of the pairs of a query and a point of the tree within the radius, those whose sets are similar."""
    keys = [table.column(c).to_numpy() for c in range(3)]
    query, tree_, rep, n, comp, top = (table.column(c).to_numpy() for c in ("query", "tree", "rep", "n", "comp", "top"))
    fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
    fresh = reduce(np.logical_or, [np.concatenate(([True], k[1:] != k[:-1])) for k in keys])
    group = np.cumsum(fresh) - 1
    tree, asks = np.flatnonzero(tree_), np.flatnonzero(query)
    there, own = np.unique(group[tree], return_inverse=True)
    asks = asks[np.isin(group[asks], there)]
    forest = Forest(fp[tree], own)
    forest.points = np.concatenate([fp[tree], fp[asks]])
    links: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(asks):
        q, p = forest.within(len(tree) + np.arange(len(asks)), np.searchsorted(there, group[asks]), radius)
        a, b = asks[q - len(tree)], tree[p]
        once = (comp[a] != comp[b]) & ((comp[b] == top[b]) | (rep[a] < rep[b])) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
        a, b = a[once], b[once]
        order = np.argsort(group[a], kind="stable")
        a, b = a[order], b[order]
        sets = table.column("s").combine_chunks()
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        for first, last in zip(*(np.searchsorted(group[a], np.unique(group[a]), side) for side in ("left", "right"))):
            some, pair = np.unique(np.concatenate([a[first:last], b[first:last]]), return_inverse=True)
            x, y = np.split(pair, 2)
            alike = 9 * shared_counts([flat[ends[i] : ends[i + 1]] for i in some], x, y) >= 4 * (n[some[x]] + n[some[y]])
            label = _labels(len(some), x[alike], y[alike])
            child = np.flatnonzero(label != np.arange(len(some)))
            links.append((rep[some[label[child]]], rep[some[child]]))
    u, v = (np.concatenate(x) for x in zip(*links))
    return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _searched(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """_search over runs of whole groups, whose sets have about TASK_SHINGLES elements together."""
    kept: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, 100):
            batch = whole.slice(at, 100)
            if sum(len(b.column("s").flatten()) for b in kept) >= TASK_SHINGLES:
                keys = [batch.column(c).to_numpy() for c in range(3)]
                last = [kept[-1].column(c)[-1].as_py() for c in range(3)]
                begins = np.flatnonzero(reduce(np.logical_or, [k != x for k, x in zip(keys, last)]))
                if len(begins):
                    yield _search(pa.Table.from_batches([*kept, batch.slice(0, int(begins[0]))]).combine_chunks(), radius)
                    kept, batch = [], batch.slice(int(begins[0]))
            kept.append(batch)
    if kept:
        yield _search(pa.Table.from_batches(kept).combine_chunks(), radius)


def tree_links(rows: DataFrame, sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links u, v between a shard's points that lie in different components, as many as hold together what is similar. One
    of a pair lies outside the shard's largest component; those are the queries, and every block of them meets the tree of
    every block of the shard. The points bring their sets (doc_id, s), so that no pair leaves a task but a true link."""
    rows = rows.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    asks = F.col("comp") != F.col("top")
    block = lambda m: F.pmod(F.xxhash64("rep"), F.ceil(F.col(m) / TREE_POINTS))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(m) / TREE_POINTS) - 1))
    roles = lambda df, query, tree: df.withColumns({"query": query, "tree": F.lit(tree)})
    zero = F.lit(0).cast("long")
    small, large = rows.filter(F.col("points") <= TREE_POINTS), rows.filter(F.col("points") > TREE_POINTS)
    parts = [
        roles(small.withColumns({"i": zero, "j": zero}), asks, True),
        roles(large.filter(asks).withColumn("i", block("outside")).withColumn("j", every("points")), F.lit(True), False),
        roles(large.withColumn("j", block("points")).withColumn("i", every("outside")), F.lit(False), True),
    ]
    columns = ["shard", "i", "j", "query", "tree", "rep", "n", "comp", "top", "fp", "s"]
    dealt = reduce(DataFrame.unionByName, [df.select(columns) for df in parts]).repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return map_batches(dealt, lambda batches: _searched(batches, radius), "u long, v long").distinct()


def _with_components(shards: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The shards that still hold several components: with comp, and of the shard its largest component (top), its points
    and those outside the largest component."""
    if comps is None:
        rows = shards.withColumn("comp", F.col("rep"))
    else:
        rows = written(shards.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"), "near-named")
    counts = rows.groupBy("shard", "comp").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("shard").agg(F.sum("c").alias("points"), F.max_by("comp", "c").alias("top"), F.max("c").alias("most"))
    sizes = sizes.filter("most < points").select("shard", "top", "points", (F.col("points") - F.col("most")).alias("outside"))
    return written(rows.join(written(sizes, "near-sizes"), "shard"), "near-shards")


def near_components(docs: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """node, component of the points (rep, n, fp, bands) that chains of near copies connect with others."""
    keyed = points.select("rep", "n", "fp", F.posexplode("bands").alias("band", "key")).withColumn("shard", F.xxhash64("band", "key")).drop("band", "key")
    crowd = written(keyed.groupBy("shard").agg(F.count("*").alias("m")).filter("m > 1").select("shard"), "near-crowds")
    shards = written(keyed.join(crowd, "shard"), "near-points")
    links, comps, turn, before = [], None, 0, float("inf")
    while True:
        rows = _with_components(shards, comps)
        n, work = rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.expr("comp <> top"), F.col("points"))), F.lit(0))).first()
        stars = PAIRS_A_POINT * n < work < STILL * before
        if stars:
            links.append(similar_pairs(docs, star_pairs(rows, turn), width))
        else:
            ids = rows.select(F.col("rep").alias("doc_id")).distinct()
            sets = written(shingle_sets(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), width), "near-sets")
            links.append(written(tree_links(rows, sets), "near-links"))
        comps = connected_components(reduce(DataFrame.unionByName, links))
        if not stars:
            return comps
        turn, before = turn + 1, work


def near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and component_id of every row with a doc_id and a word: the smallest doc_id that chains of near copies reach."""
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    own = written(sketches(docs, width), "near-sketches")
    firsts = written(own.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "near-firsts")
    points = own.withColumnRenamed("doc_id", "rep").join(firsts.select("rep"), "rep").dropDuplicates(["rep"])
    comps = near_components(docs, points.select("rep", "n", "fp", "bands"), width)
    named = firsts.join(comps, firsts["rep"] == comps["node"], "left")
    named = written(named.select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "near-components")
    # both sides as tables, so that a set that many documents share can be split in the join
    return own.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs without those that chains of near copies connect with a smaller doc_id: one document of each group stays.

    Null and empty texts, and those without words, are no copies of each other and stay; so do rows with a null doc_id. Of
    any length, the whole text counts. Rows that repeat a doc_id are one document and stay or go together. A similarity of
    0.8 exactly is one. An empty table gives no rows; other columns pass through, whatever their names.
    """
    gone = near_copies(docs, width).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
