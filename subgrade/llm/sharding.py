"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a 128-bit key: the hash of the text, then a hash of doc_id and text. Equal texts are so
neighbours and share a shard, unless their group is larger than a splitter's tolerance allows. Splitters are found by
counting, over all partitions, the exact bytes below candidate boundaries, and refining the candidates around each
splitter's target until every splitter is within the tolerance. Rows are then exchanged once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subgrade.llm.common import documents, gapless_rank, groups_of, own_columns, written

#: Bits of the key that one round of probes resolves, from the top of the hash of the text to the end of the second.
PROBE_BITS = (12, 10, 10, 10, 10, 12, 12, 10, 10, 10, 10, 12)
ROW_BYTES = 16


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two key halves of each row; a null text counts as no bytes."""
    d = own_columns(docs, "doc_id", "text")
    return d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("key_hi"),
        F.xxhash64("doc_id", "text").alias("key_lo"),
    )


def _unsigned(name: str) -> Column:
    """Bits whose unsigned order is the signed order of the column."""
    return F.col(name).bitwiseXOR(F.lit(-(2**63)))


def _bits(upto: int) -> tuple[Column, Column]:
    """The first `upto` of the key's 128 bits, as two longs."""
    hi = F.shiftrightunsigned(_unsigned("key_hi"), 64 - upto) if 0 < upto < 64 else (_unsigned("key_hi") if upto else F.lit(0).cast("long"))
    low = upto - 64
    lo = F.lit(0).cast("long") if low <= 0 else (F.shiftrightunsigned(_unsigned("key_lo"), 64 - low) if low < 64 else _unsigned("key_lo"))
    return hi, lo


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[int]:
    """The 128-bit lower boundaries of shards 1 to shards - 1.

    Each round counts bytes below the probes inside the intervals that hold an unsettled target: at most
    (shards - 1) * 2**bits sums reach the driver, whatever the number of rows.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [2**128] * (shards - 1)
    allowed = tolerance * total / shards
    targets = {i: total * i / shards for i in range(1, shards)}
    found: dict[int, int] = {}
    # interval of each open target: (prefix of the key, bytes below it)
    open_at = {i: (0, 0) for i in targets}
    upto = 0
    for bits in PROBE_BITS:
        hi, lo = _bits(upto)
        here, below_of = rows, {}
        for prefix, below in open_at.values():
            below_of[prefix] = below
        if upto:
            within = F.lit(False)
            for prefix in sorted(below_of):
                h, low = (prefix >> max(0, upto - 64)), (prefix & ((1 << max(0, upto - 64)) - 1))
                within = within | ((hi == _signed(h)) & (lo == _signed(low)))
            here = rows.filter(within)
        hi, lo = _bits(upto + bits)
        sums = here.groupBy(hi.alias("h"), lo.alias("l")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        low_bits = max(0, upto + bits - 64)
        inside: dict[int, list[tuple[int, int, int]]] = {}
        for r in sums:
            probe = ((r.h % 2**64) << low_bits) | (r.l % 2**64)
            inside.setdefault(probe >> bits, []).append((probe, r.b, r.n))
        for v in inside.values():
            v.sort()
        rest = 128 - upto - bits
        still: dict[int, tuple[int, int]] = {}
        for i, (prefix, below) in open_at.items():
            goal = targets[i]
            for probe, b, n in inside[prefix]:
                if below + b >= goal or probe == inside[prefix][-1][0]:
                    break
                below += b
            ends = ((goal - below, probe << rest), (below + b - goal, (probe + 1) << rest))
            gap, at = min(ends)
            # with all bits of the first half fixed, what is left is one group of equal texts: not split unless it exceeds a shard
            group = upto + bits >= 64 and b <= total / shards
            if gap <= allowed or n == 1 or group or not rest:
                found[i] = at
            else:
                still[i] = (probe, below)
        open_at, upto = still, upto + bits
        if not open_at:
            break
    for i in range(2, shards):
        found[i] = max(found[i], found[i - 1])
    return [found[i] for i in range(1, shards)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shard_of(bounds: list[int], keys: dict[str, Column] | None = None) -> Column:
    """How many boundaries a row's key has reached; the key's halves are the columns key_hi and key_lo, or given."""
    high, low = (keys or {"key_hi": F.col("key_hi"), "key_lo": F.col("key_lo")}).values()
    n = F.lit(0)
    for at in bounds:
        if at < 2**128:
            h, l = (at >> 64) - 2**63, (at & (2**64 - 1)) - 2**63  # noqa: E741
            n = n + ((high > h) | ((high == h) & (low >= l))).cast("int")
    return n


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.002, rows_per_part: int = 100_000) -> DataFrame:
    """Every row's shard and its slot there: doc_id, size, text_crc32, shard, slot.

    Law: the sizes (bytes of the text plus 16) of the shards are near equal. A boundary lies within `tolerance` of a shard
    of its place, or at the nearer end of the row or of the group of equal texts in which that place falls; so a shard is
    off by at most the tolerance and half of such a group at both its ends. Equal texts share a shard unless they are more
    than a shard together. Slots are gapless from 0. Null texts count as empty and are a group; a text of any length is one
    row; rows that are repeated each get a slot; an empty table gives no rows; other columns are ignored.
    """
    # numbered as they are written, so that rows that repeat doc_id and text are dealt to tasks and shards like any others
    numbered = keyed_rows(docs).withColumn("row__number", F.monotonically_increasing_id())
    rows = written(numbered.withColumn("key_lo", F.xxhash64("key_lo", "row__number")), "sharding-rows")
    bounds = splitters(rows, shards, tolerance)
    placed = rows.withColumn("shard", shard_of(bounds))
    groups = groups_of(rows.count(), rows_per_part * shards)
    ranked = gapless_rank(placed, ["shard"], F.col("key_lo"), ["key_hi", "key_lo", "row__number"], groups, "slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.002) -> str:
    """Whole rows of docs as one folder of Parquet files for each shard, exchanged once. The folders are named by the
    column `shard`, or `shard_`, `shard__` and so on where docs has that column itself; its name is returned.

    All columns of docs are written as they are, whatever their names. Null and empty, very long and repeated texts are
    rows like any other, by the law of shard_documents, but that rows which repeat doc_id and text share a shard; an empty
    table writes no folder.
    """
    bounds = splitters(written(keyed_rows(docs), "sharding-keys"), shards, tolerance)
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    keys = {"key_hi": F.xxhash64("text"), "key_lo": F.xxhash64("doc_id", "text")}
    spread = math.ceil(docs.sparkSession.sparkContext.defaultParallelism / shards)
    placed = docs.withColumn(name, shard_of(bounds, keys)).repartition(F.col(name), F.pmod(keys["key_lo"], F.lit(spread)))
    placed.write.partitionBy(name).parquet(path)
    return name


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
