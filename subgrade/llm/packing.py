"""Best-two-fit packing of token sequences.

The packing decisions depend on the lengths alone, and there are at most `capacity` different lengths, so the counts by
length (at most 1024 numbers, whatever the corpus) are enough to plan every sequence. The plan names, for each length,
which ranks go to which sequences; ranks, the join with the plan and all rows stay in Spark.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import blocks, documents, gapless_rank, groups_of, map_batches, own_columns, written

CAPACITY = 1024
END_ID = 2
PLAN_SCHEMA = "length int, lo long, hi long, per_sequence long, first_sequence long, at long"


#: The added token of byte_bpe_50k.json. It is one id wherever it stands in a text.
ADDED = ("<|endoftext|>",)


@lru_cache(maxsize=2)
def _fast_encoder(rank_file: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _plain_encoder(tokenizer_file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


def token_ids(text: str, tokenizer: str = "byte_bpe_50k") -> np.ndarray:
    """The ids that tokenizers gives with byte_bpe_50k.json and add_special_tokens=False. A faster reader of the same
    vocabulary makes them, but for texts that hold the added token, and runs of white space that its pattern can't hold."""
    if not any(t in text for t in ADDED):
        try:
            return _fast_encoder(public_tokenizers.path(f"{tokenizer}.tiktoken")).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except ValueError:
            pass
    return np.asarray(_plain_encoder(public_tokenizers.path(f"{tokenizer}.json")).encode(text, add_special_tokens=False).ids, dtype="<u4")


def piece_starts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where a document of n tokens is cut: capacity tokens a piece, only the first piece may be shorter."""
    if n <= capacity:
        return [0]
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of each piece; a null text counts as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 1):
                doc, piece, start, length, out = [], [], [], [], []
                for d, text in zip(part.column(0).to_pylist(), texts):
                    ids = np.append(token_ids(text or "", tokenizer), np.uint32(END_ID)).astype("<u4", copy=False)
                    cuts = piece_starts(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
                        doc.append(d)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        out.append(ids[a:b].tobytes())
                yield pa.record_batch(
                    [pa.array(doc, part.column(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_batches(own_columns(docs, "doc_id", "text"), encode, f"doc_id {kind}, piece int, start long, length long, ids binary")


def two_fit_pattern(left: np.ndarray, capacity: int, slack: int = 0, even: bool = True) -> dict[int, int]:
    """One sequence as {length: how many}, from the counts that are left (by length).

    Filled greedily with the longest that fits; then, if a gap of more than `slack` is left, its smallest document gives
    way to the two unpacked documents with the largest sum that fits the expanded gap, if that sum is larger than it. Of
    equal sums, that of the two most even lengths is taken, or of the least even.
    """
    have = left.copy()
    lengths = np.flatnonzero(have)
    chosen: list[int] = []
    gap = capacity
    while gap:
        k = int(np.searchsorted(lengths, gap, "right")) - 1
        while k >= 0 and not have[lengths[k]]:
            k -= 1
        if k < 0:
            break
        x = int(lengths[k])
        chosen.append(x)
        have[x] -= 1
        gap -= x
    if gap > slack and len(chosen) > 1:
        smallest = chosen[-1]
        room = gap + smallest
        a = lengths[(have[lengths] > 0) & (lengths < room)]
        if len(a):
            # the larger of the two is a, the other the longest that is left beside it
            k = np.searchsorted(a, np.minimum(room - a, a), "right") - 1
            k -= (k >= 0) & (a[np.maximum(k, 0)] == a) & (have[a] < 2)
            both = np.where(k >= 0, a + a[np.maximum(k, 0)], 0)
            best = int(np.argmax(both)) if even else len(both) - 1 - int(np.argmax(both[::-1]))
            if both[best] > smallest:
                chosen[-1:] = [int(a[best]), int(a[k[best]])]
    pattern: dict[int, int] = {}
    for x in chosen:
        pattern[x] = pattern.get(x, 0) + 1
    return pattern


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, slack: int = 0, even: bool = True) -> list[tuple]:
    """Rows of PLAN_SCHEMA. A pattern is repeated as long as its lengths last, so the work depends on the number of
    different lengths and not on how many documents there are; so does the size of the plan."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros_like(left)
    rows: list[tuple] = []
    sequence = 0
    while left.any():
        pattern = two_fit_pattern(left, capacity, slack, even)
        times = min(int(left[x]) // k for x, k in pattern.items())
        at = 0
        for x, k in pattern.items():
            rows.append((x, int(used[x]), int(used[x]) + times * k, k, sequence, at))
            used[x] += times * k
            left[x] -= times * k
            at += x * k
        sequence += times
    return rows


def sequences_of(plan: list[tuple]) -> int:
    return max((first + (hi - lo) // per for _, lo, hi, per, first, _ in plan), default=0)


def fewest_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """The packing_plan with the fewest sequences of those with other slacks and ties, the first of them.

    To close every small gap at once spends short documents that larger gaps need at the end, so where a swap starts to
    pay depends on the lengths. A plan is a matter of their counts, so some twenty cost no pass over documents; the last of
    them swaps nothing, which is first-fit-decreasing. Trying ends at as many sequences as all tokens fill.
    """
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: list[tuple] | None = None
    for slack in [0, *(1 << k for k in range(capacity.bit_length() + 1))]:
        for even in (True, False):
            plan = packing_plan(counts, capacity, slack, even)
            if best is None or sequences_of(plan) < sequences_of(best):
                best = plan
            if sequences_of(best) == least:
                return best
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_part: int = 100_000) -> DataFrame:
    """pieces (with length up to capacity) and sequence_id, offset. Every row is packed, repeated rows too: rows are numbered
    as they are written, so that repeated ones are dealt to different tasks like any others."""
    spark = pieces.sparkSession
    numbered = written(pieces.withColumn("row__number", F.monotonically_increasing_id()), "packing-pieces")
    counts = {int(r.length): r.n for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(fewest_plan(counts, capacity), PLAN_SCHEMA)
    groups = groups_of(max(counts.values(), default=0), rows_per_part)
    ranked = gapless_rank(numbered, ["length"], F.xxhash64("row__number"), ["row__number"], groups, "rank_of_length")
    placed = ranked.alias("p").join(
        F.broadcast(plan.alias("q")),
        (F.col("p.length") == F.col("q.length")) & (F.col("rank_of_length") >= F.col("lo")) & (F.col("rank_of_length") < F.col("hi")),
    )
    nth = F.col("rank_of_length") - F.col("lo")
    return placed.select(
        *[F.col(f"p.{c}") for c in pieces.columns],
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per_sequence")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts are one piece of one token (the end id); longer documents than a sequence are cut, of any length;
    rows that are repeated are packed each; an empty table gives no rows; other columns are ignored. The tokens are made
    once: the table of pieces is written without them.
    """
    pieces = encode_pieces(docs, capacity, tokenizer).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32")
    )
    return pack(pieces, capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
