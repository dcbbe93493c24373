"""Sets of word shingles: their hashes, min-hashes and exact similarity."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from subgrade.llm.common import blocks, map_batches, written

SEED = 42
#: A band is the hash of so many min-hashes. Two sets of similarity 0.8 share at least one of 20 bands of 4 with a chance of
#: 1 - (1 - 0.8**4)**20 = 0.99997, and more similar ones with a larger chance.
BANDS, ROWS = 20, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, A-Z in lower case, joined by one space; of all words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """An Arrow column of arrays of longs."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS min-hashes each, of a set that isn't empty."""
    odd = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(len(odd), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[None, at : at + 4096] * odd[:, None]).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(31)) ^ part) * _MIX
    return key ^ (key >> np.uint64(29))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its distinct shingle hashes s, of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 1):
                yield pa.record_batch([part.column(0), long_lists([np.unique(shingle_hashes(t, width)) for t in texts])], ["doc_id", "s"])

    return map_batches(docs.select("doc_id", "text"), compute, "doc_id long, s array<long>")


def similar_pairs(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those of the pairs u, v of doc_ids whose shingle sets share at least 4/5 of their union.

    A pair carries one of its two sets through an exchange. Both sides of each join are tables, so that Spark can split
    the pairs of a document that has many.
    """
    pairs = written(pairs, "similar-pairs")
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = written(shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), width), "similar-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return written(both.filter(9 * shared >= 4 * (F.size("a") + F.size("b"))).select("u", "v").distinct(), "similar-links")
