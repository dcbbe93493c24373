"""Stupid-backoff scores of every document, under n-gram counts of all other documents.

Relationally: the n-grams of the documents, grouped by a hash, are the count tables; the documents' exploded n-grams are
joined to them by the same hash and summed per document. Rows of single n-grams would move many times the input, so both
sides move packed: documents are held in chunks of a bounded number of words; a chunk sends its distinct n-grams with
their counts to the hash partitions, one sorted block each; a partition adds up its count table, and answers each block
with the totals in the block's order; the chunk's documents are then scored where chunk and answers meet. An n-gram is
sent once by a chunk however often it occurs there, so a frequent one weighs no more than a rare one.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import documents, groups_of, map_batches, own_columns, written

ALPHA = 0.4
#: Words of a chunk; a longer document is a chunk of its own.
CHUNK_WORDS = 700_000
#: N-grams that a hash partition gets, about.
PARTITION_GRAMS = 3_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def chunked(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """chunk, doc_ids, sizes, packed, words: the documents in runs of about chunk_words words, each one row; packed is
    their texts' bytes together, compressed, as they move between tasks once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        nth, ids, texts, words = 0, [], [], 0

        def row() -> pa.RecordBatch:
            raw = [t.encode() for t in texts]
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
            return pa.record_batch(
                [pa.array([first + nth], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(r) for r in raw]], pa.list_(pa.int32())), pa.array([packed], pa.binary()), pa.array([words], pa.int64())],
                ["chunk", "doc_ids", "sizes", "packed", "words"],
            )

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len((t or "").encode().split())
                if ids and words + n > chunk_words:
                    yield row()
                    nth, ids, texts, words = nth + 1, [], [], 0
                ids.append(d)
                texts.append(t or "")
                words += n
        if ids:
            yield row()

    return map_batches(own_columns(docs, "doc_id", "text"), pack, "chunk long, doc_ids array<long>, sizes array<int>, packed binary, words long")


def unpacked(packed: bytes, sizes: list[int]) -> list[bytes]:
    """The bytes of a chunk's texts."""
    raw, ends = zstandard.ZstdDecompressor().decompress(packed) if sum(sizes) else b"", np.cumsum(sizes)
    return [raw[e - n : e] for n, e in zip(sizes, ends.tolist())]


class Grams:
    """The n-grams of a chunk's texts: distinct keys in order, how often each occurs, and which each position has."""

    def __init__(self, texts: list[bytes], order: int):
        words = [t.split() for t in texts]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(self.lengths.sum()))
        self.doc = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.at = []  # by order, the positions where an n-gram ends
        keys, gram = [], codes
        for n in range(1, order + 1):
            if n > 1:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(30))) * _MIX[0] + codes[n - 1 :]
            gram = gram * _MIX[1]
            gram ^= gram >> np.uint64(29)
            ends = np.flatnonzero(place >= n - 1)
            self.at.append(ends)
            keys.append(gram[ends - (n - 1)])
        every = np.concatenate(keys)
        self.keys, inverse, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.index = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])

    def partition_ends(self, partitions: int) -> np.ndarray:
        """Where each partition's keys end: partitions share the range of keys evenly."""
        bounds = np.array([(2**64 * (i + 1) // partitions) - 1 for i in range(partitions)], dtype=np.uint64)
        return np.searchsorted(self.keys, bounds, "right")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as their differences, in as few bytes each as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max() if len(steps) > 1 else 0).bit_length() // 8))
    return bytes([width]) + steps[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    width = raw[0]
    rest = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    steps[1:, :width] = rest
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; those of 255 and more follow in full."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(counts).to_bytes(8, "little") + small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    counts = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", offset=8 + n)
    return counts


def _blocks(chunks: DataFrame, order: int, partitions: int) -> DataFrame:
    """Each chunk's distinct n-grams and their counts, a block for each hash partition."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, packed in zip(*[batch.column(i) for i in range(3)]):
                g, chunk = Grams(unpacked(packed.as_py(), sizes.as_py()), order), chunk.as_py()
                ends = g.partition_ends(partitions)
                spans = [(p, a, b) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if b > a]
                if spans:
                    yield pa.record_batch(
                        [
                            pa.array([p for p, _, _ in spans], pa.int32()), pa.array([chunk] * len(spans), pa.int64()),
                            pa.array([pack_sorted(g.keys[a:b]) for _, a, b in spans]), pa.array([pack_counts(g.counts[a:b]) for _, a, b in spans]),
                        ],
                        ["part", "chunk", "grams", "counts"],
                    )

    return map_batches(chunks.select("chunk", "sizes", "packed"), send, "part int, chunk long, grams binary, counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """The count table of one hash partition, as each chunk's totals in the order of its block."""
    keys = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, counts).astype(np.int64)[inverse]
    answers = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "totals": pa.array([pack_counts(x) for x in answers])})


def score_chunk(texts: list[bytes], totals: np.ndarray, corpus_words: int, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, backoffs and log score of each text. totals: of the chunk's distinct n-grams, over all documents."""
    g = Grams(texts, order)
    others = []
    for n, index in enumerate(g.index):
        own = (g.doc[g.at[n]] << 32) | index
        _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
        others.append(totals[index] - count[inverse])
    words = np.maximum(corpus_words - g.lengths, 1)[g.doc]
    log = np.log(np.maximum(others[0], 0.5) / words)
    backoffs = np.zeros(len(log), dtype=np.int64)
    lower = others[0]
    for n in range(1, order):
        here = np.zeros(len(log), dtype=np.int64)
        here[g.at[n]] = others[n]
        context = np.concatenate(([0], lower))[:-1]
        has = np.zeros(len(log), dtype=bool)
        has[g.at[n]] = True
        seen = has & (here > 0)
        log[seen] = np.log(here[seen] / context[seen])
        log[has & ~seen] += np.log(alpha)
        backoffs[seen] = 0
        backoffs[has & ~seen] += 1
        lower = here
    size = len(texts)
    return g.lengths, np.bincount(g.doc, backoffs, size).astype(np.int64), np.bincount(g.doc, log, size).astype(np.float64)


def backoff_scores(docs: DataFrame, order: int = 2, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, n_backoffs, log_score of every row of docs.

    A word's score is count(its n-gram) / count(the n-gram's first words), from the other documents, if that n-gram
    occurs there; else alpha times the score with one word of context less. Without context it is count / words; a
    word that no other document has counts one half. A document's first words have the context there is. log_score is
    the sum of natural logarithms. Null and empty texts have no words and score 0; repeated rows are documents of their
    own; an empty table gives no rows; other columns are ignored.
    """
    chunks = written(chunked(docs), "backoff-chunks")
    seen = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    partitions = groups_of(seen * order, PARTITION_GRAMS)
    blocks = _blocks(chunks, order, partitions).repartition(partitions, "part")
    answers = blocks.groupBy("part").applyInArrow(_answer, "part int, chunk long, totals binary")
    gathered = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias("answers"))
    joined = chunks.join(gathered, "chunk", "left").select("doc_ids", "sizes", "packed", F.col("answers.totals").alias("totals"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, packed, answers in zip(*[batch.column(i) for i in range(4)]):
                totals = np.concatenate([np.zeros(0, np.int64), *map(unpack_counts, answers.as_py() or [])])
                n, backoffs, log = score_chunk(unpacked(packed.as_py(), sizes.as_py()), totals, seen, order, alpha)
                yield pa.record_batch([ids.values, *map(pa.array, (n, backoffs, log))], ["doc_id", "n_words", "n_backoffs", "log_score"])

    return map_batches(joined, score, "doc_id long, n_words long, n_backoffs long, log_score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_scores(documents(spark, sf_dir), order=2)
    return out.select("doc_id", "n_words", "n_backoffs", F.round("log_score", 3).alias("log_score"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)
), grams AS (
  SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words
), single AS (SELECT word, count(*) AS n FROM grams GROUP BY 1),
own AS (SELECT doc_id, word, count(*) AS n FROM grams GROUP BY 1, 2),
double AS (SELECT before, word, count(*) AS n FROM grams WHERE before IS NOT NULL GROUP BY 1, 2),
own2 AS (SELECT doc_id, before, word, count(*) AS n FROM grams WHERE before IS NOT NULL GROUP BY 1, 2, 3),
size AS (SELECT doc_id, count(*) AS n, (SELECT count(*) FROM grams) AS everything FROM grams GROUP BY 1),
scored AS (
  SELECT g.doc_id, g.before IS NOT NULL AS has, coalesce(d.n - o2.n, 0) AS pair, s.n - o.n AS one,
    sb.n - ob.n AS context, greatest(z.everything - z.n, 1) AS others
  FROM grams g JOIN single s USING (word) JOIN own o USING (doc_id, word) JOIN size z USING (doc_id)
  LEFT JOIN double d ON d.before = g.before AND d.word = g.word
  LEFT JOIN own2 o2 ON o2.doc_id = g.doc_id AND o2.before = g.before AND o2.word = g.word
  LEFT JOIN single sb ON sb.word = g.before LEFT JOIN own ob ON ob.doc_id = g.doc_id AND ob.word = g.before
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE has AND pair = 0) AS n_backoffs,
    sum(CASE WHEN has AND pair > 0 THEN ln(pair / context)
      ELSE ln(greatest(one, 0.5) / others) + CASE WHEN has THEN ln(0.4) ELSE 0 END END) AS log_score
  FROM scored GROUP BY 1
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoffs, 0)::BIGINT AS n_backoffs,
  round(coalesce(log_score, 0)::DOUBLE, 3) AS log_score
FROM documents d LEFT JOIN summed USING (doc_id)
"""
