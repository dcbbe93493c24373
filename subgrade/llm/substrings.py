"""Substring dedup: removal of passages that a document with a smaller doc_id already has.

A window is `width` consecutive words of one document; it is known by two Rabin-Karp hashes of 64 and 32 bits over hashes
of its words. Counted in Spark are the windows that can be repeated, and not all: two equal windows have the same smallest
Rabin-Karp hash of a short run of their words (a minimiser), so a window whose minimiser no second document has is found
once in the corpus, and sending it to be counted could not change the result. First the minimisers of all windows are
counted, then, exactly, the windows behind repeated ones. Documents with equal words are one document to the count: all but
the first lose every word that a window covers.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import blocks, documents, map_batches, own_columns, written
from subgrade.llm.shinglesets import long_lists

WIDTH = 50
#: Words of the short runs of which a window's smallest is its minimiser.
RUN = 20
#: Windows that are hashed with one running sum.
SEGMENT = 16_384
#: Odd multipliers of the rolling hashes; the first two know a window, the third its short runs.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    inverse = pow(base, -1, 2**64)
    with np.errstate(over="ignore"):
        up = np.concatenate(([np.uint64(1)], np.full(n - 1, base, dtype=np.uint64))).cumprod(dtype=np.uint64)
        down = np.concatenate(([np.uint64(1)], np.full(n - 1, inverse, dtype=np.uint64))).cumprod(dtype=np.uint64)
    return up, down


def rolling_hashes(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` codes: a running sum, from which each run's part is taken. A long text goes
    in segments, so that the powers are of one size whatever its length."""
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(base, SEGMENT + width)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, SEGMENT):
        part = codes[at : at + SEGMENT + width - 1]
        total = np.concatenate(([np.uint64(0)], np.cumsum(part * down[: len(part)], dtype=np.uint64)))
        m = len(part) - width + 1
        out[at : at + m] = (total[width:] - total[:m]) * up[:m]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def window_minima(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` neighbours, by minima from both ends of blocks of `span`."""
    n = len(values) - span + 1
    pad = -len(values) % span
    blocks = np.concatenate([values, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[span - 1 : span - 1 + n])


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def minimisers(codes: np.ndarray, width: int) -> np.ndarray:
    """By window, the smallest hash of a short run inside it."""
    run = min(RUN, width)
    return window_minima(rolling_hashes(codes, run, _BASES[2]), width - run + 1)


def sha256_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _kind(df: DataFrame) -> str:
    return df.select("doc_id").schema[0].dataType.simpleString()


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """Of each document: the number and hash of its words, and the distinct minimisers of its windows."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 1):
                n_words, sha, minima = [], [], []
                for text in texts:
                    words = (text or "").encode().split()
                    n_words.append(len(words))
                    sha.append(sha256_of(words))
                    minima.append(np.unique(minimisers(word_codes(words), width)) if len(words) >= width else np.zeros(0, np.uint64))
                yield pa.record_batch([part.column(0), pa.array(n_words, pa.int64()), pa.array(sha), long_lists(minima)], ["doc_id", "n_words", "sha256", "minima"])

    return map_batches(docs, profile, f"doc_id {_kind(docs)}, n_words long, sha256 string, minima array<long>")


def _candidate_windows(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, place, h1, h2 of the windows whose minimiser is in the row's array `shared`."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts_ in blocks(batch, 1):
                for i, text in enumerate(texts_):
                    codes = word_codes((text or "").encode().split())
                    if len(codes) < width:
                        continue
                    mine = np.isin(minimisers(codes, width), part.column(2)[i].values.to_numpy().view(np.uint64))
                    place = np.flatnonzero(mine)
                    h1, h2 = (rolling_hashes(codes, width, b)[place] for b in _BASES[:2])
                    doc = part.column(0).take(pa.array(np.full(len(place), i)))
                    yield pa.record_batch([doc, pa.array(place.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc_id", "place", "h1", "h2"])

    return map_batches(texts, windows, f"doc_id {_kind(texts)}, place int, h1 long, h2 int")


def merge_windows(places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the maximal intervals that windows at these places cover together."""
    places = np.unique(places)
    fresh = np.concatenate(([True], places[1:] > places[:-1] + width))
    return places[fresh], np.append(places[:-1][fresh[1:]], places[-1]) + width


def _intervals(places: DataFrame, width: int) -> DataFrame:
    """doc_id and spans, the maximal removal intervals of its words, from doc_id and its array `places`."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for row in batch.column(1):
                first, end = merge_windows(row.values.to_numpy(), width)
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(first, end)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(places, merge, f"doc_id {_kind(places)}, spans array<struct<first:bigint,end:bigint>>")


class RepeatedPassages:
    """The decisions over a table of documents, as tables.

    profiles: doc_id, n_words, sha256 of the words joined by one space, minima, copy (its words are those of a document
    with a smaller doc_id). texts: the documents that share a minimiser with another. spans: doc_id and the maximal
    intervals of words to remove, of the documents that are no copies.
    """

    def __init__(self, docs: DataFrame, width: int = WIDTH):
        docs = own_columns(docs, "doc_id", "text").filter("doc_id is not null")
        self.width = width
        profiles = written(_profiles(docs, width), "substrings-profiles")
        firsts = profiles.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
        known = profiles.select("doc_id", "n_words", "sha256").join(written(firsts.drop("last"), "substrings-firsts"), "sha256", "left")
        self.profiles = written(known.select("doc_id", "n_words", "sha256", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")), "substrings-known")
        single = profiles.select("doc_id", "minima").join(self.profiles.filter("copy").select("doc_id").distinct(), "doc_id", "left_anti")
        runs = single.select("doc_id", F.explode("minima").alias("run"))
        shared = runs.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("run")
        # written, so that the joins have exchanges on both sides and Spark can split a hot run or window
        mine = runs.join(written(shared, "substrings-runs"), "run").groupBy("doc_id").agg(F.collect_set("run").alias("shared"))
        self.texts = written(docs.join(mine, "doc_id"), "substrings-texts")
        windows = _candidate_windows(self.texts, width)
        counted = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        repeated = written(counted.filter("low < high").select("h1", "h2", "low"), "substrings-windows")
        again = windows.join(repeated, ["h1", "h2"]).filter("doc_id > low")
        places = again.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
        self.spans = written(_intervals(places, width), "substrings-spans")

    def all_spans(self) -> DataFrame:
        """spans and, of each copy that has a window, the interval of all its words; one row for a doc_id."""
        whole = self.profiles.filter(f"copy and n_words >= {self.width}").select("doc_id", "n_words").distinct()
        span = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))
        return self.spans.unionByName(whole.select("doc_id", span.alias("spans"))).dropDuplicates(["doc_id"])


def keep_words(words: list, spans: list) -> list:
    out, at = [], 0
    for s in spans:
        out += words[at : s["first"]]
        at = s["end"]
    return out + words[at:]


def cut_text(text: str, spans: list) -> str:
    """text without the words of the spans; what stands between two kept words stays, and one gap where words went."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    inside = np.concatenate(([False], (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D)), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = np.append(edges[::2], len(raw))
    keep = np.ones(len(raw), dtype=bool)
    for s in spans:
        keep[starts[s["first"]] : starts[s["end"]]] = False
    return raw[keep].tobytes().decode()


def removed_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    Removed is each word that a window covers whose words also start somewhere in a document with a smaller doc_id, as
    the input stands. Null and empty texts have no words; a document of fewer than `width` words loses none; repeats
    inside one document, and rows repeated with one doc_id, are no reason to remove; an empty table gives no rows;
    a text of any length is searched whole; other columns are ignored. doc_id is the key: rows with one doc_id hold one
    text. A row with a null doc_id has no place in the order: it loses nothing and is no reason to remove.
    """
    found = RepeatedPassages(docs, width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts_ in blocks(batch, 1):
                removed, sha = [], []
                for text, spans in zip(texts_, part.column(2).to_pylist()):
                    removed.append(sum(s["end"] - s["first"] for s in spans))
                    sha.append(sha256_of(keep_words(text.encode().split(), spans)))
                yield pa.record_batch([part.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "cut_words", "cut_sha256"])

    texts = found.texts.select("doc_id", "text").join(found.spans, "doc_id")
    cuts = map_batches(texts, cut, f"doc_id {_kind(texts)}, cut_words long, cut_sha256 string").dropDuplicates(["doc_id"])
    gone = F.col("copy") & (F.col("n_words") >= width)
    nothing = hashlib.sha256(b"").hexdigest()
    with_id = found.profiles.join(cuts, "doc_id", "left").select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
    )
    without = _profiles(own_columns(docs, "doc_id", "text").filter("doc_id is null"), width)
    return with_id.unionByName(without.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256")))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated words cut from their texts (see removed_words); all rows and columns stay.

    What stands between two kept words stays as it is. Null, empty and short texts, and rows with a null doc_id, are
    unchanged; repeated rows are cut alike; an empty table gives no rows; other columns pass through, whatever their names.
    """
    spans = RepeatedPassages(docs, width).all_spans()
    joined = docs.join(spans.withColumnRenamed("spans", "removal__spans"), "doc_id", "left")
    names = [f.name for f in docs.schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for part, texts in blocks(batch, at):
                made = [cut_text(t, s) if s else t for t, s in zip(texts, part.column(len(names)).to_pylist())]
                yield pa.record_batch([pa.array(made, pa.string()) if i == at else part.column(i) for i in range(len(names))], names)

    return map_batches(joined.select(*[F.col(f"`{n}`") for n in names], "removal__spans"), cut, docs.schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(documents(spark, sf_dir), WIDTH)
