"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model's merges are followed as its own agenda does: the candidate with the best score merges next, the leftmost on
ties. Each candidate is first put to a keyed hash of (seed, row key, where its two symbols begin and end in the text);
those whose hash falls below the dropout rate are skipped for good. So a segmentation depends on the seed and the row
alone, not on how rows are dealt to tasks. No piece goes over the start of a word, so the words of a block are
independent, and each round takes one candidate of every word of the block at once.
"""

from __future__ import annotations

import heapq
from functools import lru_cache
from typing import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import blocks, documents, map_batches
from subgrade.llm.lookup import PairTable

MARK = 0x2581
NONE = np.int64(1) << 30
#: Longer words follow their own agenda, so that a block takes few rounds.
LONG_WORD = 48
BLOCK_CHARS = 250_000
_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def candidate_hash(seed: int, key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for a candidate merge of text[begin:middle] and text[middle:end] of the row with this key."""
    x = key.astype(np.uint64) ^ np.uint64(seed * int(_C) % 2**64)
    for part in ((begin << 32) | end, middle):
        x = (x ^ part.astype(np.uint64)) * _A
        x ^= x >> np.uint64(29)
        x *= _B
        x ^= x >> np.uint64(32)
    return x


class Model:
    """What encoding and decoding need of a merge-type SentencePiece model with byte fallback and no text normalising."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = len(sp)
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.first_byte = sp.piece_to_id("<0x00>")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {pieces[i]: i for i in plain}
        mark = chr(MARK)
        if any(mark in p.lstrip(mark) for p in ids):
            raise ValueError("a piece of this model goes over the start of a word")
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        by_score = sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.piece_of_rank = np.array(by_score, dtype=np.int32)
        pairs = [(ids[p[:k]], ids[p[k:]], rank) for rank, i in enumerate(by_score) for p in [pieces[i]] for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.rank_of_pair = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)
        self.pair_rank = {(a, b): r for a, b, r in pairs}
        self.bytes_of = [p.replace(mark, " ").encode() for p in pieces]
        for b in range(256):
            self.bytes_of[self.first_byte + b] = bytes([b])


@lru_cache(maxsize=2)
def model(name: str) -> Model:
    return Model(public_tokenizers.path(name))


def agenda_of_word(m: Model, symbols: list[int], begin: int, key: int, seed: int, below: int) -> tuple[list[int], list[int]]:
    """The same agenda for one word, with a heap: its final symbols and where each begins."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    ends = [begin + i + 1 for i in range(n)]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i] if i >= 0 else -1
        if j >= 0:
            rank = m.pair_rank.get((symbols[i], symbols[j]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, ends[i], ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i, j, middle, end = heapq.heappop(heap)
        if not (alive[i] and alive[j] and ends[i] == middle and ends[j] == end):
            continue
        if below:
            at = (np.array([x], dtype=np.int64) for x in (key, begin + i, middle, end))
            if int(candidate_hash(seed, *at)[0]) < below:
                continue
        symbols[i], ends[i], alive[j], right[i] = int(m.piece_of_rank[rank]), end, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    kept = [i for i in range(n) if alive[i]]
    return [symbols[i] for i in kept], [begin + i for i in kept]


def _words_together(m: Model, symbols, where, heads, stops, key, origin, seed: int, below: int):
    """The final symbols of all words of a block, and their places in the block.

    heads: where each word begins in the arrays; stops: the place where it ends; origin: the place where its text begins.
    """
    found = m.rank_of_pair.find(symbols[:-1], symbols[1:])
    candidate = np.full(len(symbols), NONE)
    candidate[:-1] = np.where(found >= 0, found, NONE)
    candidate[heads[1:] - 1] = NONE
    done_symbols, done_where = [], []
    while True:
        best = np.minimum.reduceat((candidate << 32) | np.arange(len(candidate)), heads)
        going = (best >> 32) < NONE
        if not going.all():
            # words without a candidate are final and leave the block
            sizes = np.diff(np.append(heads, len(symbols)))
            stay = np.repeat(going, sizes)
            done_symbols.append(symbols[~stay])
            done_where.append(where[~stay])
            if not going.any():
                return done_symbols, done_where
            moved = np.cumsum(stay) - 1
            symbols, where, candidate = symbols[stay], where[stay], candidate[stay]
            heads = np.concatenate(([0], np.cumsum(sizes[going])[:-1]))
            best, stops, key, origin = best[going], stops[going], key[going], origin[going]
            at = moved[best & 0xFFFFFFFF]
        else:
            at = best & 0xFFFFFFFF
        chosen = best >> 32
        is_head = np.zeros(len(symbols) + 1, dtype=bool)
        is_head[heads] = is_head[-1] = True
        last = is_head[at + 2]  # the right symbol is its word's last
        if below:
            end = np.where(last, stops, where[np.minimum(at + 2, len(where) - 1)])
            skipped = candidate_hash(seed, key, where[at] - origin, where[at + 1] - origin, end - origin) < np.uint64(below)
            candidate[at[skipped]] = NONE
            at, chosen, last = at[~skipped], chosen[~skipped], last[~skipped]
        symbols[at] = m.piece_of_rank[chosen]
        candidate[at] = NONE
        right = at[~last]
        found = m.rank_of_pair.find(symbols[right], symbols[right + 2])
        candidate[right] = np.where(found >= 0, found, NONE)
        left = at[~is_head[at]]
        found = m.rank_of_pair.find(symbols[left - 1], symbols[left])
        candidate[left - 1] = np.where(found >= 0, found, NONE)
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        heads = heads - np.searchsorted(at + 1, heads, "left")
        symbols, where, candidate = symbols[keep], where[keep], candidate[keep]


def encode_texts(texts: list[str], keys: list[int], m: Model, dropout: float, seed: int) -> list[np.ndarray]:
    """Ids of every text. A text begins with the mark of a word's start, as in the model's own encoding; an empty one has none."""
    marked = [" " + t if t else "" for t in texts]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    if not len(chars):
        return [np.zeros(0, dtype=np.int32)] * len(texts)
    sizes = np.array([len(t) for t in marked], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    text_of = np.repeat(np.arange(len(texts)), sizes)
    space = chars == 0x20
    # the mark itself would decode to a space: it goes by its bytes
    symbols = np.where(space, m.char_id[MARK], np.where(chars == MARK, -1, m.char_id[chars])).astype(np.int32)
    head = space & np.concatenate(([True], ~space[:-1]))
    head[begins[sizes > 0]] = True
    heads = np.flatnonzero(head)
    stops = np.append(heads[1:], len(chars))
    key = np.array(keys, dtype=np.int64)[text_of[heads]]
    origin = begins[text_of[heads]]
    below = min(int(dropout * 2**64), 2**64 - 1)
    short = stops - heads <= LONG_WORD
    final, at = [], []
    if short.any():
        inside = np.repeat(short, stops - heads)
        first = np.concatenate(([0], np.cumsum((stops - heads)[short])[:-1]))
        final, at = _words_together(m, symbols[inside], np.flatnonzero(inside), first, stops[short], key[short], origin[short], seed, below)
    for i in np.flatnonzero(~short):
        made, places = agenda_of_word(m, symbols[heads[i] : stops[i]].tolist(), int(heads[i] - origin[i]), int(key[i]), seed, below)
        final.append(np.array(made, dtype=np.int32))
        at.append(np.array(places) + origin[i])
    final, at = np.concatenate(final), np.concatenate(at)
    placed = np.full(len(chars), -2, dtype=np.int32)
    placed[at] = final
    at = np.flatnonzero(placed != -2)
    ids = placed[at]
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        raw = [chr(int(c)).encode() for c in chars[at[unknown]]]
        times = np.ones(len(ids), dtype=np.int64)
        times[unknown] = [len(r) for r in raw]
        at, spread = np.repeat(at, times), np.repeat(ids, times)
        spread[spread < 0] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int32) + m.first_byte
        ids = spread
    return np.split(ids, np.searchsorted(at, ends[:-1]))


def decode_ids(ids, m: Model) -> str:
    """The text of ids, without the leading mark of the encoding."""
    raw = b"".join(map(m.bytes_of.__getitem__, ids))
    return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


def encode_documents(docs: DataFrame, dropout: float = 0.1, seed: int = 42, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text and ids (array<int>) of every row; dropout 0 gives the model's own encoding.

    A null text has null ids, an empty one none; characters outside the vocabulary go by their bytes; a text of any
    length is encoded whole; repeated rows with one doc_id are encoded alike; an empty table gives no rows; other
    columns are ignored.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for batch in batches:
            for part, texts in blocks(batch, 1, BLOCK_CHARS):
                ids = encode_texts([t or "" for t in texts], part.column(2).to_pylist(), m, dropout, seed)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                gone = np.append([t is None for t in texts], False)
                made = pa.ListArray.from_arrays(pa.array(offsets, mask=gone), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.record_batch([part.column(0), part.column(1), made], ["doc_id", "text", "ids"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_batches(keyed, encode, f"doc_id {kind}, text string, ids array<int>")


def decode_documents(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text, ids and decoded, the text that the ids give, of every row.

    Null ids give a null text and no ids an empty one; ids of any number are decoded whole; repeated rows are decoded
    each; bytes that are no UTF-8 become replacement characters; an empty table gives no rows; other columns are ignored.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for batch in batches:
            for part, _ in blocks(batch, 1, BLOCK_CHARS):
                texts = [decode_ids(x.values.to_numpy().tolist(), m) if x.is_valid else None for x in part.column(2)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], ["doc_id", "text", "ids", "decoded"])

    cols = encoded.select("doc_id", "text", "ids")
    kind = encoded.select("doc_id").schema[0].dataType.simpleString()
    return map_batches(cols, decode, f"doc_id {kind}, text string, ids array<int>, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode_documents(encode_documents(documents(spark, sf_dir), dropout=0.1, seed=42))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
