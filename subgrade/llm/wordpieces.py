"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of tokens that are popped when it is followed, so
a text's greedy longest-match tokens are counted in one pass over its characters, without building pieces. Within a
task all words of a block step through the automaton together, one character at a time.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from subgrade.llm.common import blocks, documents, map_batches, own_columns
from subgrade.llm.lookup import PairTable

WORD_START = "▁"
#: Longer words step through the automaton on their own, so that a block takes no more steps than this.
LONG_WORD = 256
BLOCK_CHARS = 2_000_000
_SPACES = np.array([0x20, *range(0x09, 0x0E)])


class Automaton:
    """pops[v], link[v]: tokens popped, and node reached, when no edge fits at node v; link -1: the word has no match.
    end[v]: tokens popped until nothing is left when a word ends at v, -1: no match."""

    def __init__(self, vocabulary: list[str]):
        children: list[dict[str, int]] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            v = 0
            for c in piece:
                if c not in children[v]:
                    children[v][c] = len(children)
                    children.append({})
                    is_piece.append(False)
                v = children[v][c]
            is_piece[v] = v > 0
        n = len(children)
        link, pops = [-1] * n, [0] * n
        level = [0]
        while level:
            following = []
            for u in level:
                for c, v in children[u].items():
                    following.append(v)
                    if is_piece[v]:
                        link[v], pops[v] = 0, 1
                        continue
                    z, popped = link[u], pops[u]
                    while z >= 0 and c not in children[z]:
                        popped, z = popped + pops[z], link[z]
                    if z >= 0:
                        link[v], pops[v] = children[z][c], popped
            level = following
        end = [0] * n
        for v in range(1, n):
            z, popped = v, 0
            while z > 0:
                popped, z = popped + pops[z], link[z]
            end[v] = popped if z == 0 else -1
        self.children = children
        self.link, self.pops, self.end = (np.array(x, dtype=np.int32) for x in (link, pops, end))
        self.start = children[0].get(WORD_START, -1)
        edges = np.array([(u, ord(c), v) for u, out in enumerate(children) for c, v in out.items()], dtype=np.int64).reshape(-1, 3)
        self.edges = PairTable(edges[:, 0], edges[:, 1], edges[:, 2])

    def count_word(self, word: str) -> int:
        """Tokens of one word, -1 if it has no match."""
        v, n = self.start, 0
        for c in word:
            while v >= 0 and c not in self.children[v]:
                n, v = n + int(self.pops[v]), int(self.link[v])
            if v < 0:
                return -1
            v = self.children[v][c]
        return n + int(self.end[v]) if v >= 0 and self.end[v] >= 0 else -1

    def count_words(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word chars[start : start + length], -1 where there is no match."""
        order = np.argsort(-lengths, kind="stable")
        at, length = starts[order], lengths[order]
        state = np.full(len(order), self.start, dtype=np.int32)
        count = np.zeros(len(order), dtype=np.int64)
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), "left")  # words longer than k
        for k in range(steps):
            m = active[k]
            now, c = state[:m], chars[at[:m] + k]
            after = self.edges.find(now, c)
            stuck = np.flatnonzero((after < 0) & (now >= 0))
            while len(stuck):
                count[stuck] += self.pops[now[stuck]]
                now[stuck] = self.link[now[stuck]]
                after[stuck] = self.edges.find(now[stuck], c[stuck])
                stuck = stuck[(after[stuck] < 0) & (now[stuck] >= 0)]
            state[:m] = after
        last = np.where(state >= 0, self.end[state], -1)
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.where(last >= 0, count + last, -1)
        return out


@lru_cache(maxsize=2)
def automaton(model_file: str) -> Automaton:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Automaton([sp.id_to_piece(i) for i in plain])


def count_texts(texts: list[str], machine: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, tokens and words without a match (one token each) of every text."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    inside = np.concatenate(([False], ~np.isin(chars, _SPACES), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, starts, "right")
    tokens = np.empty(len(starts), dtype=np.int64)
    short = lengths <= LONG_WORD
    tokens[short] = machine.count_words(chars, starts[short], lengths[short])
    for i in np.flatnonzero(~short):
        word = chars[starts[i] : starts[i] + lengths[i]].astype("<u4").tobytes().decode("utf-32-le")
        tokens[i] = machine.count_word(word)
    total = np.bincount(owner, np.abs(tokens), len(texts)).astype(np.int64)  # no match: -1, one token
    return np.bincount(owner, minlength=len(texts)), total, np.bincount(owner, tokens < 0, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row.

    A word, behind the mark of a word's start, is cut greedily into the longest pieces of the vocabulary; a word that
    can't be is one unknown token. Null and empty texts have none, of any length the whole text counts, repeated rows
    count each, an empty table gives no rows, other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(public_tokenizers.path(model))
        for batch in batches:
            for part, texts in blocks(batch, 1, BLOCK_CHARS):
                made = count_texts([t or "" for t in texts], machine)
                yield pa.record_batch([part.column(0), *map(pa.array, made)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_batches(own_columns(docs, "doc_id", "text"), count, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
