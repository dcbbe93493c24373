"""Statistics of one text, and of a column of texts inside a task."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from subgrade.llm.common import blocks, map_batches, own_columns

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_marks")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def repeated_words(codes: np.ndarray, width: int = 3) -> int:
    """How many words lie in a window of `width` words that is found twice or more; codes tell words apart."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    window = codes[:n].astype(np.uint64)
    for k in range(1, width):
        window = (window ^ (window >> np.uint64(29))) * _MIX[k % 2] + codes[k : n + k].astype(np.uint64)
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, twice)
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(width):
        covered[k : n + k] |= hit
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; a null one has no words."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        repeated_lines(text),
        repeated_words(codes),
        len(set(words)),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, DIGITS)),
        text.count("!") + text.count("?"),
    )


def counts_by_row(texts: list) -> np.ndarray:
    return np.array([counts_of(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and COUNTS (long) of the text of each row."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += "".join(f", {c} long" for c in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, len(keep)):
                made = counts_by_row(texts)
                columns = [part.column(i) for i in range(len(keep))] + [pa.array(made[:, i]) for i in range(len(COUNTS))]
                yield pa.record_batch(columns, [*keep, *COUNTS])

    return map_batches(own_columns(docs, *keep, "text"), count, schema)


def features_of(counts: np.ndarray) -> np.ndarray:
    """FEATURES by row, from COUNTS by row; shares of nothing are 0."""
    c = counts.astype(float)
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    return np.column_stack([
        np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / words, c[:, 3] / words, c[:, 4] / words,
        c[:, 5] / words, c[:, 6] / chars, c[:, 7] / chars, c[:, 8] / words,
    ])


FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_lines_per_word", "repeat_share",
    "distinct_share", "upper_share", "digit_share", "marks_per_word",
)
