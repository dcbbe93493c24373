"""Small tables for the text operators: the shapes that real ones have, and the odd ones."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHING = ("length", "shard", "fp", "spans", "places", "key", "ids", "rank", "n_words", "piece", "term", "pattern", "kept", "size")


def table_of(spark, texts, ids=None):
    """documents from texts, with extra columns whose names clash."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


PASSAGE = prose(99, 60, 5000)

#: Null, empty, blank, one word, non-ASCII, control characters, a copy of a row, near copies, a shared passage, a very long text.
ODD = [
    None, "", " \t\n ", "word", "Ærø ångström 日本語 🙂 ▁mark", "a\x0bb\x1cc d", prose(1, 80), prose(1, 80), prose(1, 80) + " tail",
    prose(2, 30) + " " + PASSAGE + " " + prose(3, 20), prose(4, 10) + "\n" + PASSAGE, "x" * 5000, prose(5, 20_000, 3000), "same line\nsame line\nsame line\n" * 10,
    "<|endoftext|> special", "loud! LOUD!! #*$%&|<>" * 8,
]


def by_id(rows):
    return {r["doc_id"]: r for r in rows}
