"""Quality rules: base limits, then gradient-boosted trees over document statistics.

The trees are fitted on the driver on at most TRAIN_ROWS labelled rows, those with the smallest hash of doc_id; every
document is scored. Fitted trees are flat numpy arrays of complete binary trees, so a batch is scored by a few gathers.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import blocks, documents, map_batches, own_columns, table
from subgrade.llm.textstats import COUNTS, FEATURES, counts_by_row, features_of, with_counts

#: The bound of the training sample.
TRAIN_ROWS = 20_000
#: More of these never raises a document's score.
MONOTONE = {"symbols_per_word": -1, "dup_lines_per_word": -1, "repeat_share": -1, "upper_share": -1, "marks_per_word": -1}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass
class Trees:
    """Complete trees of one depth: node k's children are 2k+1 and 2k+2. Rows go right where the feature exceeds the threshold."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes, inf where a node isn't split
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds by row."""
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3,
    bins: int = 64, least: float = 5.0, ridge: float = 1.0,
) -> Trees:
    """Boosted trees for the log-odds of y (0 or 1), split on quantile bins.

    monotone: -1, 0 or 1 by feature. A split is allowed only if its two leaf values are in the feature's order, and what
    lies below it is held to the right side of their mean, so that the sum is monotone in the feature.
    """
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    out = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(share / (1 - share))))
    if not n:
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)])  # bin > k: above cuts[k]
    score = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        limits = {0: (-np.inf, np.inf)}
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            low, high = limits[k]
            best, found = 1e-9, None
            g_all, w_all = gradient[rows].sum(), weight[rows].sum()
            for j in range(width) if len(rows) else ():
                if not len(cuts[j]):
                    continue
                g = np.bincount(binned[rows, j], gradient[rows], len(cuts[j]) + 1).cumsum()[:-1]
                w = np.bincount(binned[rows, j], weight[rows], len(cuts[j]) + 1).cumsum()[:-1]
                left, right = np.clip(g / (w + ridge), low, high), np.clip((g_all - g) / (w_all - w + ridge), low, high)
                gain = _gain(g, w, left, ridge) + _gain(g_all - g, w_all - w, right, ridge)
                gain -= _gain(g_all, w_all, np.clip(g_all / (w_all + ridge), low, high), ridge)
                allowed = (w >= least / 4) & (w_all - w >= least / 4) & (monotone[j] * (right - left) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, found = gain[at], (j, at, left[at], right[at])
            limits[2 * k + 1] = limits[2 * k + 2] = (low, high)
            if found:
                j, at, left_value, right_value = found
                middle = (left_value + right_value) / 2
                out.feature[t, k], out.threshold[t, k] = j, cuts[j][at]
                if monotone[j]:
                    lower, upper = (low, middle), (middle, high)
                    limits[2 * k + 1], limits[2 * k + 2] = (lower, upper) if monotone[j] > 0 else (upper, lower)
                node[rows] = 2 * k + 1 + (binned[rows, j] > at)
            else:
                node[rows] = 2 * k + 1
        for leaf in range(leaves):
            rows = node == inner + leaf
            value = gradient[rows].sum() / (weight[rows].sum() + ridge)
            out.value[t, leaf] = rate * np.clip(value, *limits[inner + leaf])
        score += out.value[t, node - inner]
    return out


def _gain(g, w, value, ridge):
    return 2 * g * value - (w + ridge) * value**2


def fit_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on the labelled documents whose hash of doc_id is smallest, at most train_rows of them.

    Several labels of one document count as their lowest; null labels and documents that fail the base limits are left
    out. Without labelled rows the trees hold the even prior, and without both classes the one class.
    """
    one = own_columns(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # one row of a doc_id, however often it is repeated, so that the bound holds
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    rows = with_counts(texts, "doc_id", "quality").drop("doc_id").toPandas()
    counts = rows[list(COUNTS)].to_numpy()
    usable = ~base_fails(counts)
    monotone = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return fit_trees(features_of(counts[usable]), (rows["quality"].to_numpy()[usable] > 0).astype(float), monotone)


def base_fails(counts: np.ndarray) -> np.ndarray:
    """Too few words, or too large a share of them in repeated windows."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def judge(docs: DataFrame, trees: Trees, threshold: float = 0.0) -> DataFrame:
    """doc_id, COUNTS, base_failed, score (log-odds of good quality) and kept of every row of docs, in one pass."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in COUNTS], "base_failed boolean, score double, kept boolean"])

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 1):
                counts = counts_by_row(texts)
                failed = base_fails(counts)
                score = trees.score(features_of(counts))
                made = [*[counts[:, i] for i in range(len(COUNTS))], failed, score, ~failed & (score >= threshold)]
                yield pa.record_batch([part.column(0), *map(pa.array, made)], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return map_batches(own_columns(docs, "doc_id", "text"), verdict, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The verdict on every row of docs: doc_id, COUNTS, base_failed, score, kept.

    Null and empty texts have no words and so fail; a text of any length counts whole; repeated rows are each judged; ties at the threshold are kept; an
    empty table gives no rows; without labels only the base limits decide; other columns are ignored.
    """
    return judge(docs, fit_rules(docs, labels, train_rows))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
