"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or not at all on every document. How often each combination of votes occurs, over
all documents, is all that expectation-maximisation needs to estimate the labellers' accuracies and the chance that a
combination is good: at most 4**8 counts, whatever the corpus. Those chances, on a bounded sample of the labelled rows,
then train a linear scorer of hashed words and votes, and that scores every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import blocks, documents, map_batches, own_columns, table
from subgrade.llm.textstats import counts_of, features_of

#: Bounds of the labelled rows from which flagged terms are found, and of those that train the scorer.
TERM_ROWS = 20_000
TRAIN_ROWS = 10_000
#: A flagged term is in this share of the toxic rows at least, and that share of the rows with it are toxic.
TERM_SUPPORT, TERM_LEAST, TERM_PRECISION = 0.01, 4, 0.95
DIMENSIONS = 1 << 18
#: Features of the training rows that the fit works on at a time.
FIT_FEATURES = 500_000
LABELLERS = ("symbols", "marks", "capitals", "repeats", "lines", "varied", "lengths", "flagged")
#: Words that a text needs for each labeller, and the vote where it has fewer: no evidence for either class.
LEAST_WORDS = np.array([1, 1, 10, 20, 20, 50, 20, 1])
UNFIT = 2

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> set[bytes]:
    """Distinct runs of letters, A-Z in lower case."""
    return set(text.encode().translate(_TERM_BYTES).split())


def votes_of(counts: np.ndarray, flagged: np.ndarray) -> np.ndarray:
    """By row and labeller: 1 good, -1 bad, 0 no vote, UNFIT where the text is too short for the labeller.

    No labeller vouches for texts with flagged terms or that are full of symbols, marks or repeats.
    """
    words = counts[:, 0]
    f = features_of(counts)
    chars, symbols, lines, repeats, distinct, upper, marks = f[:, 1], f[:, 2], f[:, 3], f[:, 4], f[:, 5], f[:, 6], f[:, 8]
    none = np.zeros(len(words), dtype=bool)
    noisy, loud, looped = symbols > 0.1, marks > 0.3, (repeats > 0.3) & (words >= 20)
    bad = np.column_stack([
        noisy, loud, upper > 0.25, repeats > 0.3, lines > 0.02, distinct < 0.3, (chars > 6.8) | (chars < 3), flagged,
    ])
    good = np.column_stack([
        none, none, upper < 0.15, repeats < 0.1, none, distinct > 0.4, (chars > 3.8) & (chars < 6.2), none,
    ]) & ~(flagged | noisy | loud | looped)[:, None]
    return np.where(words[:, None] < LEAST_WORDS, UNFIT, np.where(bad, -1, good.astype(np.int64)))


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """One number for each combination of votes."""
    return (votes + 1) @ 4 ** np.arange(votes.shape[1])


def votes_in(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 4 ** np.arange(len(LABELLERS)) % 4 - 1


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote combinations: chance of good by combination; of each vote by class and
    labeller (2 x labellers x votes -1, 0, 1); prior of good. Starts from the majority of votes."""
    votes = votes_in(patterns)
    total = np.where(votes == UNFIT, 0, votes).sum(axis=1)
    chance = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.6))
    weight = counts.astype(float)
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        of_class = np.stack([weight * (1 - chance), weight * chance])
        prior = (of_class[1].sum() + 1) / (weight.sum() + 2)
        table_ = np.einsum("cp,plv->clv", of_class, shown) + 0.5
        table_ /= table_.sum(axis=2, keepdims=True)
        log = np.einsum("plv,clv->cp", shown, np.log(table_)) + np.log([1 - prior, prior])[:, None]
        now = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(now - chance).max(initial=0) < 1e-7:
            break
        chance = now
    return chance, table_, prior


def hashed(terms: set[bytes], votes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Feature numbers of one document: its labellers' votes, then its terms."""
    named = [f"{name}={int(v)}".encode() for name, v in zip(LABELLERS, votes)]
    return np.fromiter((xxhash.xxh32_intdigest(x) % dimensions for x in (*named, *sorted(terms))), np.int32)


def feature_values(n: int) -> np.ndarray:
    """Votes weigh 1 each, all terms together 1 in length."""
    k = len(LABELLERS)
    return np.concatenate((np.ones(k), np.full(n - k, (n - k) ** -0.5 if n > k else 0.0)))


def fit_scorer(rows: list[np.ndarray], chance: np.ndarray, dimensions: int = DIMENSIONS, steps: int = 60, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features against chances, by full-batch steps of adaptive size."""
    w, bias = np.zeros(dimensions + 1), dimensions
    if not rows:
        return w[:-1], 0.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    lengths = np.array([len(r) for r in rows])
    # a few rows at a time, so that no array holds a number for each feature of all rows
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // FIT_FEATURES)) + 1).tolist(), len(rows)]
    parts = [(a, b, np.concatenate(rows[a:b]), np.concatenate([feature_values(n) for n in lengths[a:b]]).astype(np.float32)) for a, b in zip(cuts, cuts[1:])]
    for t in range(1, steps + 1):
        gradient = decay * w / len(rows)
        for a, b, at, value in parts:
            z = np.add.reduceat(value * w[at], np.cumsum(lengths[a:b]) - lengths[a:b]) + w[bias]
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - chance[a:b]) / len(rows)
            gradient += np.bincount(at, value * np.repeat(error, lengths[a:b]), len(w))
            gradient[bias] += error.sum()
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[bias])


@dataclass
class Classifier:
    """flagged: terms of toxic texts. chances: of good, by vote combination seen. weights, bias: the scorer."""

    flagged: frozenset[bytes]
    chances: dict[int, float]
    accuracies: np.ndarray
    prior: float
    weights: np.ndarray
    bias: float


def flagged_terms(docs: DataFrame, labels: DataFrame, rows: int = TERM_ROWS) -> frozenset[bytes]:
    """Terms that mark toxic texts, from the labelled documents with the smallest hash of doc_id, at most `rows`."""
    one = own_columns(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 0):
                terms = [list(terms_of(t or "")) for t in texts]
                toxic = np.repeat((part.column(1).to_numpy() > 0).astype(np.int32), [len(t) for t in terms])
                yield pa.record_batch([pa.array([x for t in terms for x in t], pa.binary()), pa.array(toxic)], ["term", "toxic"])

    toxic_rows = sample.filter("toxic > 0").count()
    least = max(TERM_LEAST, TERM_SUPPORT * toxic_rows)
    found = map_batches(texts, explode, "term binary, toxic int").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    kept = found.filter((F.col("toxic") >= least) & (F.col("toxic") >= TERM_PRECISION * F.col("n")))
    return frozenset(bytes(r.term) for r in kept.select("term").collect())


def _votes(texts: list, flagged: frozenset[bytes]) -> tuple[np.ndarray, list[set[bytes]]]:
    terms = [terms_of(t or "") for t in texts]
    counts = np.array([counts_of(t) for t in texts], dtype=np.int64).reshape(len(texts), -1)
    return votes_of(counts, np.array([not flagged.isdisjoint(t) for t in terms], dtype=bool)), terms


def vote_counts(docs: DataFrame, flagged: frozenset[bytes]) -> DataFrame:
    """pattern and how many of all documents have it."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch, 0):
                yield pa.record_batch([pa.array(pattern_of(_votes(texts, flagged)[0]))], ["pattern"])

    return map_batches(own_columns(docs, "text"), vote, "pattern long").groupBy("pattern").agg(F.count("*").alias("n"))


def fit_classifier(docs: DataFrame, labels: DataFrame, term_rows: int = TERM_ROWS, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Labels tell which terms are flagged, and which documents, at most train_rows, the scorer is fitted on. What is good there
    too is estimated from the votes on all documents. Without labels the scorer is fitted on the combinations of votes."""
    flagged = flagged_terms(docs, labels, term_rows)
    seen = sorted((r.pattern, r.n) for r in vote_counts(docs, flagged).collect())
    patterns, n = (np.array([x[i] for x in seen], dtype=np.int64) for i in (0, 1))
    chance, accuracies, prior = estimate(patterns, n)
    chances = dict(zip(patterns.tolist(), chance.tolist()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch, 0):
                votes, terms = _votes(texts, flagged)
                yield pa.record_batch([pa.array(pattern_of(votes)), pa.array([hashed(t, v).tobytes() for t, v in zip(terms, votes)], pa.binary())], ["pattern", "features"])

    # ids first, so that no more than the sample's texts move; one row of each, so that the bound holds
    ids = own_columns(labels, "doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text")
    sample = map_batches(texts, features, "pattern long, features binary").collect()
    rows = [np.frombuffer(r.features, np.int32) for r in sample]
    chance = [chances.get(r.pattern, prior) for r in sample]
    # each combination of votes trains the votes' weights by a row without terms too, however rare it is in the sample
    rows += [hashed(set(), v) for v in votes_in(patterns)]
    weights, bias = fit_scorer(rows, np.array(chance + [chances[p] for p in patterns.tolist()]))
    return Classifier(flagged, chances, accuracies, prior, weights.astype(np.float32), bias)


def classify(docs: DataFrame, model: Classifier, threshold: float = 0.0) -> DataFrame:
    """doc_id, votes, flagged, posterior, score, kept of every row of docs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 1):
                votes, terms = _votes(texts, model.flagged)
                patterns = pattern_of(votes)
                score = np.empty(len(terms))
                for i, (t, v) in enumerate(zip(terms, votes)):
                    x = hashed(t, v)
                    score[i] = model.weights[x] @ feature_values(len(x)) + model.bias
                signs = ["".join("-.+?"[v + 1] for v in row) for row in votes]
                posterior = [model.chances.get(int(p), model.prior) for p in patterns]
                columns = [pa.array(signs, pa.string()), pa.array(votes[:, -1] < 0), pa.array(posterior, pa.float64()), pa.array(score), pa.array(score >= threshold)]
                yield pa.record_batch([part.column(0), *columns], ["doc_id", "votes", "flagged", "posterior", "score", "kept"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_batches(own_columns(docs, "doc_id", "text"), judge, f"doc_id {kind}, votes string, flagged boolean, posterior double, score double, kept boolean")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every row of docs: doc_id, votes (-, ., + or ? by labeller), flagged (has a flagged term), posterior
    (chance of good from the votes), score (the scorer's log-odds) and kept.

    Null and empty texts get no votes and the score of that; a text of any length is judged whole; repeated rows score alike; ties at the threshold are kept;
    without labels no term is flagged; an empty table gives no rows; other columns are ignored.
    """
    return classify(docs, fit_classifier(docs, labels))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
