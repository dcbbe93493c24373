from math import log

from subgrade.llm import backoff
from tests.conftest import DATA, same_rows
from tests.llm.fixtures import ODD, table_of


def brute(texts, order, alpha):
    """Scores by plain dictionaries of n-gram counts, for each document those of the others."""
    words = [(t or "").encode().split() for t in texts]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    total, own = {}, [{} for _ in words]
    for d, w in enumerate(words):
        for n in range(1, order + 1):
            for g in grams(w, n):
                total[g] = total.get(g, 0) + 1
                own[d][g] = own[d].get(g, 0) + 1
    everything = sum(map(len, words))
    out = []
    for d, w in enumerate(words):
        count = lambda g: total.get(g, 0) - own[d].get(g, 0)  # noqa: B023, E731
        score, backoffs = 0.0, 0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += log(max(count(gram), 0.5) / max(everything - len(w), 1))
                elif count(gram) > 0:
                    score += log(count(gram) / count(gram[:-1]))
                    break
                else:
                    score += log(alpha)
                    backoffs += 1
        out.append((len(w), backoffs, score))
    return out


def test_query_against_sql(spark, duck):
    got, wanted = backoff.op7_lm_scoring(spark, str(DATA)).toPandas(), duck.sql(backoff.OP7_SQL).df()
    joined = got.merge(wanted, on="doc_id", suffixes=("", "_sql"))
    assert len(joined) == len(got) == len(wanted)
    assert (joined["n_words"] == joined["n_words_sql"]).all() and (joined["n_backoffs"] == joined["n_backoffs_sql"]).all()
    assert (joined["log_score"] - joined["log_score_sql"]).abs().max() < 2e-3


def test_odd_texts_in_small_chunks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(backoff, "PARTITION_GRAMS", 5000)
    monkeypatch.setattr(backoff.chunked, "__defaults__", (200,))
    for order in (1, 2, 3):
        rows = {r.doc_id: r for r in backoff.backoff_scores(table_of(spark, ODD).repartition(3), order=order).collect()}
        for d, (n, backoffs, score) in enumerate(brute(ODD, order, backoff.ALPHA)):
            assert (rows[d].n_words, rows[d].n_backoffs) == (n, backoffs)
            assert abs(rows[d].log_score - score) < 1e-6 * max(1, abs(score))


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    rows = backoff.backoff_scores(table_of(spark, ["a b", "a b"], [None, None])).collect()
    assert [(r.n_words, r.n_backoffs) for r in rows] == [(2, 0), (2, 0)]
    assert backoff.backoff_scores(table_of(spark, [])).count() == 0
    assert backoff.backoff_scores(table_of(spark, [None, ""])).count() == 2


def test_packed_columns_come_back():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert np.array_equal(backoff.unpack_sorted(backoff.pack_sorted(keys)), keys)
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert np.array_equal(backoff.unpack_counts(backoff.pack_counts(counts)), counts)
