import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from subgrade.llm import rules, textstats
from tests.conftest import DATA
from tests.llm.fixtures import ODD, by_id, table_of

SPACE = " \t\n\x0b\x0c\r"
LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if any(c not in SPACE for c in x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 300 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def agree(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, *rest = plain_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest], r.doc_id
        failed = n < 50 or 100 * rest[-1] > 50 * n
        assert r.base_failed == failed and not (failed and r.kept)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    agree(rules.op9_quality_rules(spark, str(DATA)).collect(), texts)


def test_odd_texts_without_labels_and_an_empty_table(spark):
    none = spark.createDataFrame([], LABELS)
    rows = rules.quality_rules(table_of(spark, ODD), none).collect()
    agree(rows, dict(enumerate(ODD)))
    assert all(r.kept != r.base_failed for r in rows)
    assert rules.quality_rules(table_of(spark, []), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 1, 0), (6, 0, 0)], LABELS)
    assert rules.quality_rules(table_of(spark, ODD), odd).count() == len(ODD)


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n#", max_size=80))
def test_counts_of_any_text(text):
    n, *rest = plain_counts(text)
    assert list(textstats.counts_of(text)[:5]) == [n, *rest]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rows = by_id(rules.quality_rules(docs, labels.filter(half == 0)).collect())
    held = [(rows[r.doc_id], r.quality > 0) for r in labels.filter(half == 1).collect()]
    judged = [(r["kept"], good) for r, good in held if not r["base_failed"]]
    assert len(judged) > 100
    assert np.mean([kept == good for kept, good in judged]) > 0.97
    assert np.mean([kept for kept, good in judged if good]) > 0.97


def test_scores_never_rise_with_a_monotone_feature():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.3 * x[:, 1] + 0.3 * r.random(2000)) < 0.8).astype(float)
    trees = rules.fit_trees(x, y, np.array([-1, 0, 1]))
    for j, sign in ((0, -1), (2, 1)):
        grid = np.repeat(r.random((50, 3)), 40, axis=0)
        grid[:, j] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
        steps = np.diff(trees.score(grid).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12
    assert np.mean((trees.score(x) > 0) == (y > 0)) > 0.8
