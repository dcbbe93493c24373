import numpy as np

from subgrade.llm import weaklabels
from tests.llm.fixtures import ODD, by_id, table_of

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    """The labels' quality takes no part in the fit, and toxic labels only of one half: the verdicts on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = by_id(weaklabels.quality_classifier(docs, labels.filter("doc_id % 2 = 0")).collect())
    assert len(rows) == docs.count()
    held = [(rows[r.doc_id]["kept"], r.quality > 0 and not r.toxic) for r in labels.filter("doc_id % 2 = 1").collect()]
    accuracy = np.mean([kept == good for kept, good in held])
    of_good, of_bad = (np.mean([kept for kept, good in held if good == g]) for g in (True, False))
    print(f"accuracy {accuracy:.3f}, kept of good {of_good:.3f}, of bad {of_bad:.3f}, rows {len(held)}")
    assert accuracy > 0.85 and of_good > 0.9 and of_bad < 0.4


def plain_estimate(votes, rounds=100):
    """Expectation-maximisation document by document, with the operator's start and its half a vote of each kind."""
    chance = [0.9 if s > 0 else 0.1 if s < 0 else 0.6 for s in (sum(v for v in row if v != weaklabels.UNFIT) for row in votes)]
    for _ in range(rounds):
        prior = (sum(chance) + 1) / (len(votes) + 2)
        share = {}
        for c in (0, 1):
            for k in range(len(votes[0])):
                of = {v: 0.5 + sum(p if c else 1 - p for row, p in zip(votes, chance) if row[k] == v) for v in (-1, 0, 1)}
                share.update({(c, k, v): n / sum(of.values()) for v, n in of.items()})
        chance = []
        for row in votes:
            good, bad = prior, 1 - prior
            for k, v in enumerate(row):
                if v != weaklabels.UNFIT:
                    good, bad = good * share[1, k, v], bad * share[0, k, v]
            chance.append(good / (good + bad))
    return chance, prior


def test_estimation_by_counts_is_that_by_documents():
    r = np.random.default_rng(4)
    k = len(weaklabels.LABELLERS)
    good = r.random(150) < 0.6
    votes = np.where(r.random((150, k)) < 0.75, np.where(good, 1, -1)[:, None], 0)
    votes[r.random((150, k)) < 0.1] = weaklabels.UNFIT
    patterns, inverse, counts = np.unique(weaklabels.pattern_of(votes), return_inverse=True, return_counts=True)
    chance, _, prior = weaklabels.estimate(patterns, counts)
    wanted, wanted_prior = plain_estimate(votes.tolist())
    assert np.abs(chance[inverse] - wanted).max() < 1e-4
    assert abs(prior - wanted_prior) < 1e-4


def test_a_rare_combination_of_votes_is_judged_by_its_chance(spark):
    docs = [f"the plain words number {i} are here and calm enough to read in peace over a long day at home" for i in range(60)]
    model = weaklabels.fit_classifier(table_of(spark, [*docs, "#$% #$% #$% *&|"]), spark.createDataFrame([], LABELS), train_rows=5)
    assert len(model.chances) > 1
    rows = by_id(weaklabels.classify(table_of(spark, [docs[0], "#$% #$% #$% *&|"]), model).collect())
    assert rows[0]["score"] > rows[1]["score"]


def test_the_scorer_is_fitted_on_labelled_rows_alone(spark):
    """A document without a label counts in the votes, and its words have no weight."""
    docs = [f"the plain words number {i} are here and calm enough to read in peace over a long day at home" for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(19)] + [(999, 1, 0)], LABELS)
    model = weaklabels.fit_classifier(table_of(spark, [*docs, docs[0] + " quillwort"]), labels)
    term = weaklabels.hashed({b"quillwort"}, np.zeros(len(weaklabels.LABELLERS), int))[-1]
    seen = weaklabels.hashed({b"plain"}, np.zeros(len(weaklabels.LABELLERS), int))[-1]
    assert model.weights[term] == 0 and model.weights[seen] != 0


def test_toxic_texts_go_and_clean_ones_stay(spark):
    docs = [f"the plain words number {i} are here and calm enough to read in peace over a long day at home" for i in range(40)]
    toxic = [d + " vilegrub" for d in docs[:20]]
    table = table_of(spark, docs[20:] + toxic)
    labels = spark.createDataFrame([(i, 1, int(i >= 20)) for i in range(30)], LABELS)
    rows = by_id(weaklabels.quality_classifier(table, labels).collect())
    assert all(rows[i]["kept"] for i in range(20))
    assert all(rows[i]["flagged"] and not rows[i]["kept"] for i in range(20, 40))


def test_estimation_finds_accuracies_from_votes_alone():
    r = np.random.default_rng(3)
    n, k = 20_000, len(weaklabels.LABELLERS)
    good = r.random(n) < 0.7
    right = np.linspace(0.6, 0.95, k)
    votes = np.where(r.random((n, k)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[r.random((n, k)) < 0.2] = 0
    patterns, inverse, counts = np.unique(weaklabels.pattern_of(votes), return_inverse=True, return_counts=True)
    assert np.array_equal(weaklabels.votes_in(patterns)[inverse], votes)
    chance, table, prior = weaklabels.estimate(patterns, counts)
    assert abs(prior - 0.7) < 0.02
    assert np.abs(table[1, :, 2] / (table[1, :, 0] + table[1, :, 2]) - right).max() < 0.03
    assert np.mean((chance[inverse] > 0.5) == good) > 0.95


def test_odd_texts_no_labels_and_an_empty_table(spark):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (0, 1, 0)], LABELS)
    rows = weaklabels.quality_classifier(table_of(spark, ODD), labels).collect()
    assert len(rows) == len(ODD)
    assert len({(r.votes, r.score) for r in rows if r.doc_id in (0, 1)}) == 1
    assert rows[6].score == rows[7].score
    none = spark.createDataFrame([], LABELS)
    assert not any(r.flagged for r in weaklabels.quality_classifier(table_of(spark, ODD), none).collect())
    assert weaklabels.quality_classifier(table_of(spark, []), none).count() == 0
