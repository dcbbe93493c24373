"""Each stage of the pipeline against its operator, or brute force, on its own input."""

import pytest

import corpus_pipeline as P
from subgrade.llm import nearcopies, packing, rules, substrings, weaklabels
from subgrade.llm.common import documents, table
from tests.conftest import DATA
from tests.llm.fixtures import ODD, table_of
from tests.llm.test_packing import check
from tests.llm.test_substring_dedup import brute, words


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, str(DATA)), []
    for name, stage in P.STAGES:
        made = P.written(stage(spark, docs, str(DATA)), name.replace(" ", "-"))
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_rejected_documents_go(spark, stages):
    labels = table(spark, str(DATA), "labels")
    for (before, after), verdict in zip(stages[:2], (weaklabels.quality_classifier, rules.quality_rules)):
        kept = sorted(r.doc_id for r in verdict(before, labels).filter("kept").collect())
        assert ids(after) == kept
        assert 0 < len(kept)


def shingles(text, width=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_one_of_each_group_of_near_copies_stays(stages):
    """Exactly the smallest doc_id of what chains of similarity 0.8 or more connect."""
    before, after = stages[2]
    sets = {r.doc_id: shingles(r.text) for r in before.collect()}
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for d, a in sets.items():
            for e, b in sets.items():
                if least[e] < least[d] and 5 * len(a & b) >= 4 * len(a | b):
                    least[d], changed = least[e], True
    assert ids(after) == sorted(d for d in sets if least[d] == d)
    assert len(ids(after)) < len(sets)


def test_passages_go(stages):
    before, after = stages[3]
    wanted = brute([(r.doc_id, r.text) for r in before.collect()], substrings.WIDTH)
    assert {r.doc_id: words(r.text) for r in after.collect()} == {d: kept for d, (_, kept) in wanted.items()}


def test_packing(spark, stages):
    before, after = stages[4]
    check(after.collect(), {r.doc_id: r.text for r in before.collect()})


def test_run_gives_the_last_stage(spark, stages):
    assert P.run(spark, str(DATA)).count() == stages[-1][1].count()


def test_odd_documents_through_every_stage(spark):
    docs = table_of(spark, ODD)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(DATA))
        docs.collect()
    empty = table_of(spark, [])
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(DATA))
        assert empty.count() == 0


def test_stages_call_the_operators():
    assert P.pack_documents is packing.pack_documents and P.drop_near_duplicates is nearcopies.drop_near_duplicates
