import random

import numpy as np
import pytest

from subgrade.llm import nearcopies, shinglesets
from subgrade.llm.fingerprints import fingerprint
from tests.llm.fixtures import by_id, prose, table_of


def sets_of(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def likeness(a, b):
    a, b = sets_of(a), sets_of(b)
    return len(a & b) / len(a | b)


def brute(texts):
    """The smallest id that chains of texts at 0.8 or more reach."""
    sets = [sets_of(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def with_tail(seed, shared, own):
    """Two texts that share their first words: `shared` shingles of shared + 2 * own."""
    head = prose(seed, shared + 4, 10**6)
    return [f"{head} {prose(seed + k, own, 10**6)}" for k in (10**6, 2 * 10**6)]


def test_every_pair_from_the_threshold_up_is_found(spark):
    pairs = [with_tail(k, 400, own) for k, own in enumerate([50, 48, 45, 40, 36] * 12)]
    like = [likeness(*p) for p in pairs]
    assert min(like) == 0.8 and max(like) < 0.86
    kept = by_id(nearcopies.drop_near_duplicates(table_of(spark, [t for p in pairs for t in p])).collect())
    assert sorted(kept) == list(range(0, 2 * len(pairs), 2))


def test_pairs_below_the_threshold_stay(spark):
    texts = [t for k, own in enumerate([51, 53, 57, 66] * 15) for t in with_tail(k, 400, own)]
    assert all(0.74 < likeness(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2]))
    assert nearcopies.drop_near_duplicates(table_of(spark, texts)).count() == len(texts)


def crowd(r, n):
    """Copies of one text with a few, or many, words changed, and texts that share a line."""
    base, line, out = prose(1, 150, 10**6).split(), prose(2, 20, 10**6), []
    for k in range(n):
        words = base[:]
        for at in r.sample(range(150), r.choice([1, 2, 3, 8])):
            words[at] = f"c{r.randrange(10**6)}"
        out += [" ".join(words), f"{prose(k + 10, 30, 10**6)} {line}", prose(k + 10**4, 90, 10**6)]
    return out


@pytest.mark.parametrize("points,pairs", [(1024, 2), (7, 10**9), (7, 0), (1, 10**9)])
def test_crowded_shards_lose_no_link(spark, monkeypatch, points, pairs):
    for name, value in (("TREE_POINTS", points), ("PAIRS_A_POINT", pairs), ("TASK_SHINGLES", 1000 * points), ("COLUMNS", 16 * points)):
        monkeypatch.setattr(nearcopies, name, value)
    texts = crowd(random.Random(5), 60)
    rows = nearcopies.near_copies(table_of(spark, texts)).collect()
    assert [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)] == brute(texts)


def test_trees_are_bounded_and_meet_every_query(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "TREE_POINTS", 4)
    tables = []
    monkeypatch.setattr(nearcopies, "map_batches", lambda df, f, schema, was=nearcopies.map_batches: tables.append(df) or was(df, f, schema))
    # of 40 points of two shards, every tenth has the same set; those of the first 20 are one component already
    rows = [(shard, rep, 4, [rep, 0, 0, 0], comp, 0, 40, 20) for shard in (1, 2) for rep in range(40) for comp in [0 if rep < 20 else rep]]
    df = spark.createDataFrame(rows, "shard long, rep long, n int, fp array<long>, comp long, top long, points long, outside long")
    sets = spark.createDataFrame([(r, [4 * (r % 10) + k for k in range(4)]) for r in range(40)], "doc_id long, s array<long>")
    label = {i: i for i in range(40)} | {i: 0 for i in range(20)}
    found = [tuple(r) for r in nearcopies.tree_links(df, sets).collect()]
    for _ in range(40):
        for u, v in found:
            label[u] = label[v] = min(label[u], label[v])
    assert all(label[r] == label[r % 10] for r in range(20, 40))
    assert len(found) <= 2 * 20 * 11
    sizes = tables[0].groupBy("shard", "i", "j", "query").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 12


@pytest.mark.parametrize("columns", [3, 4096])
def test_shared_counts(monkeypatch, columns):
    monkeypatch.setattr(nearcopies, "COLUMNS", columns)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, k)) for k in r.integers(1, 40, 12)]
    a, b = np.nonzero(~np.eye(12, dtype=bool))
    wanted = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(a, b)]
    assert nearcopies.shared_counts(sets, a, b).tolist() == wanted
    assert nearcopies.shared_counts(sets, a[:20], b[:20]).tolist() == wanted[:20]


@pytest.mark.parametrize("shingles", [9, 45, 450])
def test_candidates_hold_nearly_all_pairs_at_the_threshold(shingles):
    """Sets that share exactly 0.8 of their union: how many share a band, and lie within the radius."""
    r, found, n = np.random.default_rng(1), 0, 400
    for _ in range(n):
        every = r.integers(0, 2**64, shingles + shingles // 9, dtype=np.uint64)
        a, b = np.sort(every[:shingles]), np.sort(every[shingles // 9 :])
        near = np.bitwise_count(fingerprint(a, nearcopies.LANES) ^ fingerprint(b, nearcopies.LANES)).sum() <= nearcopies.RADIUS
        found += bool(near and (shinglesets.band_keys(a) == shinglesets.band_keys(b)).any())
    assert found >= 0.99 * n


def test_bands_do_not_depend_on_how_a_set_is_cut():
    r = np.random.default_rng(2)
    hashes = r.integers(0, 2**64, 10_000, dtype=np.uint64)
    assert np.array_equal(shinglesets.band_keys(hashes), shinglesets.band_keys(r.permutation(hashes)))


def test_one_document_of_each_group_stays(spark):
    words = prose(7, 300, 5000).split()
    near = [" ".join(words[:k] + [f"changed{k}"] + words[k + 1 :]) for k in (10, 100, 200)]
    texts = [" ".join(words), *near, prose(8, 300, 5000), None, "", " ", prose(8, 300, 5000)]
    kept = by_id(nearcopies.drop_near_duplicates(table_of(spark, texts)).collect())
    assert sorted(kept) == [0, 4, 5, 6, 7]
    assert kept[0]["fp"] == "x"


def test_odd_tables(spark):
    assert nearcopies.drop_near_duplicates(table_of(spark, [])).count() == 0
    text = prose(3, 80)
    rows = nearcopies.drop_near_duplicates(table_of(spark, [text, text, text, text], [None, 3, 3, 4])).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [(False, 3), (False, 3), (True, None)]
