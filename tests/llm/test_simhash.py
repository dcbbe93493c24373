import numpy as np
import pytest
import xxhash

from subgrade.llm import bktree, simhash
from tests.conftest import DATA
from tests.llm.fixtures import ODD, table_of


def plain_fingerprint(text, width=3):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    grams = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= radius:
                    label[i], changed = label[j], True
    return label


def agree(rows, texts):
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    wanted = plain_components(fps, 2)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fp[0] % 2**64 == fps[r.doc_id]
        assert r.component_id == wanted[r.doc_id]


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = simhash.op6_simhash_near_dedup(spark, str(DATA)).collect()
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    wanted = plain_components(fps, 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fps[d]:016x}", wanted[d]) for d in texts}


def test_odd_texts(spark):
    agree(simhash.near_duplicates(table_of(spark, ODD)).collect(), dict(enumerate(ODD)))


def test_chains_of_links_over_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 4)
    r = np.random.default_rng(2)
    points = [int(r.integers(0, 2**63))]
    for _ in range(60):
        points.append(points[-1] ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))))
    fps = {i: p for i, p in enumerate(points)}
    df = spark.createDataFrame([(i, [p - 2**64 if p >= 2**63 else p]) for i, p in fps.items()], "rep long, fp array<long>")
    links = simhash.link_shards(simhash.exact_shards(df), 2).collect()
    label = bktree._labels(len(points), np.array([e.u for e in links]), np.array([e.v for e in links]))
    assert {i: int(x) for i, x in enumerate(label)} == plain_components(fps, 2)


@pytest.mark.parametrize("lanes,radius,flips", [(1, 2, 3), (8, 85, 60)])
@pytest.mark.parametrize("meetings", [64, 1 << 20])
def test_trees_link_what_chains_of_distances_link(monkeypatch, lanes, radius, flips, meetings):
    monkeypatch.setattr(bktree, "MEETINGS", meetings)
    r = np.random.default_rng(0)
    for n in (1, 5, 300, 700):
        base = r.integers(0, 2**63, (max(1, n // 20), lanes), dtype=np.uint64)
        points = base[r.integers(0, len(base), n)].copy()
        for _ in range(flips):
            points[np.arange(n), r.integers(0, lanes, n)] ^= np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
        group = np.unique(np.sort(r.integers(0, 3, n)), return_inverse=True)[1]
        near = (np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2) <= radius) & (group[:, None] == group[None])
        assert np.array_equal(bktree._labels(n, *bktree.spanning_links(points, group, radius)), bktree._labels(n, *np.nonzero(near)))


def test_an_empty_table(spark):
    assert simhash.near_duplicates(table_of(spark, [])).count() == 0


def test_null_ids_and_other_keys(spark):
    texts, ids = ["a b c d", "a b c d", "x y z", "x y z", "only here"], [None, 3, None, None, 9]
    rows = simhash.near_duplicates(table_of(spark, texts, ids)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (9, 9)]
    named = simhash.near_duplicates(table_of(spark, ["a b", "a b"]).selectExpr("concat('d', doc_id) AS doc_id", "text")).collect()
    assert sorted((r.doc_id, r.component_id) for r in named) == [("d0", "d0"), ("d1", "d0")]
