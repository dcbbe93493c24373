import bisect
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from subgrade.llm import packing
from tests.conftest import DATA
from tests.llm.fixtures import ODD, table_of


def plain_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


def check(rows, texts, capacity=1024):
    ids_of = plain_ids("")
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array(ids_of(text), dtype="<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or n == 0
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = packing.op8_best_fit_packing(spark, str(DATA)).collect()
    used = check(rows, texts)
    assert used <= 1.01 * sum(r.length for r in rows) / 1024 + 1
    assert used <= best_fit_decreasing([r.length for r in rows], 1024)


def test_odd_texts_and_an_empty_table(spark):
    check(packing.pack_documents(table_of(spark, ODD)).collect(), dict(enumerate(ODD)))
    assert packing.pack_documents(table_of(spark, [])).count() == 0


def test_repeated_rows_are_each_packed(spark):
    rows = packing.pack_documents(table_of(spark, ["a b c"] * 3, [1, 1, None])).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_many_rows_of_one_length(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "CAST(IF(id % 10 = 0, 700, 300) AS BIGINT) AS length")
    rows = packing.pack(docs, rows_per_part=100).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 3000
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    assert len(filled) == 300 + 800


def test_smallest_gives_way_to_two_that_fit_tighter():
    left = np.zeros(101, dtype=np.int64)
    for length, n in {60: 1, 30: 1, 25: 1, 14: 1}.items():
        left[length] = n
    # greedy: 60 + 30; its smallest, 30, gives way to 25 + 14, which fill the gap of 40 to 39
    assert packing.two_fit_pattern(left, 100) == {60: 1, 25: 1, 14: 1}


def plain_best_two_fit(lengths, capacity):
    """Best-two-fit document by document: sequences as sorted lengths."""
    left, out = sorted(lengths), []
    while left:
        chosen, gap = [], capacity
        while True:
            fits = [x for x in left if x <= gap]
            if not fits:
                break
            chosen.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            sums = [(a + b, a, b) for i, a in enumerate(left) for b in left[:i] if smallest < a + b <= gap + smallest]
            if sums:
                # of equal sums, that with the smallest larger document
                _, a, b = max(sums, key=lambda t: (t[0], -t[1]))
                left.remove(a)
                left.remove(b)
                left = sorted([*left, smallest])
                chosen[-1:] = [a, b]
        out.append(tuple(sorted(chosen)))
    return Counter(out)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=10))
def test_plans_are_those_of_packing_one_document_after_the_other(counts):
    sequences = {}
    for length, lo, hi, per, first, _ in packing.packing_plan(counts, 40):
        for rank in range(lo, hi):
            sequences.setdefault(first + (rank - lo) // per, []).append(length)
    assert Counter(tuple(sorted(s)) for s in sequences.values()) == plain_best_two_fit([n for n, k in counts.items() for _ in range(k)], 40)


def first_fit_decreasing(lengths, capacity):
    """How many sequences first-fit-decreasing takes."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, gap in enumerate(gaps) if gap >= x), len(gaps))
        gaps[at:at + 1] = [(gaps[at] if at < len(gaps) else capacity) - x]
    return len(gaps)


def best_fit_decreasing(lengths, capacity):
    """How many sequences best-fit-decreasing takes."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - x)
    return len(gaps)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_the_fewest_of_the_plans_is_taken(counts):
    plan = packing.fewest_plan(counts, 40)
    assert packing.sequences_of(plan) <= first_fit_decreasing([n for n, k in counts.items() for _ in range(k)], 40)
    used = Counter()
    for length, lo, hi, *_ in plan:
        assert lo == used[length]
        used[length] = hi
    assert used == Counter(counts)


def test_small_gaps_are_left_where_swaps_cost_sequences():
    rng = np.random.default_rng(7)
    counts = Counter(rng.integers(20, 700, 1500).tolist())
    plans = [packing.packing_plan(counts, 1024), packing.fewest_plan(counts, 1024)]
    first, fewest = map(packing.sequences_of, plans)
    assert fewest <= first


def test_the_added_token_is_one_id():
    text = "a <|endoftext|> special"
    assert packing.token_ids(text).tolist() == plain_ids("")(text)[:-1] == [64, 220, 50256, 2041]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_use_each_document_once_and_fit(counts):
    plan = packing.packing_plan(counts, 40)
    seen, filled = Counter(), Counter()
    for length, lo, hi, per, first, at in plan:
        for rank in range(lo, hi):
            seen[length, rank] += 1
            sequence = first + (rank - lo) // per
            filled[sequence] = max(filled[sequence], at + ((rank - lo) % per + 1) * length)
    assert seen == Counter({(n, r): 1 for n, k in counts.items() for r in range(k)})
    assert all(v <= 40 for v in filled.values())
