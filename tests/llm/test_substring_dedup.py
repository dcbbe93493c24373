import hashlib

import numpy as np

from subgrade.llm import substrings
from tests.conftest import DATA
from tests.llm.fixtures import ODD, PASSAGE, by_id, table_of


def words(text):
    return (text or "").encode().split()


def brute(docs, width):
    """doc_id: (n_words, kept words), by a table of all windows as tuples."""
    first = {}
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, text in docs:
        w = words(text)
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = True
        out[d] = (len(w), [x for x, g in zip(w, gone) if not g])
    return out


def agree(rows, wanted):
    assert len(rows) == len(wanted)
    for r in rows:
        n, kept = wanted[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(kept)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    agree(substrings.op3_substring_dedup(spark, str(DATA)).collect(), brute(docs, 50))


def test_odd_texts_at_several_widths(spark):
    docs = list(enumerate(ODD))
    for width in (3, 50):
        agree(substrings.removed_words(table_of(spark, ODD), width).collect(), brute(docs, width))


def test_the_passage_goes_from_the_later_document_and_text_keeps_its_gaps(spark):
    texts = ["one  two " + PASSAGE + "\nthree", "zero\n" + PASSAGE + "  four\tfive", "zero six"]
    out = by_id(substrings.without_repeats(table_of(spark, texts)).collect())
    assert out[0]["text"] == texts[0] and out[2]["text"] == texts[2]
    assert out[1]["text"] == "zero\nfour\tfive"
    assert out[1]["kept"] == "x"


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    doubled = table_of(spark, [PASSAGE, PASSAGE], [5, 5])
    assert [r.n_removed for r in substrings.removed_words(doubled).collect()] == [0, 0]
    alone = substrings.removed_words(table_of(spark, [PASSAGE, PASSAGE, PASSAGE], [None, 2, 1])).collect()
    wanted = hashlib.sha256(PASSAGE.encode()).hexdigest()
    assert {(r.doc_id, r.n_removed, r.kept_sha256 == wanted) for r in alone} == {(None, 0, True), (1, 0, True), (2, 60, False)}
    named = substrings.removed_words(table_of(spark, [PASSAGE, PASSAGE]).selectExpr("concat('d', doc_id) AS doc_id", "text")).collect()
    assert {(r.doc_id, r.n_removed) for r in named} == {("d0", 0), ("d1", 60)}
    assert substrings.removed_words(table_of(spark, [])).count() == 0
    assert substrings.without_repeats(table_of(spark, [])).count() == 0


def test_windows_merge_to_maximal_intervals():
    first, end = substrings.merge_windows(np.array([9, 1, 2, 4, 20]), 3)
    assert list(zip(first.tolist(), end.tolist())) == [(1, 7), (9, 12), (20, 23)]


def test_rolling_hashes_tell_runs_apart():
    codes = substrings.word_codes([b"a", b"b", b"a", b"b", b"a"])
    h = substrings.rolling_hashes(codes, 2, substrings._BASES[0])
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
