import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from subgrade.llm import wordpieces
from tests.conftest import DATA
from tests.llm.fixtures import ODD, table_of

SPACE = " \t\n\x0b\x0c\r"


def vocabulary():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {sp.id_to_piece(i) for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}


def greedy(word: str, vocab: set[str]) -> int:
    rest, n = wordpieces.WORD_START + word, 0
    while rest:
        size = next((k for k in range(min(len(rest), 64), 0, -1) if rest[:k] in vocab), 0)
        if not size:
            return -1
        rest, n = rest[size:], n + 1
    return n


def words_of(text):
    return "".join(" " if c in SPACE else c for c in text or "").split(" ")


def brute(text, vocab):
    found = [greedy(w, vocab) for w in words_of(text) if w]
    return len(found), sum(abs(n) for n in found), sum(n < 0 for n in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abcd", max_size=20))
def test_automaton_is_greedy_longest_match(pieces, word):
    vocab = {wordpieces.WORD_START, *pieces, *(wordpieces.WORD_START + p for p in pieces[:2])}
    machine = wordpieces.Automaton(sorted(vocab))
    assert machine.count_word(word) == greedy(word, vocab)
    words, tokens, unknown = wordpieces.count_texts([word], machine)
    assert (words[0], tokens[0], unknown[0]) == brute(word, vocab)


def test_query_and_odd_texts_against_brute_force(spark):
    vocab = vocabulary()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = wordpieces.op2_token_counts(spark, str(DATA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_tokens, r.n_unknown) == brute(texts[r.doc_id], vocab)
    odd = wordpieces.token_counts(table_of(spark, ODD)).collect()
    assert len(odd) == len(ODD)
    for r in odd:
        assert (r.n_words, r.n_tokens, r.n_unknown) == brute(ODD[r.doc_id], vocab)


def test_null_ids_and_an_empty_table(spark):
    assert wordpieces.token_counts(table_of(spark, ["a b", "a b"], [None, None])).count() == 2
    assert wordpieces.token_counts(table_of(spark, [])).count() == 0
