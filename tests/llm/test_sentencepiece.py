import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from subgrade.llm import pieces
from tests.conftest import DATA
from tests.llm.fixtures import ODD, table_of

MODEL = "piece_bpe_32k.model"


def test_without_dropout_the_ids_are_the_models_own(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in pieces.encode_documents(docs, dropout=0.0).collect():
        assert list(r.ids) == sp.encode(r.text), r.doc_id


def test_one_agenda_for_long_and_short_words(monkeypatch):
    m = pieces.model(MODEL)
    texts = [t or "" for t in ODD]
    together = pieces.encode_texts(texts, list(range(len(texts))), m, 0.2, 7)
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    alone = pieces.encode_texts(texts, list(range(len(texts))), m, 0.2, 7)
    for a, b in zip(together, alone):
        assert a.tolist() == b.tolist()


def test_every_text_comes_back_at_any_dropout(spark):
    docs = table_of(spark, ODD)
    for dropout in (0.0, 0.1, 0.5, 1.0):
        rows = pieces.decode_documents(pieces.encode_documents(docs, dropout, 3)).collect()
        assert len(rows) == len(ODD)
        for r in rows:
            assert r.decoded == r.text
            assert (r.ids is None) == (r.text is None)


def test_segmentations_vary_by_seed_and_not_by_partition(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    ids = lambda d, seed: {r.doc_id: list(r.ids) for r in pieces.encode_documents(d, 0.1, seed).collect()}
    one = ids(docs, 1)
    assert one == ids(docs.repartition(7, F.rand(5)), 1)
    assert one != ids(docs, 2)
    merged = sum(map(len, ids(docs.withColumn("x", F.lit(1)), 1).values()))
    assert merged > sum(len(r.ids) for r in pieces.encode_documents(docs, 0.0).collect())


def test_an_empty_table(spark):
    assert pieces.decode_documents(pieces.encode_documents(table_of(spark, []))).count() == 0


def test_query(spark):
    rows = pieces.op1_sentencepiece(spark, str(DATA)).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.lossless and (r.n_tokens == len(r.ids)) for r in rows)
