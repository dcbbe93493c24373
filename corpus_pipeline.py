"""The text pipeline: classify, apply rules, drop near-duplicates, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again, so a lost executor costs at most one stage's tasks. All stages but the last return the columns of documents, and
pass other columns through, whatever their names. An empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from subgrade.llm.common import documents, table, written
from subgrade.llm.nearcopies import drop_near_duplicates
from subgrade.llm.packing import pack_documents
from subgrade.llm.rules import quality_rules
from subgrade.llm.substrings import without_repeats
from subgrade.llm.weaklabels import quality_classifier


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs that a verdict keeps. Rows with one doc_id are one document, which goes if one of them is rejected."""
    rejected = verdicts.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier keeps. Null and empty texts get the verdict of a text without votes and terms; a text of any
    length is judged whole; repeated rows go or stay together; a score at the threshold is kept; a row with a null doc_id
    goes if any such row is rejected."""
    return _keep(docs, quality_classifier(docs, table(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the quality rules keep. Null, empty and very short texts fail the base limits and go; a text of any length
    is judged whole; repeated rows go or stay together; a score at the threshold is kept."""
    return _keep(docs, quality_rules(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that chains of similarity 0.8 or more connect. Null and
    empty texts, and rows with a null doc_id, are no copies and stay; rows that repeat a doc_id stay or go together."""
    return drop_near_duplicates(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the words of 50-word windows that a document with a smaller doc_id has too. Null, empty and short texts,
    and rows with a null doc_id, stay as they are; repeated rows are cut alike; all rows stay."""
    return without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs in sequences of at most 1024 tokens. Null and empty texts are a piece of one token; long ones
    are cut; repeated rows, and rows with a null doc_id, are packed each; of equal lengths any may come first."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("SimHash near-dedup", drop_copies),
    ("substring dedup", cut_passages),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the rules and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
