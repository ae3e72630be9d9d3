"""Documents to training text in five stages; each reads what the one before has written.

The quality classifier and the quality rules drop documents, SimHash keeps one of each group of near
copies, mixing takes sources to their target weights (a document may come up to three times), and
encoding turns each text into piece ids.

Each stage takes documents as they are read from files, with further columns if there are any, and passes
its columns on. No stage writes a text but in what it returns: rows are told apart by their place in their file.
Null texts, sources, languages and ids, repeated rows, ties and texts of any length are dealt with as the
operators state; an empty table stays one through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, pieces, quality_rules, queries, simhash
from millrace.workspace import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return queries.quality_of_documents(spark, docs, sf_dir, docs.columns).filter("kept").select("row.*")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rules nor their distance reject."""
    return quality_rules.judged(docs, carry=docs.columns).filter("kept").select("row.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return simhash.without_copies(docs, scan=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs, size=mixing.word_count("text"), scan=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, ids`` of every row."""
    found = pieces.encoded(docs, queries.model_file(), carry=["doc_id", "source", "lang"])
    return found.select("row.*", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_copies_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The classifier is fitted, the estimates are iterated and the ids are searched: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
