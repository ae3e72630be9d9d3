"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat,
    language_id,
    lm_score,
    minhash,
    mixing,
    phrases,
    pieces,
    quality_classifier,
    quality_rules,
    simhash,
    topk,
    url_filter,
    whitening,
)

BLOCK = ["net/", "example.com/de/"]
ALLOW = ["example.net/en/", "org/fr/"]


def model_file() -> str:
    """The vocabulary file on the driver, as ``MILLRACE_PIECES`` names it."""
    return os.environ.get("MILLRACE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judged(_table(spark, sf_dir, "pages"), BLOCK, ALLOW, carry=["page_id"])
    return found.select("row.page_id", "host", "path", "rule", "verdict")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    documents = _table(spark, sf_dir, "documents")
    found = lm_score.scored(documents, ~held_out, carry=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 7 == 2, F.lit(False))
    return found.select(
        "row.doc_id", held_out.alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.col("total").alias("train_tokens"), "base_score", "score",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", "counts.n_words", "counts.word_chars", "counts.n_symbols", "counts.n_dup_lines",
        "counts.n_repeat_words", "base_failed", "kept", "distance",
    )


def quality_of_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, carry: list[str]) -> DataFrame:
    """A document's source stands for the host and its language for the path below it."""
    labels = _table(spark, sf_dir, "labels")
    return quality_classifier.classified(docs, labels, F.col("source"), F.col("lang"), carry=carry)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_of_documents(spark, _table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])
    return found.select("row.doc_id", "host", "path", "evidence", "host_rate", "path_rate", "posterior", "kept")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they stand for its text again (a mark character for a space)."""
    ids = pieces.encoded(_table(spark, sf_dir, "documents"), model_file(), carry=["doc_id", "text"])
    ids = ids.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "ids")
    back = pieces.decoded(ids, model_file(), carry=["doc_id", "text", "ids"])
    same = F.col("text") == F.translate(F.coalesce("row.text", F.lit("")), pieces.MARK, " ")
    return back.select("row.doc_id", F.size("row.ids").cast("long").alias("n_pieces"), "row.ids", same.alias("round_trip"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"), mixing.word_count("text"))
    return found.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identified(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))
    return found.select("row.page_id", "host", "declared", "suffix", "text_lang", "lang", "posterior")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotated(_table(spark, sf_dir, "conversations"))
    return found.withColumnRenamed("conversation", "conv_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_copies(_table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", "n_shingles", F.col("component").alias("component_id"),
        F.col("row.doc_id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_lm_score, op3_quality_rules, op4_quality_classifier, op5_sentencepiece, op6_mixing,
        op7_language_id, op8_chat_formatting, op9_simhash_dedup, op10_topk, op11_collocations,
        op12_minhash_dedup, op13_whitening,
    )
}
