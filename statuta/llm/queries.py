"""The registered queries of the training-data operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import conversation_repair, decontaminate, html_text, language, licenses, nearest, periodic_runs, quality, secrets, segmentations, simhash, token_counts, token_files
from statuta.runtime import table

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
PASS = 0.3


def held_out(column: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), k=2)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs.where(~held_out()), labels.where(~held_out()))
    return quality.rate(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs.where(~held_out()))
    return language.identify(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations")), present_col="present")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_segmentations, op2_nearest, op3_licenses, op4_quality, op5_html_text, op6_decontaminate, op7_token_files, op8_token_counts, op9_language, op10_simhash, op11_secrets, op12_conversation_repair, op13_periodic_runs)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.oracle(), "op12_conversation_repair": conversation_repair.ORACLE}
