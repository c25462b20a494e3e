"""Corpus pipeline: quality, language, near-duplicates, benchmark passages, then token ids.

Each stage takes the documents that the one before kept and, but for the last, returns their columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import decontaminate, language, quality, segmentations, simhash
from statuta.llm.queries import PASS, PIECES, held_out
from statuta.runtime import shared_dir, table
from statuta.sources import stores

#: SQL cannot express the classifiers' fits, so the stages are tested against plain versions of themselves.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; it learns from the labelled ones that aren't held out."""
    model = quality.fit_quality(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return quality.rate(_packed(docs), model, ["row"]).where(F.col("score") >= PASS).select("row.*")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: null texts and texts without letters go."""
    model = language.fit_language(docs.where(~held_out()))
    return language.identify(_packed(docs), model, ["row"]).where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id (all rows of that id, if it repeats).

    Rows without an id name no group and stay.
    """
    found = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null")
    # the ids of a partition are hashed and its documents stream by, so texts are not sorted
    return known.join(found.hint("shuffle_hash"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that are mostly such passages go."""
    cut = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cut


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text as ids, without replacement."""
    return segmentations.sample_segmentations(docs, public_tokenizers.path(PIECES), k=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_copies),
    ("decontaminate", cut_benchmark),
    ("encode", encode),
]


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column beside their text, so that no name clashes with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again, and the one before it then goes.

    Null and empty texts, texts without letters, repeated rows, extra columns and empty tables fare as the stages' docstrings tell; a table from which nothing is kept gives no rows. The
    last stage's folder stays, since the result is read from it; its caller takes it away.
    """
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            stores.delete(spark, f"{folder}/{before}")
        before = name
    return docs
