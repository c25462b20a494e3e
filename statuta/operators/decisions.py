"""Scoring and deciding on extracted relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(schema: Column, ontology: Column, direction: Column, evidence: Column, resolvable: Column) -> Column:
    """0.3 schema + 0.3 ontology + 0.2 evidence + 0.1 resolvable + 0.1 direction, added in that order."""
    one = lambda b: F.when(b, 1.0).otherwise(0.0)
    return 0.3 * one(schema) + 0.3 * one(ontology) + 0.2 * evidence + 0.1 * resolvable + 0.1 * one(direction)


def gate(valid: Column, score: Column, rule: Column, accept: float = 0.8, review: float = 0.55) -> Column:
    """accepted, review or rejected: invalid rows go, rule-derived ones pass without a score, a missing score is 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(~valid, "rejected").when(rule, "accepted").when(s >= accept, "accepted").when(s >= review, "review").otherwise("rejected")


def atomic_bundles(rows: DataFrame, bundle: str, decision: str = "decision") -> DataFrame:
    """All rows of a bundle are rejected if one is; rows without a bundle decide for themselves."""
    any_out = F.max((F.col(decision) == "rejected").cast("int")).over(Window.partitionBy(bundle)) == 1
    return rows.withColumn(decision, F.when(F.col(bundle).isNotNull() & any_out, F.lit("rejected")).otherwise(F.col(decision)))
