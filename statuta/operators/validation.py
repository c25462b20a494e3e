"""Validation of relations against a table of allowed pairs and required properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation_errors(edges: DataFrame, nodes: DataFrame, allowed: dict[str, list[tuple[str, str]]], required: dict[str, list[str]]) -> DataFrame:
    """``edges`` with ``error``: the first of missing endpoint, self loop, pair not allowed, missing property; null for good ones."""
    heads, tails = nodes.select(F.col("id").alias("head_id"), F.col("label").alias("_h")), nodes.select(F.col("id").alias("tail_id"), F.col("label").alias("_t"))
    pairs = F.array(*[F.lit(f"{kind}:{a}>{b}") for kind, both in allowed.items() for a, b in both])
    missing = F.lit(None).cast("string")
    for kind, columns in required.items():
        for c in reversed(columns):
            missing = F.when((F.col("type") == kind) & F.col(c).isNull(), F.lit(f"missing_{c}")).otherwise(missing)
    error = (
        F.when(F.col("_h").isNull() | F.col("_t").isNull(), "missing_endpoint")
        .when(F.col("head_id") == F.col("tail_id"), "self_loop")
        .when(~F.array_contains(pairs, F.concat("type", F.lit(":"), "_h", F.lit(">"), "_t")), "pair_not_allowed")
        .otherwise(missing)
    )
    return edges.join(heads, "head_id", "left").join(tails, "tail_id", "left").withColumn("error", error).drop("_h", "_t")
