"""Filters by scope and by half-open validity intervals, and version resolution."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_on(day: Column | date, start: str = "effective_from", end: str = "effective_to") -> Column:
    """``start <= day < end``; an unknown start is never valid, an unknown end is open."""
    day = day if isinstance(day, Column) else F.lit(day)
    return F.coalesce(F.col(start) <= day, F.lit(False)) & (F.col(end).isNull() | (F.col(end) > day))


def overlaps(query_from: date, query_to: date, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Whether ``[start, end)`` meets the closed query interval."""
    return F.coalesce(F.col(start) <= F.lit(query_to), F.lit(False)) & (F.col(end).isNull() | (F.col(end) > F.lit(query_from)))


def scope_filter(units: DataFrame, document_ids: list[str] = (), labels: list[str] = (), statuses: list[str] = (), day: date | None = None) -> DataFrame:
    """Units in scope; an empty list doesn't filter, and a unit without dates of its own has its document's."""
    out = units
    for column, values in (("document_id", document_ids), ("label", labels), ("legal_status", statuses)):
        if values:
            out = out.where(F.col(column).isin(list(values)))
    if day is not None:
        docs = units.where("parent_id is null").select(F.col("id").alias("document_id"), F.col("effective_from").alias("doc_from"), F.col("effective_to").alias("doc_to"))
        own = out.join(docs, "document_id", "left").withColumns({"_from": F.coalesce("effective_from", "doc_from"), "_to": F.coalesce("effective_to", "doc_to")})
        out = own.where(valid_on(day, "_from", "_to")).select(units.columns)
    return out


def latest_version(units: DataFrame, family: str = "family", start: str = "effective_from", rank: str = "id") -> DataFrame:
    """One unit of each family: the latest start, ties to the lowest rank; units without a family stay."""
    newest = Window.partitionBy(family).orderBy(F.coalesce(start, F.lit("0001-01-01").cast("date")).desc(), rank)
    member = F.col(family).isNotNull()
    return units.where(~member).unionByName(units.where(member).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n"))


def quarantine(rows: DataFrame, required: list[str], labels: list[str]) -> DataFrame:
    """``rows`` with ``reason``: the first broken rule, null for good rows."""
    reason = F.lit(None).cast("string")
    for column in reversed(required):
        reason = F.when(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", F.lit(f"missing_{column}")).otherwise(reason)
    return rows.withColumn("reason", F.when(~F.coalesce(F.col("label").isin(labels), F.lit(False)), F.lit("unknown_label")).otherwise(reason))
