"""Checks of records that gather every reason, and counts of their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """The names of all checks that hold, in order, comma-joined; a null check doesn't hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])), ",")


def exactly_one(candidates: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """``candidates`` with ``outcome``: NONE, MATCHED or SEVERAL accepted records of the same key."""
    n = accepted.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = F.coalesce("_n", F.lit(0))
    return candidates.join(n, key, "left").select(*candidates.columns, F.when(found == 0, "NONE").when(found == 1, "MATCHED").otherwise("SEVERAL").alias("outcome"))


def named_versions(names: DataFrame, titles: DataFrame, name: str, title: str) -> DataFrame:
    """``name, title, exact``: titles that are the name alone or with a version in brackets, by equality on what stands before it."""
    cut = titles.withColumn("_base", F.regexp_replace(title, r"\s*\([^()]*\)$", ""))
    return names.join(cut, names[name] == F.col("_base")).select(name, title, (F.col(title) == F.col(name)).alias("exact"))


def ledger_remainder(jobs: DataFrame, ledger: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Jobs whose last ledger entry isn't SUCCESS, or that have none."""
    last = ledger.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("_last")).where("_last = 'SUCCESS'")
    return jobs.join(last, key, "left_anti")


def expired_focuses(focuses: DataFrame, conversation: str, turn: str, ttl: int) -> DataFrame:
    """``focuses`` with ``expired``: last used more than ``ttl`` turns before the conversation's last."""
    now = F.max(turn).over(Window.partitionBy(conversation))
    return focuses.withColumn("expired", now - F.col(turn) > ttl)


def reference_records(mentions: DataFrame, source: str, target: str) -> DataFrame:
    """``source, target, method`` of resolved references, each once, without self references: RANGE where a source names several targets."""
    each = mentions.where(F.col(target).isNotNull() & (F.col(source) != F.col(target))).select(source, target).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(source))
    return each.withColumn("method", F.when(n > 1, "RANGE").otherwise("DIRECT"))
