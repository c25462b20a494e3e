"""Joins with a verdict: lookups, containment, as-of, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("head_id")), "head_id", "left_semi").join(ids.select(F.col("id").alias("tail_id")), "tail_id", "left_semi")


def dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end that is not among ``ids(id)``, each row once."""
    known = ids.select("id").distinct()
    heads, tails = known.select(F.col("id").alias("head_id"), F.lit(True).alias("_h")), known.select(F.col("id").alias("tail_id"), F.lit(True).alias("_t"))
    return edges.join(heads, "head_id", "left").join(tails, "tail_id", "left").where("_h is null or _t is null").select(edges.columns)


def cross_document(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``document, type, other, affected``: relations between different documents, with the units they leave from."""
    heads = owners.select(F.col("id").alias("head_id"), F.col("document_id").alias("document"))
    tails = owners.select(F.col("id").alias("tail_id"), F.col("document_id").alias("other"))
    pairs = edges.join(heads, "head_id").join(tails, "tail_id").where("document <> other")
    return pairs.groupBy("document", "type", "other").agg(F.array_join(F.array_sort(F.collect_set("head_id")), ",").alias("affected"))


def registry_lookup(mentions: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """``mentions`` with ``status`` RESOLVED, UNRESOLVED or AMBIGUOUS and the one ``target``; null coordinates equal null ones."""
    known = registry.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "UNRESOLVED").when(n == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return mentions.join(known, on, "left").select(*mentions.columns, status.alias("status"), F.when(n == 1, F.col("_id")).alias("target"))


def smallest_enclosing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, point_id: str, span_id: str, bin_width: int = 86_400) -> DataFrame:
    """``(point_id, unit)``: the shortest span of the same key that holds each point, ties to the smaller id.

    Spans are dealt to the bins they touch, so the join is an equality on key and bin.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor((F.col(end) - 1) / bin_width))))
    held = points.withColumn("_bin", F.floor(F.col(at) / bin_width)).join(binned, [key, "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return held.groupBy(point_id).agg(F.min_by(span_id, F.struct(F.col(end) - F.col(start), span_id)).alias("unit"))


def smallest_holding(inner: DataFrame, spans: DataFrame, key: str, inner_start: str, inner_end: str, start: str, end: str, inner_id: str, value: Column, bin_width: int = 4096) -> DataFrame:
    """``(inner_id, unit)``: the ``value`` of the shortest span of the same key that holds each inner span whole, ties to the smaller value.

    Spans are dealt to the bins they touch, so the join is an equality on key and bin.
    """
    binned = spans.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor((F.col(end) - 1) / bin_width))))
    held = inner.withColumn("_bin", F.floor(F.col(inner_start) / bin_width)).join(binned, [key, "_bin"]).where((F.col(start) <= F.col(inner_start)) & (F.col(inner_end) <= F.col(end)))
    return held.groupBy(inner_id).agg(F.min_by(value, F.struct(F.col(end) - F.col(start), value)).alias("unit"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str, name: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` at or before it, by one sort of both sides together."""
    rest = [c for c in left.columns if c not in (key, at)]
    both = left.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(key, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    upto = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(upto)).where("_side = 1").select(key, f"_row.{at}", *[f"_row.{c}" for c in rest], name)


def superseded(rows: DataFrame, rules: DataFrame, key: str, text: str, rule_text: str) -> DataFrame:
    """Pairs of the same key where either text holds the other."""
    return rows.join(rules, key).where(F.contains(rule_text, text) | F.contains(text, rule_text))


def snapshot_diff(was: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, difference)``: missing, extra or changed rows between two snapshots."""
    a, b = was.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), now.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    kind = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("difference")).where("difference is not null")


def stale(wanted: DataFrame, stored: DataFrame, key: str, state: str) -> DataFrame:
    """Rows whose stored state is absent or differs, with ``never_embedded``."""
    s = stored.select(key, F.col(state).alias("_s"))
    return wanted.join(s, key, "left").where(~F.col(state).eqNullSafe(F.col("_s"))).withColumn("never_embedded", F.col("_s").isNull())
