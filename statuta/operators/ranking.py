"""Ranked lists: fusion of channels, top-k, budgets, evidence selection and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel_ranks(hits: DataFrame, keys: list[str] = ("query_id", "channel"), score: str = "score", unit: str = "id") -> DataFrame:
    """``hits`` with ``rank`` from 1 within each channel: best score first, ties to the smaller id."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), unit)))


def reciprocal_rank_fusion(hits: DataFrame, channels: list[str], k: int = 60, keys: list[str] = ("query_id",), unit: str = "id") -> DataFrame:
    """``query_id, id, rrf, sources``: the sum over channels of 1/(k + rank), added in the order of their names."""
    ranked = channel_ranks(hits, [*keys, "channel"], unit=unit)
    names = sorted(channels)
    part = [F.coalesce(F.sum(F.when(F.col("channel") == c, 1.0 / (k + F.col("rank")))), F.lit(0.0)) for c in names]
    total = part[0]
    for p in part[1:]:
        total = total + p
    return ranked.groupBy(*keys, unit).agg(total.alias("rrf"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))


def top_k(rows: DataFrame, k: int, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def running_budget(rows: DataFrame, keys: list[str], order: list[Column | str], cost: Column, budget: int) -> DataFrame:
    """Rows from the first on until the running cost passes the budget; the first always stays."""
    upto = Window.partitionBy(*keys).orderBy(*order)
    run = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"running": F.sum(cost).over(run), "_n": F.row_number().over(upto)}).where((F.col("_n") == 1) | (F.col("running") <= budget)).drop("_n")


def greedy_pack(rows: DataFrame, keys: list[str], rank: str, unit: str, cost: str, budget: int) -> DataFrame:
    """Per key the units taken in rank order, skipping those that no longer fit: ``taken array, used``.

    The rows of one key are a ranked list of bounded length, folded in an expression.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("r"), F.col(cost).cast("long").alias("c"), F.col(unit).cast("string").alias("u"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"))
    fold = F.aggregate(listed, start, lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.array_append(s["taken"], x["u"]).alias("taken"))).otherwise(s))
    return rows.groupBy(*keys).agg(fold.alias("_f")).select(*keys, F.col("_f.taken").alias("taken"), F.col("_f.used").alias("used"))


def dedup_evidence(rows: DataFrame, keys: list[str], text: Column, rank: str = "rank", protected: Column | None = None) -> DataFrame:
    """``rows`` with ``retained_unit_id``: of rows with the same normalised text the best ranked one; protected rows keep themselves."""
    same = Window.partitionBy(*keys, F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))).orderBy(rank, "id")
    first = F.first("id").over(same)
    return rows.withColumn("retained_unit_id", F.when(protected, F.col("id")).otherwise(first) if protected is not None else first)


def metrics(ranked: DataFrame, gold: DataFrame, k: int, keys: list[str] = ("query_id",), unit: str = "id") -> DataFrame:
    """Per query: recall, mrr, ndcg (binary) and graded_ndcg at ``k``.

    ``ranked(query_id, id, rank)`` and ``gold(query_id, id, relevance > 0)``; gain is ``2^relevance - 1``.
    """
    def gain(rel: Column) -> Column:
        return F.pow(F.lit(2.0), rel) - 1.0

    hits = gold.join(ranked.where(F.col("rank") <= k), [*keys, unit], "left")
    discount = F.log2(F.col("rank") + 1.0)
    ideal = gold.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("relevance"), unit))).where(F.col("_i") <= k)
    best = ideal.groupBy(*keys).agg(F.sum(1.0 / F.log2(F.col("_i") + 1.0)).alias("_b"), F.sum(gain(F.col("relevance")) / F.log2(F.col("_i") + 1.0)).alias("_g"))
    out = hits.groupBy(*keys).agg(
        (F.count("rank") / F.count(F.lit(1))).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(1.0 / discount), F.lit(0.0)).alias("_d"), F.coalesce(F.sum(gain(F.col("relevance")) / discount), F.lit(0.0)).alias("_e"),
    )
    return out.join(best, list(keys)).select(*keys, "recall", "mrr", (F.col("_d") / F.col("_b")).alias("ndcg"), (F.col("_e") / F.col("_g")).alias("graded_ndcg"))


def grouped_ndcg(ranked: DataFrame, ideal: DataFrame, k: int, keys: list[str] = ("query_id",), group: str = "grp") -> DataFrame:
    """Per query: ``grouped_ndcg`` at ``k``, from ``ranked(query_id, rank, grp, relevance)`` and the groups' best grades ``ideal(query_id, grp, relevance)``.

    A group has credit once: at the place that its first unit gives it among the groups, with the best grade of its units that were returned.  Queries without
    an ideal gain have 0; queries that returned nothing have no row.
    """
    def gain(rel: Column) -> Column:
        return F.pow(F.lit(2.0), rel) - 1.0

    got = ranked.groupBy(*keys, group).agg(F.min("rank").alias("_first"), F.coalesce(F.max("relevance"), F.lit(0)).alias("_rel"))
    placed = got.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", group)))
    own = placed.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_n") <= k, gain(F.col("_rel")) / F.log2(F.col("_n") + 1.0))), F.lit(0.0)).alias("_d"))
    best = ideal.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("relevance"), group))).where(F.col("_n") <= k).groupBy(*keys).agg(F.sum(gain(F.col("relevance")) / F.log2(F.col("_n") + 1.0)).alias("_i"))
    return own.join(best, list(keys), "left").select(*keys, F.when(F.col("_i") > 0, F.col("_d") / F.col("_i")).otherwise(0.0).alias("grouped_ndcg"))
