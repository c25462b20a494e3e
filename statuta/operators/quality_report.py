"""Graph quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by_kind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, name, n``: nodes by label and edges by type."""
    by_label = nodes.groupBy(F.col("label").alias("name")).count().select(F.lit("label").alias("kind"), "name", F.col("count").alias("n"))
    return by_label.unionByName(edges.groupBy(F.col("type").alias("name")).count().select(F.lit("relation").alias("kind"), "name", F.col("count").alias("n")))


def duplicates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: repeated identities counted once each, and their extra occurrences."""
    def count(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
        n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.count_if(F.col("n") > 1).alias(f"duplicate_{what}"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"extra_{what}"))

    return count(nodes, ["id"], "ids").crossJoin(count(edges, ["head_id", "type", "tail_id"], "edges"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``label, n_nodes, n_orphans, most, mean`` of the undirected degree."""
    ends = edges.select(F.col("head_id").alias("id")).unionByName(edges.select(F.col("tail_id").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    d = F.coalesce("d", F.lit(0))
    return nodes.join(ends, "id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("d").isNull()).alias("n_orphans"), F.max(d).alias("most"), F.avg(d).alias("mean"))


def coverage(rows: DataFrame, key: str, column: str) -> DataFrame:
    """How many rows of each key have the column; 1 for no rows."""
    total, covered = F.count(F.lit(1)), F.count(column)
    return rows.groupBy(key).agg(total.alias("total"), covered.alias("covered"), F.when(total == 0, 1.0).otherwise(covered / total).alias("coverage"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: E/(N(N-1)) and 2E/N."""
    n, e = nodes.select(F.count_distinct("id").alias("n")), edges.select(F.count(F.lit(1)).alias("e"))
    return n.crossJoin(e).select((F.col("e") / (F.col("n").cast("double") * (F.col("n") - 1))).alias("density"), (2.0 * F.col("e") / F.col("n")).alias("average_degree"))


def semantic_coverage(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """The share of a label's nodes that stand on an edge other than containment."""
    semantic = edges.where("type <> 'CONTAINS'")
    touched = semantic.select(F.col("head_id").alias("id")).unionByName(semantic.select(F.col("tail_id").alias("id"))).distinct().withColumn("_t", F.lit(1))
    return nodes.where(F.col("label") == label).select("id").distinct().join(touched, "id", "left").agg((F.count("_t") / F.count(F.lit(1))).alias("coverage"))


def histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and their share of all rows; the total is one value beside few groups."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def bundle_completeness(rows: DataFrame, bundle: str, expected: str) -> DataFrame:
    """``bundle, n, status``: complete where all rows expect one positive count and there are so many."""
    n = F.count(F.lit(1))
    status = F.when(F.count_distinct(expected) != 1, "conflict").when(F.max(expected) < 1, "invalid").when(F.max(expected) != n, "incomplete").otherwise("complete")
    return rows.groupBy(bundle).agg(n.alias("n"), status.alias("status"))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median and both reports' 95th percentiles: at index floor(.95 n) and ceil(.95 n), from 1."""
    # equal values are counted first, so that a common key's rows are not sorted one by one
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = counted.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(key))})

    def pick(i: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= i, F.col(value)))

    n = F.col("_n")
    median = (pick(F.floor((n + 1) / 2)) + pick(F.ceil((n + 1) / 2))) / 2
    return at.groupBy(key).agg(median.alias("p50"), pick(F.greatest(F.lit(1), F.floor(n * 0.95))).alias("p95_floor"), pick(F.ceil(n * 0.95)).alias("p95_ceil"))


def set_hash(value: Column) -> Column:
    """Aggregate: sha256 of the sorted distinct values, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(value)), "\n").cast("binary"), 256)


def calibrate(cases: DataFrame, scores: list[float], margins: list[float]) -> DataFrame:
    """The thresholds with the fewest wrong and then the most correct links, over a fixed grid."""
    grid = cases.withColumn("min_score", F.explode(F.array(*map(F.lit, scores)))).where("score >= min_score").withColumn("min_margin", F.explode(F.array(*map(F.lit, margins)))).where("margin >= min_margin")
    counted = grid.groupBy("min_score", "min_margin").agg(F.count_if("good").alias("correct"), F.count_if(~F.col("good")).alias("wrong"))
    spark = cases.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, scores))).alias("min_score")).withColumn("min_margin", F.explode(F.array(*map(F.lit, margins))))
    full = every.join(counted, ["min_score", "min_margin"], "left").na.fill(0, ["correct", "wrong"])
    return full.orderBy("wrong", F.desc("correct"), "min_score", "min_margin").limit(1)
