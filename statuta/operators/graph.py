"""Graph operators over ``edges(head_id, type, tail_id)``: closure, neighbourhoods, bounded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.runtime import checkpointed


def relation_id(discriminator: Column | None = None) -> Column:
    """The identity of an edge: sha1 of head, type, tail and what tells parallel edges apart."""
    return F.sha1(F.concat_ws("|", "head_id", "type", "tail_id", F.coalesce(discriminator if discriminator is not None else F.lit(""), F.lit(""))).cast("binary"))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``(ancestor_id, unit_id, depth)`` over containment at the least depth, each unit with itself excluded.

    Without a ``depth`` levels are added until one finds nothing.  Where every unit has one parent a pair comes once, and a walk around a cycle ends where it began; where
    some have several, pairs that were found before are taken out of each level, so that cycles end as well.
    """
    step = checkpointed(edges.where("type = 'CONTAINS' and head_id <> tail_id").select("head_id", "tail_id").distinct())
    one_parent = not step.groupBy("tail_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    out = level = step.select(F.col("head_id").alias("ancestor_id"), F.col("tail_id").alias("unit_id"), F.lit(1).alias("depth"))
    d = 1
    while depth is None or d < depth:
        d += 1
        further = level.join(step, F.col("unit_id") == F.col("head_id")).select("ancestor_id", F.col("tail_id").alias("unit_id")).where("ancestor_id <> unit_id")
        if not one_parent:
            further = further.distinct().join(out, ["ancestor_id", "unit_id"], "left_anti")
        level = checkpointed(further.withColumn("depth", F.lit(d)))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge read from either end: ``source_id, type, target_id, forward``."""
    return edges.select(F.col("head_id").alias("source_id"), "type", F.col("tail_id").alias("target_id"), F.lit(True).alias("forward")).unionByName(
        edges.select(F.col("tail_id").alias("source_id"), "type", F.col("head_id").alias("target_id"), F.lit(False).alias("forward"))
    )


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Distinct ``(seed_id, id, distance)`` reached within ``hops`` undirected steps, at the least distance."""
    sides = both_ways(edges).select("source_id", "target_id").distinct()
    level = seeds.select(F.col("id").alias("seed_id"), "id", F.lit(0).alias("distance"))
    out = level
    for d in range(1, hops + 1):
        level = level.join(sides, F.col("id") == F.col("source_id")).select("seed_id", F.col("target_id").alias("id"), F.lit(d).alias("distance")).distinct()
        out = out.unionByName(level)
    return out.groupBy("seed_id", "id").agg(F.min("distance").alias("distance"))


def trails(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] = (), direction: str = "both") -> DataFrame:
    """Paths from ``seeds(id)`` of 1 to ``depth`` steps that use no edge twice: ``nodes, edge_ids, types`` arrays.

    ``edges`` needs a ``relation_id``.  Nodes may repeat; ``direction`` is out, in or both.
    """
    used = edges.where(F.col("type").isin(list(types))) if types else edges
    out_ = used.select(F.col("head_id").alias("a"), F.col("tail_id").alias("b"), "type", "relation_id")
    in_ = used.select(F.col("tail_id").alias("a"), F.col("head_id").alias("b"), "type", "relation_id")
    step = {"out": out_, "in": in_}.get(direction) if direction != "both" else out_.unionByName(in_.where("a <> b"))
    level = seeds.select(F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edge_ids"), F.array().cast("array<string>").alias("types"))
    found = None
    for _ in range(depth):
        level = level.join(step, F.col("at") == F.col("a")).where(~F.array_contains("edge_ids", F.col("relation_id"))).select(
            F.col("b").alias("at"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("edge_ids", F.col("relation_id")).alias("edge_ids"), F.array_append("types", F.col("type")).alias("types")
        )
        found = level if found is None else found.unionByName(level)
    return found.drop("at")


def exact_paths(edges: DataFrame, nodes: DataFrame, steps: list[tuple[str, str, str]], anchors: DataFrame) -> DataFrame:
    """Node-distinct paths that follow the steps ``(type, direction, next label)``: columns ``n0, n1, ...``."""
    labels = nodes.select(F.col("id").alias("lid"), "label")
    out = anchors.select(F.col("id").alias("n0"))
    for i, (kind, direction, label) in enumerate(steps):
        near, far = ("head_id", "tail_id") if direction == "out" else ("tail_id", "head_id")
        step = edges.where(F.col("type") == kind).select(F.col(near).alias("near"), F.col(far).alias("far"))
        allowed = labels.where(F.col("label") == label).select("lid")
        step = step.join(allowed, step.far == allowed.lid, "left_semi")
        out = out.join(step, F.col(f"n{i}") == F.col("near")).select(*[f"n{j}" for j in range(i + 1)], F.col("far").alias(f"n{i + 1}"))
        for j in range(i + 1):
            out = out.where(F.col(f"n{j}") != F.col(f"n{i + 1}"))
    return out


def path_fingerprint(nodes: Column, edges: Column) -> Column:
    """``path_`` and 20 hex digits of the sha256 of the path's canonical JSON."""
    text = F.to_json(F.struct(edges.alias("edges"), nodes.alias("node_ids")))
    return F.concat(F.lit("path_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 20))


def describe_path(nodes: Column, types: Column, forward: Column) -> Column:
    """``a -[T]-> b <-[U]- c``."""
    hops = F.transform(types, lambda t, i: F.when(F.get(forward, i), F.concat(F.lit(" -["), t, F.lit("]-> "))).otherwise(F.concat(F.lit(" <-["), t, F.lit("]- "))))
    parts = F.transform(hops, lambda h, i: F.concat(h, F.get(nodes, i + 1)))
    return F.concat(F.get(nodes, F.lit(0)), F.array_join(parts, ""))
