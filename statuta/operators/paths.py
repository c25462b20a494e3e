"""Paths after they are found: conformance, lifting to citable units, ranked expansion, legacy edges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.runtime import checkpointed


def conforms(types: Column, plan: list[str]) -> Column:
    """Whether a path's relation types are just the plan's, step by step."""
    want = F.array(*map(F.lit, plan))
    return (F.size(types) == len(plan)) & F.forall(F.zip_with(types, want, lambda a, b: a.eqNullSafe(b)), lambda same: same)


def citable_units(nodes: Column, labels: Column, citable: list[str]) -> Column:
    """The ids of a path's nodes with a citable label, in path order, each once."""
    pairs = F.arrays_zip(nodes.alias("id"), labels.alias("label"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda x: x["label"].isin(citable)), lambda x: x["id"]))


def ranked_expansion(trails: DataFrame, limit: int) -> DataFrame:
    """``trails(seed_id, nodes, edge_ids)`` with ``rank`` from 1 within the seed: shortest first, then by nodes and edges; at most ``limit``.

    The cut comes before any check of validity, so invalid paths use up places.
    """
    best = Window.partitionBy("seed_id").orderBy(F.size("edge_ids"), "nodes", "edge_ids")
    return trails.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def one_hop(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``document_id, id``: what any unit of a document touches by one edge, in either direction."""
    own = owners.select("document_id", F.col("id").alias("_own")).distinct()
    ends = edges.select(F.col("head_id").alias("_own"), F.col("tail_id").alias("id")).unionByName(edges.select(F.col("tail_id").alias("_own"), F.col("head_id").alias("id")))
    return own.join(ends, "_own").select("document_id", "id").distinct()


def neighbours(edges: DataFrame, owners: DataFrame, depth: int = 2) -> DataFrame:
    """``document_id, id, distance``: what a document's units reach within ``depth`` edges in either direction, at the least distance; its own units at 0 are left out."""
    if depth not in (1, 2):
        raise ValueError("the depth of a neighbourhood is 1 or 2")
    ends = edges.select(F.col("head_id").alias("_at"), F.col("tail_id").alias("id")).unionByName(edges.select(F.col("tail_id").alias("_at"), F.col("head_id").alias("id"))).distinct()
    seen = owners.select("document_id", "id").distinct().withColumn("distance", F.lit(0))
    level = seen
    for d in range(1, depth + 1):
        level = level.select("document_id", F.col("id").alias("_at")).join(ends, "_at").select("document_id", "id").distinct().join(seen.select("document_id", "id"), ["document_id", "id"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(level)
    return seen.where("distance > 0")


def neighbour_counts(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """``document_id, one, two``: how many nodes ``neighbours`` gives at distances 1 and 2, for each document, without the pairs of documents and nodes at distance 2.

    A document that reaches one node has that node's neighbours at distance 2 or nearer, so their number is the node's degree; only those that reach several are taken node by
    node.  Less what is nearer: own nodes with an edge to a node that isn't, and reached nodes with an edge between them, found from the end of fewer edges.
    """
    pair = ["document_id", "id"]
    ends = edges.select(F.col("head_id").alias("_at"), F.col("tail_id").alias("id")).unionByName(edges.select(F.col("tail_id").alias("_at"), F.col("head_id").alias("id"))).distinct()
    ends = checkpointed(ends)
    degree = checkpointed(ends.groupBy("_at").agg(F.count(F.lit(1)).alias("_degree")))
    # the only nodes that matter have edges
    own = checkpointed(owners.select(*pair).join(degree.select(F.col("_at").alias("id")), "id", "left_semi").distinct())
    out = checkpointed(own.withColumnRenamed("id", "_at").join(ends, "_at").select("document_id", "_at", "id").join(own, pair, "left_anti"))
    fresh = checkpointed(out.select(*pair).distinct())
    ones = fresh.groupBy("document_id").agg(F.count(F.lit(1)).alias("one"), F.min("id").alias("_at"))
    single = ones.where("one = 1").join(degree, "_at").select("document_id", F.col("_degree").alias("_all"))
    many = fresh.join(ones.where("one > 1").select("document_id"), "document_id", "left_semi").withColumnRenamed("id", "_at")
    several = many.join(ends, "_at").select(*pair).distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("_all"))
    # an edge between reached nodes leads from the end of fewer edges to the other
    by = degree.select(F.col("_at").alias("id"), F.col("_degree").alias("_other"))
    upward = ends.join(degree, "_at").join(by, "id").where(F.col("_degree") <= F.col("_other")).select("_at", "id")
    inner = fresh.withColumnRenamed("id", "_at").join(upward, "_at").join(fresh, pair, "left_semi")
    near = inner.select(*pair).unionByName(inner.select("document_id", F.col("_at").alias("id"))).unionByName(out.select("document_id", F.col("_at").alias("id"))).distinct()
    nearer = near.groupBy("document_id").agg(F.count(F.lit(1)).alias("_near"))
    two = single.unionByName(several).join(nearer, "document_id").select("document_id", (F.col("_all") - F.col("_near")).alias("two"))
    zero = F.lit(0).cast("long")
    found = ones.select("document_id", "one").join(two, "document_id", "left")
    return owners.select("document_id").distinct().join(found, "document_id", "left").select("document_id", F.coalesce("one", zero).alias("one"), F.coalesce("two", zero).alias("two"))


def shape_error(nodes: Column, edges: Column, description: Column, known: list[str]) -> Column:
    """The first fault of a path's shape, null for none: its edges ``(id, type, head, tail)`` against its nodes, in order of the path.

    A path has one node more than edges and one edge at least; ids are canonical; types are known; an edge joins the nodes beside it in either direction; no edge comes twice; the description isn't blank.
    """
    canonical = r"^[a-z0-9]+(?:_[a-z0-9]+)*$"
    bad_id = lambda c: ~F.coalesce(c.rlike(canonical), F.lit(False))

    def of_edge(e: Column, i: Column) -> Column:
        ends = F.array_sort(F.array(e["head"], e["tail"]))
        beside = F.array_sort(F.array(F.get(nodes, i), F.get(nodes, i + 1)))
        return F.when(~F.coalesce(e["type"].isin(known), F.lit(False)), "relation_type").when(F.coalesce(e["id"], F.lit("")) == "", "relation_id").when(bad_id(e["head"]) | bad_id(e["tail"]), "edge_end").when(ends != beside, "not_adjacent")

    first = F.get(F.filter(F.transform(edges, of_edge), lambda f: f.isNotNull()), F.lit(0))
    ids = F.transform(edges, lambda e: e["id"])
    return (
        F.when(F.size(nodes) != F.size(edges) + 1, "cardinality").when(F.size(edges) < 1, "no_edge").when(F.exists(nodes, bad_id), "node_id")
        .when(first.isNotNull(), first).when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated_edge").when(F.coalesce(F.trim(description), F.lit("")) == "", "blank_description")
    )


def unproven_legacy(legacy: DataFrame, chain: DataFrame) -> DataFrame:
    """Direct edges ``(head_id, tail_id)`` that no two-step chain replaces, and so must stay."""
    up, down = chain.select("head_id", F.col("tail_id").alias("_mid")), chain.select(F.col("head_id").alias("_mid"), "tail_id")
    return legacy.join(up.join(down, "_mid").select("head_id", "tail_id"), ["head_id", "tail_id"], "left_anti")


def open_on(day: date, start: str) -> Column:
    """Whether an undated edge or one that began by the day."""
    return F.col(start).isNull() | (F.col(start) <= F.lit(day))


def endpoint_status(candidates: DataFrame, key: str, score: str, least_score: float, least_margin: float) -> DataFrame:
    """``key, status, target``: BOUND if the best score and its lead over the second are large enough, else UNBOUND or AMBIGUOUS."""
    best = Window.partitionBy(key).orderBy(F.desc(score), "id")
    ranked = candidates.withColumns({"_n": F.row_number().over(best), "_next": F.coalesce(F.lead(score).over(best), F.lit(0.0))}).where("_n = 1")
    status = F.when(F.col(score) < least_score, "UNBOUND").when(F.col(score) - F.col("_next") < least_margin, "AMBIGUOUS").otherwise("BOUND")
    return ranked.select(key, status.alias("status"), F.when(status == "BOUND", F.col("id")).alias("target"))
