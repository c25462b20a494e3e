"""The graph that a corpus is written as: nodes of units and of named things, merged property by property, and edges with canonical ends.

A node is ``id, type, source, properties``: ``source`` ranks where it came from, 0 the parsed structure, higher numbers what was extracted later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import strings
from statuta.operators import rules

#: Properties that tell parallel relations of a type apart (fixed values).
DISCRIMINATORS = {"REFERS_TO": ["citation_text", "reference_bundle_id"], "AMENDS": ["effective_from"], "REPEALS": ["effective_from"], "REPLACES": ["effective_from"]}


def text_map(**values: Column) -> Column:
    """A map of the values that aren't null, as text."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def merged(nodes: DataFrame) -> DataFrame:
    """``id, type, properties, conflicts``: the nodes merged, and what contradicts itself as an array of ``property, error``, all in one pass.

    Of a property the value of the best source counts.  Where sources of the same rank differ the property is in conflict and the least value stands; where types
    differ the best source's type stands and ``type`` is in conflict.  A node of properties alone in none keeps an empty map.
    """
    entries = nodes.select("id", "source", F.explode(F.map_entries("properties")).alias("e")).select("id", "source", "e.key", "e.value").unionByName(nodes.select("id", "source", F.lit("\x00type").alias("key"), F.col("type").alias("value")))
    # the least and the greatest value of the best source, nulls aside
    least, greatest = F.min(F.struct("source", F.col("value").isNull().alias("no"), "value")), F.max(F.struct((-F.col("source")).alias("source"), F.col("value").isNotNull().alias("yes"), "value"))
    best = entries.groupBy("id", "key").agg(least["value"].alias("value"), greatest["value"].alias("top"), F.min("value").alias("_least"), F.max("value").alias("_most"))
    is_type = F.col("key") == "\x00type"
    differ = (F.col("value") != F.col("top")) | (is_type & (F.col("_least") != F.col("_most")))
    conflict = F.struct(F.when(is_type, "type").otherwise(F.col("key")).alias("property"), F.when(is_type, "types_differ").otherwise("values_differ").alias("error"))
    pairs = F.array_sort(F.collect_list(F.when(~is_type, F.struct("key", "value"))))
    return best.groupBy("id").agg(F.max(F.when(is_type, F.col("value"))).alias("type"), F.map_from_entries(pairs).alias("properties"), F.collect_list(F.when(differ, conflict)).alias("conflicts"))


def merged_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merged`` as two tables: the nodes, ``id, type, properties``, and their conflicts, ``id, property, error``."""
    both = merged(nodes)
    return both.drop("conflicts"), both.select("id", F.explode("conflicts").alias("c")).select("id", "c.property", "c.error")


def concept_id(name: Column) -> Column:
    """The canonical id of a thing by its name: its slug, and a digest of the folded name that tells equal slugs apart."""
    plain = F.lower(strings.squeeze(name))
    return F.concat_ws("_", F.lit("ent"), F.substring(strings.slug(plain), 1, 24), F.substring(F.md5(plain.cast("binary")), 1, 8))


def relation_id(head: str = "head_id", kind: str = "type", tail: str = "tail_id", properties: str = "properties") -> Column:
    """sha1 of head, type, tail and, by type, of what tells parallel relations apart."""
    apart = [F.when(F.col(kind) == t, F.concat_ws("|", *[F.coalesce(F.try_element_at(properties, F.lit(p)), F.lit("")) for p in ps])) for t, ps in DISCRIMINATORS.items()]
    return F.sha1(F.concat_ws("|", head, kind, tail, F.coalesce(*apart, F.lit(""))).cast("binary"))


def canonical_edges(records: DataFrame, nodes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``head_id, type, tail_id, properties, relation_id`` of the records that can be written, and ``record_id, error`` of the others.

    ``records`` is ``record_id, head, type, tail, properties, deferred``; an end is a node's id, or a name that ``aliases(name, id)`` gives for one node alone.  Deferred records
    belong to the corpus' own pass.  Relations that the ontology doesn't allow between the types, or lead back to their head, are refused; of records of one
    relation the properties are merged, the least record first.
    """
    known = nodes.select(F.col("id").alias("_id"), F.col("type").alias("_type"))
    named = aliases.groupBy(F.lower(strings.squeeze(F.col("name"))).alias("_name")).agg(F.min("id").alias("_id"), F.count_distinct("id").alias("_n")).where("_n = 1").select("_name", F.col("_id"))
    r = records
    for end in ("head", "tail"):
        direct = known.select(F.col("_id").alias(end), F.col("_type").alias(f"_{end}_type"), F.lit(True).alias(f"_{end}_there"))
        by_name = named.join(known, "_id").select(F.col("_name").alias(f"_{end}_key"), F.col("_id").alias(f"_{end}_named"), F.col("_type").alias(f"_{end}_named_type"))
        r = r.withColumn(f"_{end}_key", F.lower(strings.squeeze(F.col(end)))).join(direct, end, "left").join(by_name, f"_{end}_key", "left")
        r = r.withColumns({f"{end}_id": F.when(F.col(f"_{end}_there"), F.col(end)).otherwise(F.col(f"_{end}_named")), f"_{end}_t": F.coalesce(f"_{end}_type", f"_{end}_named_type")})
    error = (
        F.when(F.coalesce("deferred", F.lit(False)), "deferred").when(F.col("head_id").isNull(), "unknown_head").when(F.col("tail_id").isNull(), "unknown_tail")
        .when(~F.coalesce(rules.allowed(F.col("type"), F.col("_head_t"), F.col("_tail_t")), F.lit(False)), "pair").when((F.col("head_id") == F.col("tail_id")) & ~F.col("type").isin(rules.LOOPS_ALLOWED), "self_loop")
    )
    judged = r.withColumn("error", error)
    fine = judged.where("error is null").withColumn("relation_id", relation_id())
    # of a property of one relation the least record's value counts
    entries = fine.select("relation_id", "record_id", F.explode(F.map_entries("properties")).alias("e")).groupBy("relation_id", "e.key").agg(F.min_by("e.value", "record_id").alias("value"))
    props = entries.groupBy("relation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    edges = fine.groupBy("relation_id").agg(F.min("head_id").alias("head_id"), F.min("type").alias("type"), F.min("tail_id").alias("tail_id"), F.count(F.lit(1)).alias("n_records")).join(props, "relation_id", "left")
    out = edges.select("head_id", "type", "tail_id", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), "relation_id", "n_records")
    return out, judged.where("error is not null").select("record_id", "error")
