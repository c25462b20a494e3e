"""Queries of the whole graph payload: units of all texts, the things that they define, and the relations that their links give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import payload
from statuta.plans.provider_queries import CANDIDATES_SQL, _candidates, _registry
from statuta.plans.registry import query
from statuta.runtime import checkpointed, table
from statuta.sources.lines import canonical

NODES_SQL = f"""{CANDIDATES_SQL},
defs AS (SELECT doc_id || '_art' || (i // 4 + 1) AS article, regexp_extract(line, '[A-Za-z]+') AS word, doc_id, i FROM srows WHERE regexp_matches(line, '[A-Za-z]')),
ents AS (SELECT *, 'ent_' || lower(word[:24]) || '_' || md5(lower(word))[:8] AS id FROM defs)"""


def _defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``article, word, record_id``: each line's first word of plain letters is a thing that its article defines."""
    lines = F.filter(F.split(canonical(F.col("text")), "\n"), lambda x: F.trim(x) != "")
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.posexplode(lines).alias("i", "line"))
    word = F.regexp_extract("line", "[A-Za-z]+", 0)
    return d.select(F.concat_ws("_art", F.col("doc_id").cast("string"), (F.floor(F.col("i") / 4) + 1).cast("string")).alias("article"), word.alias("word"), F.concat_ws(":", F.lit("def"), "doc_id", "i").alias("record_id")).where("word <> ''")


def _nodes(spark: SparkSession, sf_dir: str, registry: DataFrame, defined: DataFrame) -> DataFrame:
    units = registry.select("id", "type", F.lit(0).alias("source"), payload.text_map(number=F.col("number"), document_id=F.col("document_id")).alias("properties"))
    things = defined.select("word").distinct().select(payload.concept_id(F.col("word")).alias("id"), F.lit("LegalConcept").alias("type"), F.lit(1).alias("source"), payload.text_map(name=F.lower("word"), label=F.col("word")).alias("properties"))
    return units.unionByName(things)


@query(f"""WITH {NODES_SQL}, e AS (SELECT id, min(word) AS label, count(DISTINCT word) AS n FROM ents GROUP BY id)
SELECT id, 'LegalConcept' AS type, 2::BIGINT AS properties, CASE WHEN n > 1 THEN 'label:values_differ' ELSE '' END AS conflicts, label AS shown FROM e
UNION ALL SELECT id, type, 2, '', regexp_extract(id, '([0-9]+)$', 1) FROM sunits UNION ALL SELECT doc_id::VARCHAR, 'Document', 2, '', doc_id || '/2020/QH14' FROM documents""")
def grf16_payload_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF16: every node of the payload, merged property by property, and the properties in conflict."""
    _, _, registry = _registry(spark, sf_dir)
    whole = payload.merged(_nodes(spark, sf_dir, registry, _defined(spark, sf_dir)))
    told = F.array_join(F.array_sort(F.array_distinct(F.transform("conflicts", lambda c: F.concat_ws(":", c["property"], c["error"])))), ",")
    shown = F.coalesce(F.try_element_at("properties", F.lit("label")), F.try_element_at("properties", F.lit("number")))
    return whole.select("id", "type", F.size("properties").cast("long").alias("properties"), told.alias("conflicts"), shown.alias("shown"))


@query(f"""WITH {NODES_SQL}, units_ AS (SELECT id, type FROM sunits UNION ALL SELECT doc_id::VARCHAR, 'Document' FROM documents),
recs AS (SELECT link_id AS record_id, source AS head, relation AS type, unnest(targets) AS tail, citation AS apart, document_id::BIGINT % 9 = 4 AS deferred FROM cand WHERE reason = 'provider_endpoints_resolved' AND relation = 'REFERS_TO'
 UNION ALL SELECT 'def:' || doc_id || ':' || i, article, 'DEFINES', id, '', false FROM ents),
j AS (SELECT r.*, h.type AS ht, CASE WHEN r.type = 'DEFINES' THEN 'LegalConcept' ELSE t.type END AS tt FROM recs r LEFT JOIN units_ h ON h.id = r.head LEFT JOIN units_ t ON t.id = r.tail)
SELECT head AS head_id, type, tail AS tail_id, sha1(head || '|' || type || '|' || tail || '|' || CASE WHEN type = 'REFERS_TO' THEN apart || '|' ELSE '' END) AS relation_id, count(*) AS n_records FROM j WHERE NOT deferred AND ht IS NOT NULL AND tt IS NOT NULL AND (type = 'DEFINES' OR ht IN ('Article', 'Clause')) GROUP BY head, type, tail, apart""")
def grf16_payload_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF16: the payload's semantic edges: references by links, definitions by name, ends made canonical, repeated records one relation."""
    found, registry = _candidates(spark, sf_dir)
    defined = checkpointed(_defined(spark, sf_dir))
    nodes = checkpointed(payload.merged_nodes(_nodes(spark, sf_dir, registry, defined))[0].select("id", "type"))
    links = found.where("status = 'RESOLVED' and relation = 'REFERS_TO'").select(F.col("link_id").alias("record_id"), F.col("source.id").alias("head"), F.col("relation").alias("type"), F.explode("targets").alias("t"), payload.text_map(citation_text=F.col("citation")).alias("properties"), (F.col("doc_id") % 9 == 4).alias("deferred"))
    links = links.select("record_id", "head", "type", F.col("t.id").alias("tail"), "properties", "deferred")
    named = defined.select("record_id", F.col("article").alias("head"), F.lit("DEFINES").alias("type"), F.concat(F.lit("  "), F.upper("word")).alias("tail"), payload.text_map(confidence=F.lit("1")).alias("properties"), F.lit(False).alias("deferred"))
    aliases = defined.select(F.col("word").alias("name"), payload.concept_id(F.col("word")).alias("id")).distinct()
    edges, _ = payload.canonical_edges(links.unionByName(named), nodes, aliases)
    return edges.select("head_id", "type", "tail_id", "relation_id", "n_records")
