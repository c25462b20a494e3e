"""Queries of a provider's links in the documents' texts: candidates, their owners, and bundles that the registry proves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import provider
from statuta.plans.registry import query
from statuta.runtime import checkpointed
from statuta.sources import statutes as source

CANDIDATES_SQL = f"""{source.STATUTES_SQL},
hosts AS (SELECT link_id, arg_min(u.id, u.stop - u.start) AS host FROM slinks l JOIN spans u ON u.document_id = l.document_id AND u.start <= l.start AND l.stop <= u.stop GROUP BY link_id),
named AS (SELECT l.link_id, unnest(CASE WHEN place = 1 OR kind IN (0, 5) THEN ['art1'] WHEN kind IN (1, 6, 8) THEN ['art1_cl1'] WHEN kind = 2 THEN ['art1_cl1', 'art1_cl2'] WHEN kind = 7 THEN ['art1_cl9'] ELSE []::VARCHAR[] END) AS item, target FROM slinks l),
points AS (SELECT link_id, count(*) AS n_items, count(u.id) AS n_found, list(u.id ORDER BY u.id) FILTER (u.id IS NOT NULL) AS ids FROM named n LEFT JOIN sunits u ON u.id = n.target || '_' || n.item GROUP BY link_id),
joined AS (SELECT l.*, host, place = 1 AS quoted, CASE WHEN place = 0 AND kind IN (1) THEN 'AMENDS' WHEN place = 0 AND kind IN (6, 8) THEN 'POSITIONAL_ANCHOR' ELSE 'REFERS_TO' END AS relation, coalesce(n_items, 0) AS n_items, coalesce(n_found, 0) AS n_found,
  target IS NOT NULL AND target::BIGINT < (SELECT count(*) FROM documents) AS known, CASE WHEN n_items IS NULL THEN [target] ELSE coalesce(ids, []::VARCHAR[]) END AS targets, replace(link_id, ':1', ':0') AS basis FROM slinks l LEFT JOIN hosts USING (link_id) LEFT JOIN points USING (link_id)),
owned AS (SELECT j.*, CASE WHEN NOT quoted THEN host WHEN j.kind = 1 AND b.n_found = 1 THEN b.ids[1] END AS source FROM (SELECT * REPLACE (regexp_replace(link_id, ':1$', ':0') AS basis) FROM joined) j LEFT JOIN points b ON b.link_id = j.basis),
cand AS (SELECT link_id, document_id, start, citation, relation, CASE WHEN quoted THEN 'PROJECTED' ELSE 'HOST' END AS ownership, host, source, CASE WHEN quoted THEN basis END AS basis_id, targets,
  CASE WHEN relation = 'POSITIONAL_ANCHOR' THEN 'positional_anchor_no_graph_edge' WHEN quoted AND source IS NULL THEN CASE WHEN kind = 8 THEN 'projected_added_source_not_in_corpus' ELSE 'projected_source_owner_not_resolved' END
   WHEN NOT quoted AND host IS NULL THEN 'source_structural_unit_not_found' WHEN NOT known THEN 'target_document_not_in_corpus' WHEN regexp_extract(citation, '(\\d+)/2020/QH14', 1) NOT IN ('', target) THEN 'provider_text_target_conflict'
   WHEN n_items > 0 AND n_items <> n_found THEN 'target_provider_item_unresolved' ELSE 'provider_endpoints_resolved' END AS reason, target FROM owned)"""


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, their links, and the registry; texts and registry are read more than once and kept."""
    texts, links, documents = source.statutes(spark, sf_dir)
    texts = checkpointed(texts)
    return texts, links, checkpointed(source.registry(texts, documents))


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The candidates of all links, and the registry."""
    texts, links, registry = _registry(spark, sf_dir)
    return checkpointed(provider.candidates(links, texts, registry)), registry


@query(f"WITH {CANDIDATES_SQL} SELECT link_id, relation, ownership, host, source, basis_id, array_to_string(targets, ',') AS targets, reason, sha256('provider|' || link_id || '|' || citation)[1:24] AS candidate_id FROM cand")
def ref11_provider_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF11, REF12: every link of all texts with its owner, relation, targets and what it lacks."""
    found, _ = _candidates(spark, sf_dir)
    name = F.substring(F.sha2(F.concat_ws("|", F.lit("provider"), "link_id", "citation").cast("binary"), 256), 1, 24)
    return found.select("link_id", "relation", "ownership", F.col("host.id").alias("host"), F.col("source.id").alias("source"), "basis_id", F.array_join(F.transform("targets", lambda t: t["id"]), ",").alias("targets"), "reason", name.alias("candidate_id"))


# A registry in which some articles stand twice and some have another type than when the links were read.
DRIFT_SQL = """drifted AS (SELECT id, type, document_id, article_id FROM (
 SELECT id, CASE WHEN type = 'Article' AND document_id::BIGINT % 50 = 7 THEN 'Section' ELSE type END AS type, document_id, article_id FROM sunits UNION ALL SELECT id, type, document_id, article_id FROM sunits WHERE document_id::BIGINT % 50 = 3 AND type = 'Article'))"""


@query(f"""WITH {CANDIDATES_SQL}, {DRIFT_SQL}, ends AS (SELECT id, count(*) AS n, min(type) AS type, min(document_id) AS document_id, min(article_id) AS article_id FROM drifted GROUP BY id UNION ALL SELECT doc_id::VARCHAR, 1, 'Document', doc_id::VARCHAR, NULL FROM documents),
taken AS (SELECT * FROM cand WHERE reason = 'provider_endpoints_resolved' AND relation = 'REFERS_TO'),
t AS (SELECT link_id, pos, CASE WHEN coalesce(e.n, 0) <> 1 THEN 'target_not_once' WHEN e.type <> (CASE WHEN contains(id, '_cl') THEN 'Clause' WHEN contains(id, '_art') THEN 'Article' ELSE 'Document' END) THEN 'target_type_drift' END AS f, e.document_id AS tdoc FROM (SELECT link_id, unnest(targets) AS id, generate_subscripts(targets, 1) AS pos FROM taken) LEFT JOIN ends e USING (id)),
p AS (SELECT link_id, arg_min(f, pos) FILTER (f IS NOT NULL) AS f, list(tdoc) AS docs FROM t GROUP BY link_id),
v AS (SELECT k.*, s.document_id AS source_document, s.article_id, docs, CASE WHEN k.ownership = 'PROJECTED' AND b.reason <> 'provider_endpoints_resolved' THEN 'projected_source_basis_invalid' WHEN s.n <> 1 THEN 'source_not_once' WHEN s.type <> (CASE WHEN contains(k.source, '_cl') THEN 'Clause' ELSE 'Article' END) THEN 'source_type_drift' ELSE f END AS fault
 FROM taken k JOIN ends s ON s.id = k.source JOIN p USING (link_id) LEFT JOIN cand b ON b.link_id = k.basis_id)
SELECT link_id AS bundle_id, ownership, source AS source_id, article_id, source_document, CASE WHEN fault IS NULL THEN array_to_string(targets, ',') END AS targets, CASE WHEN fault IS NULL THEN CASE WHEN len(list_filter(docs, lambda d: d <> source_document)) > 0 THEN 'EXTERNAL' ELSE 'LOCAL' END END AS scope,
 fault IS NULL AND len(targets) = 1 AND targets[1] = source AS is_self, fault FROM v""")
def ref20_provider_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF20: the links that refer to something as bundles, each target proved by the registry, all or none."""
    found, registry = _candidates(spark, sf_dir)
    n = F.col("document_id").cast("long") % 50
    article = F.col("type") == "Article"
    drifted = registry.withColumn("type", F.when(article & (n == 7), "Section").otherwise(F.col("type"))).unionByName(registry.where(article & (n == 3)))
    return provider.bundles(found, drifted).withColumn("targets", F.array_join("target_ids", ",")).drop("target_ids")
