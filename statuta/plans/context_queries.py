"""Queries of answers' contexts over the hybrid retrieval of all questions: sufficiency, required evidence, packing under the budget, and the check of each pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import context
from statuta.plans.registry import query
from statuta.plans.retrieval_queries import GOLD_SQL, _metrics
from statuta.plans.runtime_queries import FINAL_SQL, _retrieved
from statuta.runtime import checkpointed, table
from statuta.sources import corpus
from statuta.sources.units import EDGES_SQL, UNITS_SQL, edges, units

#: A question's fixed parts take its text and so many characters more.
FIXED = 9_000

HELD_SQL = f"""{FINAL_SQL},
q AS (SELECT query_id, intent, query_date, goal, anchors, 24000 - 256 - {FIXED} - length(text) AS budget FROM r),
hu AS (SELECT fin.query_id, fin.id, fin.rank, length(d.text) + length(fin.id::VARCHAR) AS cost, document_id, family, coalesce(effective_from, document_from) AS since, coalesce(effective_to, document_to) AS till FROM fin JOIN u USING (id) JOIN documents d ON d.doc_id = fin.id),
hp AS (SELECT query_id, rank, nodes, types, heads, list_distinct(nodes) AS citable, 40 * len(nodes) AS cost, len(list_filter(list_distinct(nodes), lambda x: list_contains(coalesce(own, []::BIGINT[]), x))) AS n_here FROM acc LEFT JOIN (SELECT query_id, list(id) AS own FROM hu GROUP BY query_id) USING (query_id)),
pj AS (SELECT hp.*, intent, query_date, goal, anchors, len(list_filter(list_zip(types, heads), lambda e: e[1] = goal AND list_contains(anchors, e[2]))) > 0 AS to_goal FROM hp JOIN q USING (query_id)),
uj AS (SELECT hu.*, intent, query_date, goal, anchors, coalesce(since <= query_date AND (till IS NULL OR till > query_date), false) AS holds FROM hu JOIN q USING (query_id)),
vers AS (SELECT query_id, max(n) AS versions FROM (SELECT query_id, family, count(DISTINCT document_id) AS n FROM hu WHERE family IS NOT NULL GROUP BY ALL) GROUP BY query_id),
bu AS (SELECT query_id, count(*) AS n, count(*) FILTER (list_contains(anchors, id) AND since IS NOT NULL) AS n_dated, bool_or(holds) AS holds FROM uj GROUP BY query_id),
bp AS (SELECT query_id, bool_or(to_goal) AS to_goal, bool_or(list_contains(types, 'CONTAINS')) AS contains, bool_or(len(types) >= 2 AND n_here = len(citable)) AS hops, bool_or(list_has_any(types, ['AMENDS', 'REPLACES'])) AS compares FROM pj GROUP BY query_id),
suff AS (SELECT query_id, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_RESULTS' WHEN goal IS NOT NULL AND NOT coalesce(to_goal, false) THEN 'NO_REFERENCE_EDGE' WHEN intent = 'HIERARCHY' AND NOT coalesce(bp.contains, false) THEN 'MISSING_HIERARCHY_PATH' WHEN intent = 'MULTI_HOP' AND NOT coalesce(hops, false) THEN 'MISSING_MULTI_HOP_PATH'
  WHEN intent = 'VALIDITY' AND query_date IS NULL THEN 'MISSING_TEMPORAL_POINT' WHEN intent = 'VALIDITY' AND CASE WHEN len(list_distinct(anchors)) > 0 THEN n_dated < len(list_distinct(anchors)) ELSE NOT coalesce(holds, false) END THEN 'MISSING_TEMPORAL_EVIDENCE'
  WHEN intent = 'COMPARISON' AND coalesce(versions, 0) < 2 AND NOT coalesce(compares, false) THEN 'COMPARISON_RELATION_UNVERIFIED' END AS reason FROM q LEFT JOIN bu USING (query_id) LEFT JOIN bp USING (query_id) LEFT JOIN vers USING (query_id)),
bestv AS (SELECT * FROM uj WHERE goal IS NULL AND intent = 'COMPARISON' AND family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, family, document_id ORDER BY rank, id) = 1),
alts AS (
 SELECT query_id, 'u' || id AS alternative, rank AS source_rank, [id] AS ids, NULL::BIGINT AS path FROM uj WHERE goal IS NULL AND (intent IN ('FACTUAL', 'DEFINITION') OR (intent = 'VALIDITY' AND query_date IS NOT NULL AND holds AND (len(anchors) = 0 OR list_contains(anchors, id))))
 UNION ALL
 SELECT query_id, 'p' || lpad(rank::VARCHAR, 6, '0'), (SELECT min(hu.rank) FROM hu WHERE hu.query_id = pj.query_id AND list_contains(pj.citable, hu.id)), (SELECT list(hu.id ORDER BY list_position(pj.nodes, hu.id)) FROM hu WHERE hu.query_id = pj.query_id AND list_contains(pj.citable, hu.id)), rank
 FROM pj WHERE CASE WHEN goal IS NOT NULL THEN to_goal AND n_here = len(citable) AND len(citable) >= 2 WHEN intent = 'HIERARCHY' THEN list_contains(types, 'CONTAINS') AND n_here = len(citable) AND len(citable) >= 2 WHEN intent = 'MULTI_HOP' THEN n_here = len(citable) AND len(citable) >= 2 WHEN intent = 'COMPARISON' THEN list_has_any(types, ['AMENDS', 'REPLACES']) AND n_here >= 2 ELSE false END
 UNION ALL
 SELECT query_id, 'f' || family, min(rank), list(id ORDER BY rank, id), NULL FROM bestv GROUP BY query_id, family HAVING count(*) >= 2),
priced AS (SELECT a.*, budget, (SELECT sum(cost) FROM hu WHERE hu.query_id = a.query_id AND list_contains(a.ids, hu.id)) + coalesce((SELECT cost FROM hp WHERE hp.query_id = a.query_id AND hp.rank = a.path), 0) AS cost FROM alts a JOIN q USING (query_id)),
pick AS (SELECT * FROM priced WHERE cost <= budget QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY source_rank, cost, alternative) = 1),
rest AS (SELECT p.query_id, p.budget, p.cost AS start, p.ids, list({{'used': 0::BIGINT, 'taken': []::BIGINT[], 'gone': []::BIGINT[], 'c': hu.cost::BIGINT, 'u': hu.id}} ORDER BY hu.rank, hu.id) FILTER (NOT list_contains(p.ids, hu.id)) AS more FROM pick p JOIN hu USING (query_id) GROUP BY ALL),
packs AS (SELECT query_id, list_reduce(list_prepend({{'used': start::BIGINT, 'taken': ids, 'gone': []::BIGINT[], 'c': 0::BIGINT, 'u': 0::BIGINT}}, coalesce(more, [])), lambda s, x: CASE WHEN s.used + x.c <= budget THEN {{'used': s.used + x.c, 'taken': list_append(s.taken, x.u), 'gone': s.gone, 'c': 0::BIGINT, 'u': 0::BIGINT}} ELSE {{'used': s.used, 'taken': s.taken, 'gone': list_append(s.gone, x.u), 'c': 0::BIGINT, 'u': 0::BIGINT}} END) AS f FROM rest)"""


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The requests, and the units and paths that retrieval gave them, with what each takes of a context."""
    requests, found = corpus.requests(spark, sf_dir), _retrieved(spark, sf_dir)
    asked = requests.select("query_id", "intent", "query_date", "goal", "anchors", (F.length("text") + FIXED).alias("overhead"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.length("text") + F.length(F.col("doc_id").cast("string"))).alias("cost"))
    facts = corpus.passages(spark, sf_dir).select("id", "document_id", "family", F.coalesce("effective_from", "document_from").alias("effective_from"), F.coalesce("effective_to", "document_to").alias("effective_to"))
    units = checkpointed(found.units.select("query_id", "id", "rank").join(facts, "id").join(texts, "id"))
    paths = checkpointed(found.paths.select("query_id", "rank", "nodes", "types", "heads", (F.size("nodes") * 40).alias("cost")))
    return checkpointed(asked), units, paths


@query(f"WITH RECURSIVE {HELD_SQL} SELECT query_id, reason FROM suff")
def gen1_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN1: what each question's retrieval lacks for its intent."""
    return context.sufficiency(*_held(spark, sf_dir))


@query(f"""WITH RECURSIVE {HELD_SQL} SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM alts) THEN 'PROJECTED_EVIDENCE_INSUFFICIENT' WHEN f IS NULL THEN 'REQUIRED_EVIDENCE_EXCEEDS_CONTEXT_BUDGET' END AS reason, alternative, coalesce(array_to_string(f.taken, ','), '') AS selected, coalesce(f.used, 0) AS used, coalesce(array_to_string(f.gone, ','), '') AS omitted
FROM q LEFT JOIN pick USING (query_id) LEFT JOIN packs USING (query_id)""")
def gen4_packed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN3, GEN4, TOP16, TOP17: each question's context: one required set of evidence whole, then what fits."""
    requests, units, paths = _held(spark, sf_dir)
    p = context.packed(requests, context.alternatives(requests, units, paths), units, paths)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return p.select("query_id", "reason", "alternative", text("selected").alias("selected"), "used", text("omitted").alias("omitted"))


@query(f"""WITH RECURSIVE {HELD_SQL}, torn AS (SELECT query_id, intent, query_date, alternative, path, p.ids AS need, CASE WHEN query_id % 7 = 3 THEN f.taken[2:] ELSE f.taken END AS taken FROM packs JOIN pick p USING (query_id) JOIN q USING (query_id)),
x AS (SELECT t.*, coalesce(hp.types, []::VARCHAR[]) AS types, (SELECT count(*) FROM hu WHERE hu.query_id = t.query_id AND list_contains(t.taken, hu.id)) AS n, (SELECT bool_and(since IS NOT NULL) FROM hu WHERE hu.query_id = t.query_id AND list_contains(t.need, hu.id)) AS dated, (SELECT count(DISTINCT (family, document_id)) FROM hu WHERE hu.query_id = t.query_id AND list_contains(t.need, hu.id)) AS versions FROM torn t LEFT JOIN hp ON hp.query_id = t.query_id AND hp.rank = t.path)
SELECT query_id, CASE WHEN len(list_filter(need, lambda i: NOT list_contains(taken, i))) > 0 THEN 'lost_required_evidence' WHEN intent IN ('FACTUAL', 'DEFINITION') AND n = 0 THEN 'no_direct_evidence' WHEN intent = 'HIERARCHY' AND NOT list_contains(types, 'CONTAINS') THEN 'hierarchy_path' WHEN intent = 'MULTI_HOP' AND (len(types) = 0 OR path IS NULL) THEN 'graph_path'
 WHEN intent = 'VALIDITY' AND NOT (query_date IS NOT NULL AND coalesce(dated, false)) THEN 'temporal_evidence' WHEN intent = 'COMPARISON' AND versions < 2 THEN 'comparison_versions' END AS fault FROM x""")
def gen5_projected_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN5: each pack checked again after packing; every seventh has lost its first unit on the way."""
    requests, units, paths = _held(spark, sf_dir)
    sets = checkpointed(context.alternatives(requests, units, paths))
    packs = context.packed(requests, sets, units, paths)
    torn = packs.withColumn("selected", F.when(F.col("query_id") % 7 == 3, F.expr("slice(selected, 2, size(selected))")).otherwise(F.col("selected")))
    return context.checked(requests, torn, sets, units, paths)


@query(f"""WITH RECURSIVE {HELD_SQL}, cs AS (SELECT query_id, query_id % 9 = 4 AS gap, query_id % 2 = 0 AS dates, (SELECT list(id ORDER BY rank) FROM hu WHERE hu.query_id = q.query_id AND rank <= 3) AS g1, (SELECT list(id ORDER BY rank) FROM hu WHERE hu.query_id = q.query_id AND id % 3 = q.query_id % 3) AS g2, query_date FROM q),
ans AS (SELECT query_id, f IS NULL AS refused, f.taken[1:2] AS cited FROM q LEFT JOIN packs USING (query_id))
SELECT query_id AS case_id, CASE WHEN gap THEN 'unsupported_capability' WHEN refused THEN 'cannot_answer' ELSE 'answered' END AS outcome, CASE WHEN gap THEN CASE WHEN query_id % 2 = 0 THEN '' ELSE 'UNEXPECTED_CAPABILITY_ERROR' END WHEN refused THEN 'UNEXPECTED_CANNOT_ANSWER'
 ELSE concat_ws(',', CASE WHEN NOT list_has_any(cited, coalesce(g1, [])) THEN 'MISSING_CITATION_GROUP_1' END, CASE WHEN NOT list_has_any(cited, coalesce(g2, [])) THEN 'MISSING_CITATION_GROUP_2' END, CASE WHEN dates AND query_date IS NULL THEN 'MISSING_TEMPORAL_DECISION' END) END AS failures FROM cs JOIN ans USING (query_id)""")
def evl15_hard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL15: every question's packed context as an answer that cites its first two units, against the citations and dates that its case wants."""
    requests, units, paths = _held(spark, sf_dir)
    packs = context.packed(requests, context.alternatives(requests, units, paths), units, paths)
    q = F.col("query_id")
    none = F.array().cast("array<bigint>")
    near = units.groupBy("query_id").agg(F.collect_set(F.when(F.col("rank") <= 3, F.col("id"))).alias("g1"), F.collect_set(F.when(F.col("id") % 3 == q % 3, F.col("id"))).alias("g2"))
    gap = q % 9 == 4
    cases = requests.join(near, "query_id", "left").select(q.alias("case_id"), F.array(F.coalesce("g1", none), F.coalesce("g2", none)).alias("groups"), (q % 2 == 0).alias("expects_dates"), F.when(gap & (q % 2 == 0), "VERSIONS").alias("expects_gap"))
    answers = packs.join(requests.select("query_id", "query_date"), "query_id").select(q.alias("case_id"), F.col("reason").isNotNull().alias("cannot_answer"), F.slice("selected", 1, 2).alias("cited"), F.col("query_date").isNotNull().alias("dated"), F.when(gap, "VERSIONS").alias("reported_gap"))
    return context.hard_failures(cases, answers).withColumn("failures", F.array_join("failures", ","))


@query(f"""{GOLD_SQL}, {UNITS_SQL}, {EDGES_SQL}, e AS (SELECT count(*) AS cases, avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM scored), d AS (SELECT count(*) - count(DISTINCT id) AS repeated FROM units), o AS (SELECT count(*) AS dangling FROM edges WHERE tail_id NOT IN (SELECT id FROM units)),
g AS (SELECT unnest(['cases', 'recall', 'mrr', 'ndcg', 'repeated', 'dangling']) AS gate, unnest([cases::DOUBLE, recall, mrr, ndcg, repeated::DOUBLE, dangling::DOUBLE]) AS value FROM e, d, o),
p AS (SELECT gate, value, CASE gate WHEN 'cases' THEN value >= 5 WHEN 'recall' THEN value >= 0.05 WHEN 'mrr' THEN value >= 0.2 WHEN 'ndcg' THEN value >= 0.1 ELSE value = 0 END AS passed FROM g) SELECT * FROM p UNION ALL SELECT 'all', NULL, bool_and(passed) FROM p""")
def evl16_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL12, EVL16: retrieval's metrics and the graph's figures against their bounds, and whether all hold."""
    means = _metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("cases"), *[F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")])
    u, e = units(spark, sf_dir), edges(spark, sf_dir)
    repeated = u.agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated"))
    dangling = e.join(u.select(F.col("id").alias("tail_id")).distinct(), "tail_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    one = means.crossJoin(repeated).crossJoin(dangling)
    return context.gates(one, {"cases": (">=", 5.0), "recall": (">=", 0.05), "mrr": (">=", 0.2), "ndcg": (">=", 0.1), "repeated": ("==", 0.0), "dangling": ("==", 0.0)})
