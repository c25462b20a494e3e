"""Queries of hybrid retrieval over the corpus: filters, seed channels, expansion, both fusions and their contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import fulltext, retrieval
from statuta.plans.registry import query
from statuta.runtime import table
from statuta.sources import corpus

SCOPE = "(len(doc_types) = 0 OR list_contains(doc_types, doc_type))"


def _valid(start: str, end: str) -> str:
    return f"(query_date IS NULL OR coalesce({start} <= query_date AND ({end} IS NULL OR {end} > query_date), false))"


def _status(column: str) -> str:
    return f"(len(legal_statuses) = 0 OR list_contains(legal_statuses, {column}))"


SEED = f"{SCOPE} AND {_status('document_status')} AND {_valid('coalesce(effective_from, document_from)', 'coalesce(effective_to, document_to)')}"
ANCHOR = f"{SCOPE} AND {_status('document_status')} AND {_valid('effective_from', 'effective_to')}"
STRUCTURAL = f"{_status('legal_status')} AND {_valid('effective_from', 'effective_to')}"


@query(f"""WITH {corpus.CORPUS_SQL} SELECT query_id, count(*) FILTER ({SEED}) AS seeds, count(*) FILTER ({ANCHOR}) AS anchors, count(*) FILTER ({STRUCTURAL}) AS structural, count(*) FILTER ({SCOPE}) AS identity FROM r, u GROUP BY query_id""")
def flt2_filter_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 to FLT6: how many passages each request's four filters pass; passages meet each combination of filters once, of which there are few."""
    asked, u = corpus.requests(spark, sf_dir).drop("vector", "text"), corpus.passages(spark, sf_dir)
    filters = ["query_date", "document_ids", "doc_types", "legal_statuses"]
    r = asked.select(*filters).distinct()
    kinds = {"seeds": retrieval.seed_filter(), "anchors": retrieval.anchor_filter(), "structural": retrieval.structural_filter(), "identity": retrieval.in_scope()}
    retrieval.filter_values(["Law", " Decree"])
    counts = u.crossJoin(r).groupBy(*filters).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    same = F.lit(True)
    for c in filters:
        same = same & asked[c].eqNullSafe(counts[c])
    return asked.select("query_id", *filters).join(counts, same).select("query_id", *kinds)


WORDS_SQL = """w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM r),
p AS (SELECT term, id, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_len FROM w), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT query_id, id, sum(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len))) AS score FROM p JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL)"""

SEEDS_SQL = f"""{corpus.CORPUS_SQL}, {WORDS_SQL},
vs AS (SELECT query_id, u.id, u.label, round(list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[]), 12) AS score FROM r, embeddings JOIN u ON u.id = vec_id WHERE vector IS NOT NULL AND intent <> 'HIERARCHY'),
fetched AS (SELECT query_id, 'vector' AS channel, id, score FROM vs QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) <= 80
 UNION ALL SELECT query_id, 'fulltext', id, round(score, 9) FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 80),
an AS (SELECT query_id, id, pos AS rank FROM (SELECT query_id, doc_types, unnest(anchors) AS id, generate_subscripts(anchors, 1) AS pos FROM r) JOIN u USING (id) WHERE {SCOPE}),
gone AS (SELECT query_id FROM r WHERE len(anchors) > (SELECT count(*) FROM an WHERE an.query_id = r.query_id)),
live AS (SELECT * FROM r WHERE query_id NOT IN (FROM gone)),
seeds AS (SELECT query_id, channel, id, score, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS rank FROM fetched JOIN u USING (id) JOIN live USING (query_id) WHERE {SEED} QUALIFY rank <= 20)"""


@query(f"WITH {SEEDS_SQL} SELECT query_id, channel, id, score, rank FROM seeds")
def ret3_seed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET1 to RET3, TOP1, TOP2, SET1: the routed channels of three vector indexes and full text, over-fetched, then filtered."""
    r, u = corpus.requests(spark, sf_dir), corpus.passages(spark, sf_dir)
    live = r.join(retrieval.unavailable(r, retrieval.anchors(r, u)), "query_id", "left_anti")
    return retrieval.seeds(live, u, table(spark, sf_dir, "documents"), corpus.vectors(spark, sf_dir), retrieval.Limits())


RULES = ", ".join(f"('{i}', '{t}', {d}, '{w}')" for i, (ts, d, w) in retrieval.POLICIES.items() for t in ts)
RUN_SQL = f"""{SEEDS_SQL},
r1 AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'fulltext') AS f, sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'vector') AS v FROM seeds GROUP BY ALL),
top1 AS (SELECT query_id, id FROM r1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(f, 0) + coalesce(v, 0) DESC, id) <= 3),
hyd AS (SELECT an.* FROM an JOIN live USING (query_id)),
decided AS (SELECT query_id FROM hyd JOIN live USING (query_id) JOIN u USING (id) WHERE intent = 'VALIDITY' AND query_date IS NOT NULL GROUP BY query_id
 HAVING bool_and(coalesce(coalesce(effective_from, document_from) IS NOT NULL AND (query_date < coalesce(effective_from, document_from) OR coalesce(query_date >= coalesce(effective_to, document_to), false)), false))),
entries AS (SELECT query_id, id FROM hyd WHERE query_id NOT IN (FROM decided) UNION SELECT query_id, id FROM top1 WHERE query_id NOT IN (FROM decided)),
policy(intent, type, depth, way) AS (VALUES {RULES}), rules AS (SELECT query_id, type, depth, way FROM live JOIN policy USING (intent) WHERE goal IS NULL OR goal = type),
sides AS (SELECT head_id AS a, tail_id AS b, type, relation_id, true AS forward, since FROM e UNION ALL SELECT tail_id, head_id, type, relation_id, false, since FROM e WHERE head_id <> tail_id),
walk AS (SELECT query_id, id AS here, [id] AS nodes, []::VARCHAR[] AS ids, []::VARCHAR[] AS types, []::BIGINT[] AS heads, NULL::DATE AS since, 0 AS len FROM entries
 UNION ALL SELECT w.query_id, s.b, list_append(nodes, s.b), list_append(ids, relation_id), list_append(types, s.type), list_append(heads, CASE WHEN forward THEN a ELSE b END), greatest(w.since, s.since), len + 1
 FROM walk w JOIN sides s ON s.a = w.here JOIN rules USING (query_id) WHERE rules.type = s.type AND (way = 'both' OR forward) AND len < depth AND NOT list_contains(ids, relation_id)),
kept AS (SELECT query_id, nodes, ids, types, heads, since, query_date FROM walk JOIN u ON u.id = here JOIN live USING (query_id) WHERE len > 0 AND {SEED} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len, nodes, ids) <= 50),
judged AS (SELECT k.*, (query_date IS NULL OR since IS NULL OR since <= query_date) AND NOT EXISTS (SELECT 1 FROM u WHERE list_contains(k.nodes, u.id) AND label <> 'Appendix' AND NOT {_valid('effective_from', 'effective_to')}) AS ok FROM kept k),
acc AS (SELECT query_id, nodes, types, ids, heads, row_number() OVER (PARTITION BY query_id ORDER BY len(ids), nodes[1], nodes[-1], types, nodes, ids) AS rank FROM judged WHERE ok)"""


@query(f"WITH RECURSIVE {RUN_SQL} SELECT query_id, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types, rank FROM acc")
def grf3_policy_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF1 to GRF3, TOP3, TOP4, FLT8, SET2: the paths of each intent's policy from anchors and best seeds, cut, dated, ranked."""
    return _retrieved(spark, sf_dir).paths.select("query_id", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), F.array_join("types", ">").alias("types"), "rank")


FINAL_SQL = f"""{RUN_SQL},
occ AS (SELECT query_id, id, min(rank) AS first FROM (SELECT query_id, rank, unnest(nodes) AS id FROM acc) GROUP BY ALL),
reach AS (SELECT DISTINCT a.query_id, a.nodes[-1] AS id FROM acc a), ru AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first, id) AS rank FROM reach JOIN occ USING (query_id, id)),
g AS (SELECT query_id, id, anchor, row_number() OVER (PARTITION BY query_id ORDER BY NOT anchor, rank) AS rank FROM (SELECT query_id, id, rank, true AS anchor FROM hyd UNION ALL SELECT query_id, id, rank, false FROM ru WHERE (query_id, id) NOT IN (SELECT query_id, id FROM hyd))),
r2 AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'fulltext') AS f, sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'graph') AS gr, sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'vector') AS v, string_agg(channel, ',' ORDER BY channel) AS sources
 FROM (SELECT query_id, channel, id, rank FROM seeds UNION ALL SELECT query_id, 'graph', id, rank FROM g) GROUP BY ALL),
fus AS (SELECT query_id, id, coalesce(f, 0) + coalesce(gr, 0) + coalesce(v, 0) AS score, sources, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(f, 0) + coalesce(gr, 0) + coalesce(v, 0) DESC, id) AS place FROM r2 QUALIFY place <= 20),
seen AS (SELECT x.*, CASE WHEN own THEN effective_from ELSE coalesce(effective_from, document_from) END AS f0, CASE WHEN own THEN effective_to ELSE coalesce(effective_to, document_to) END AS t0, CASE WHEN own AND intent <> 'COMPARISON' THEN family END AS fam
 FROM (SELECT fus.*, contains(sources, 'graph') AND NOT contains(sources, 'fulltext') AND NOT coalesce(anchor, false) AS own FROM fus LEFT JOIN (SELECT query_id, id, anchor FROM g) USING (query_id, id)) x JOIN u USING (id) JOIN live USING (query_id) WHERE
 query_date IS NULL OR coalesce((CASE WHEN own THEN effective_from ELSE coalesce(effective_from, document_from) END) <= query_date AND ((CASE WHEN own THEN effective_to ELSE coalesce(effective_to, document_to) END) IS NULL OR (CASE WHEN own THEN effective_to ELSE coalesce(effective_to, document_to) END) > query_date), false)),
cur AS (SELECT query_id, id, score, sources FROM seen QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(fam::VARCHAR, 'u' || id) ORDER BY coalesce(f0, DATE '0001-01-01') DESC, place) = 1),
goalpaths AS (SELECT a.* FROM acc a JOIN live USING (query_id) WHERE goal IS NOT NULL AND EXISTS (SELECT 1 FROM (SELECT unnest(a.types) AS t, unnest(a.heads) AS h) x JOIN hyd ON hyd.query_id = a.query_id AND hyd.id = h WHERE t = goal)),
pin AS (SELECT query_id, id, min((a, b, c)) AS pin FROM (SELECT query_id, id, 0 AS a, rank AS b, 0 AS c FROM hyd UNION ALL SELECT query_id, id, 1, rank, c FROM (SELECT query_id, rank, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS c FROM goalpaths) WHERE (query_id, id) IN (SELECT query_id, id FROM g)) GROUP BY ALL),
fin AS (SELECT query_id, id, pin IS NOT NULL AS pinned, score, coalesce(sources, 'graph') AS sources, row_number() OVER (PARTITION BY query_id ORDER BY pin IS NULL, pin, score DESC, id) AS rank FROM cur FULL JOIN pin USING (query_id, id) QUALIFY rank <= 10)"""


def _retrieved(spark: SparkSession, sf_dir: str) -> retrieval.Retrieved:
    return retrieval.retrieve(corpus.requests(spark, sf_dir), corpus.passages(spark, sf_dir), table(spark, sf_dir, "documents"), corpus.vectors(spark, sf_dir), corpus.relations(spark, sf_dir))


@query(f"WITH RECURSIVE {FINAL_SQL} SELECT query_id, rank, id, pinned, score, sources FROM fin")
def ret6_hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET4, RET6, RET7, RET9, SET3, TOP5 to TOP7, WIN1 to WIN4: two fusions of vector, full-text and graph channels around one expansion."""
    return _retrieved(spark, sf_dir).units


@query(f"""WITH RECURSIVE {FINAL_SQL}, src AS (SELECT query_id, count(*) AS n_units, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT query_id, rank, unnest(string_split(sources, ',')) AS s FROM fin) GROUP BY query_id), nu AS (SELECT query_id, count(*) AS n_units FROM fin GROUP BY ALL),
np AS (SELECT query_id, count(*) AS n_paths FROM acc GROUP BY ALL), rej AS (SELECT query_id, count(*) FILTER (NOT ok) AS rejected FROM judged GROUP BY ALL),
c AS (SELECT query_id, coalesce(nu.n_units, 0) AS n_units, coalesce(n_paths, 0) AS n_paths, coalesce(rejected, 0) AS rejected, query_id IN (FROM decided) AS decided, query_id IN (FROM gone) AS missing, coalesce(sources, '') AS s FROM r LEFT JOIN nu USING (query_id) LEFT JOIN src USING (query_id) LEFT JOIN np USING (query_id) LEFT JOIN rej USING (query_id)),
m AS (SELECT *, CASE WHEN missing THEN 'unavailable' WHEN n_units = 0 AND n_paths = 0 THEN 'no_results' WHEN s = 'vector' AND n_paths = 0 THEN 'vector_only' WHEN s = 'fulltext' AND n_paths = 0 THEN 'fulltext_only' WHEN (contains(s, 'graph') OR n_paths > 0) AND NOT contains(s, 'fulltext') THEN 'vector_graph' ELSE 'hybrid' END AS mode FROM c)
SELECT query_id, n_units, n_paths, rejected, decided, mode, mode IN ('no_results', 'vector_only', 'fulltext_only') AS penalty FROM m""")
def ret11_retrieval_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET8, RET11, GRF3: a row for each request: units, paths, paths that its day ruled out, decided questions, mode and penalty."""
    return _retrieved(spark, sf_dir).contexts
