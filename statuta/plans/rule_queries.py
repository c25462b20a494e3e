"""Queries of routing, plans, relation checks, provider links, reconciliation, conversations and structural payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import fulltext, retrieval, rules
from statuta.operators.components import connected_components
from statuta.plans import templates as T
from statuta.plans.registry import query
from statuta.runtime import table
from statuta.sources import corpus
from statuta.sources.outlines import LAWS_SQL, laws

KEY = T.KEY
_rows, _want = T.rows, T.want


def _at(cases: list[tuple], i: int) -> list:
    return [c[i] for c in cases]


QUESTIONS = [
    ("Điều {n} là gì? {t}", "DEFINITION", "HIGH", "fulltext,vector", "LEXICAL_DEFINITION"), ("Luật sửa đổi {t} còn hiệu lực?", "VALIDITY", "HIGH", "fulltext,vector", "VERSION_CHAIN_VALIDITY"), ("Luật {t} còn hiệu lực không", "VALIDITY", "HIGH", "fulltext,vector", "CORPUS_COMPLETE_CURRENT_VALIDITY"),
    ("Khoản 2 thuộc điều nào {t}", "HIERARCHY", "HIGH", "fulltext", "STRUCTURAL_HIERARCHY"), ("văn bản nào hướng dẫn luật {t}", "HIERARCHY", "HIGH", "fulltext", "GUIDES_RELATIONS"), ("So sánh {t} và 2", "COMPARISON", "HIGH", "vector,fulltext", "MULTIPLE_VERSIONS"), ("{t} dẫn chiếu đến điều nào", "MULTI_HOP", "LOW", "vector,fulltext", "SEMANTIC_MULTI_HOP_GRAPH"), ("thuế {t}", None, None, "vector,fulltext", None),
]


@query(_want(intent=_at(QUESTIONS, 1), confidence=_at(QUESTIONS, 2), channels=_at(QUESTIONS, 3), capability=_at(QUESTIONS, 4)))
def rte4_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RTE1, RTE4, RTE5, RET12: the rule's intent, its channels in order, and the capability that it needs."""
    t = F.col("text")
    r = _rows(spark, sf_dir, text=_at(QUESTIONS, 0)).withColumn("r", rules.question_rule(t))
    intent = F.coalesce("r.intent", F.lit("FACTUAL"))
    return r.select(KEY, "r.intent", "r.confidence", F.array_join(retrieval.channels_of(intent), ",").alias("channels"), rules.required_capability(intent, t, F.lit(True)).alias("capability"))


CONTRACTS = [("a:;b:a;c:a,b", None), ("{h}:;{h}:", "duplicate:{h}"), ("a:{h};{h}:", "not_preceding:{h}"), ("", "no_subqueries"), ("{h}:;b:{h}", None), ("a:a", "not_preceding:a")]


@query(_want(fault=_at(CONTRACTS, 1)))
def rte7_plan_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RTE6, RTE7: sub-questions may need only earlier ones; limits are checked where they are set."""
    retrieval.Limits(candidates=50, final=10)
    parts = F.filter(F.split("text", ";"), lambda s: s != "")
    subs = F.transform(parts, lambda s: F.struct(F.substring_index(s, ":", 1).alias("id"), F.filter(F.split(F.substring_index(s, ":", -1), ","), lambda d: d != "").alias("depends_on")))
    return _rows(spark, sf_dir, text=_at(CONTRACTS, 0)).select(KEY, rules.plan_contract(subs).alias("fault"))


SHAPES = [
    ("Article", "REFERS_TO:outgoing:Article;CONTAINS:outgoing:Clause", None), ("Article", "CONTAINS:outgoing:Clause", "depth"), (None, "CONTAINS:outgoing:Point;REFERS_TO:outgoing:Clause", None), ("Clause", "CONTAINS:incoming:Article;CONTAINS:incoming:Chapter", "target_label"),
    ("Clause", "CONTAINS:outgoing:Article;REFERS_TO:outgoing:Clause", "step_1"), ("Article", "REFERS_TO:outgoing:Clause;DEFINES:outgoing:LegalConcept;REQUIRES:incoming:LegalSubject", None), ("Article", "REFERS_TO:outgoing:Clause;ISSUED_BY:outgoing:Article", "step_2"),
]


@query(_want(fault=_at(SHAPES, 2)))
def pln2_plan_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN1, PLN2: two or three steps that the ontology allows, ending at a citable or liftable kind."""
    part = F.transform(F.split("steps", ";"), lambda s: F.struct(F.split(s, ":")[0].alias("relation"), F.split(s, ":")[1].alias("direction"), F.split(s, ":")[2].alias("label")))
    return _rows(spark, sf_dir, anchor=_at(SHAPES, 0), steps=_at(SHAPES, 1)).select(KEY, rules.plan_shape(F.col("anchor"), part).alias("fault"))


ENDS = [
    ("Khoản 2 Điều 1", "Clause", "own", "RESOLVED", None, "d{n}_art1_cl2"), ("khoản  9 điều 1", None, "own", "UNBOUND", "no_match", None), ("Điều 2", "Clause", "own", "UNBOUND", "label_differs", None), ("Điều 2", None, "none", "AMBIGUOUS", "scope_required", None),
    ("theo Điều 2 {t}", None, "own", "UNBOUND", "unsupported_mention", None), ("Điểm B khoản 1 điều 1", None, "own", "RESOLVED", None, "d{n}_art1_cl1_pb"), ("Điều 1", "Article", "own", "RESOLVED", None, "d{n}_art1"),
]


@query(f"""WITH {LAWS_SQL}, w AS ({_want(status=_at(ENDS, 3), reason=_at(ENDS, 4), target=_at(ENDS, 5))}), e AS (SELECT {KEY}, CASE WHEN target IS NOT NULL AND id IS NULL THEN 'UNBOUND' ELSE status END AS status, CASE WHEN target IS NOT NULL AND id IS NULL THEN 'no_match' ELSE reason END AS reason, id AS target FROM w LEFT JOIN laws ON id = target)
SELECT {KEY}, status, reason, target, CASE WHEN status <> 'RESOLVED' THEN status || '_ANCHOR' WHEN {KEY} % 2 = 0 THEN 'UNBOUND_TARGET' ELSE 'BOUND' END AS binding FROM e""")
def pln4_structural_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN3, PLN4, PLN6: whole mentions, what they name in the scope, and plans bound at both ends."""
    doc = F.concat(F.lit("d"), F.col(KEY).cast("string"))
    rows = _rows(spark, sf_dir, mention=_at(ENDS, 0), expected=_at(ENDS, 1), kind=_at(ENDS, 2)).withColumn("scope", F.when(F.col("kind") == "own", F.array(doc)).otherwise(F.array().cast("array<string>")))
    keys = laws(spark, sf_dir).where("kind in ('Article', 'Clause', 'Point')").select("document_id", F.col("kind").alias("label"), "article", "clause", "point", "id")
    found = rules.structural_endpoints(rows, keys, "mention", "expected", "scope")
    other = F.when(F.col(KEY) % 2 == 0, "UNBOUND").otherwise("RESOLVED")
    return found.select(KEY, "status", "reason", "target", rules.binding(F.col("status"), other).alias("binding"))


PLANS = [
    ("Khoản 3 Điều {n} dẫn đến khoản nào về thuế?", "Khoản 3 Điều {n}", "Clause", "khoản nào về thuế", "REFERS_TO>Article,CONTAINS>Clause"), ("Từ Điều {n}, lần theo các dẫn chiếu {t}", "Điều {n}", "Article", "Khoản 1 Điều {n}", "REFERS_TO>Clause,REFERS_TO>Clause"), ("Điều {n} nói gì? {t}", None, None, None, None), ("không có {t}", None, None, None, None),
]


@query(_want(anchor=_at(PLANS, 1), label=_at(PLANS, 2), target=_at(PLANS, 3), steps=_at(PLANS, 4)))
def pln8_rule_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _rows(spark, sf_dir, text=_at(PLANS, 0)).select(KEY, rules.rule_plan(F.col("text")).alias("p"))
    return p.select(KEY, "p.anchor", F.col("p.anchor_label").alias("label"), "p.target", F.array_join("p.steps", ",").alias("steps"))


@query("""WITH h AS (SELECT doc_id // 30 AS query_id, c AS channel, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Article' WHEN doc_id % 3 = 1 THEN 'Clause' ELSE 'Appendix' END AS label, CASE WHEN doc_id % 3 < 2 THEN doc_id - doc_id % 3 END AS article_id,
 row_number() OVER (PARTITION BY doc_id // 30, c ORDER BY doc_id * CASE c WHEN 'vector' THEN 7 ELSE 11 END % 31, doc_id) AS rank FROM documents, (VALUES ('vector'), ('fulltext')) t(c) WHERE c = 'vector' OR doc_id % 3 = 0),
d AS (SELECT DISTINCT query_id, id AS u, article_id AS art FROM h WHERE label = 'Clause'),
s AS (SELECT query_id, channel, rank, id AS u FROM h WHERE label = 'Clause' UNION ALL SELECT query_id, channel, rank, u FROM h JOIN d USING (query_id) WHERE label = 'Article' AND art = id)
SELECT query_id, u AS id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources FROM s GROUP BY ALL""")
def ret5_endpoint_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET5: clauses credited by their own hits and by those of their articles."""
    i = F.col("doc_id")
    both = table(spark, sf_dir, "documents").select(i, F.explode(F.array(F.lit("vector"), F.lit("fulltext"))).alias("channel")).where("channel = 'vector' or doc_id % 3 = 0")
    order = Window.partitionBy("query_id", "channel").orderBy(i * F.when(F.col("channel") == "vector", 7).otherwise(11) % 31, i)
    hits = both.withColumn("query_id", F.floor(i / 30)).select("query_id", "channel", i.alias("id"), F.when(i % 3 == 0, "Article").when(i % 3 == 1, "Clause").otherwise("Appendix").alias("label"), F.when(i % 3 < 2, i - i % 3).alias("article_id"), F.row_number().over(order).alias("rank"))
    return rules.endpoint_fusion(hits, "Clause")


RELATIONS = [
    ("AMENDED_BY", "Document", "Document", "a", "b", "", "legacy:AMENDS", "hard_fail", "ontology_invalid"), ("KNOWS", "Document", "Document", "a", "b", "", "unknown_relation", "hard_fail", "ontology_invalid"), ("CONTAINS", "Article", "Point", "a", "b", "", "pair", "hard_fail", "ontology_invalid"),
    ("AMENDS", "Clause", "Article", "a", "a", "effective_from=2020", "self_loop", "hard_fail", "ontology_invalid"), ("AMENDS", "Clause", "Article", "a", "b", "", "missing:effective_from", "hard_fail", "ontology_invalid"), ("AMENDS", "Clause", "Article", "a", "b", "effective_from=2020", None, "valid", None),
    ("REFERS_TO", "Document", "Article", "a", "z{h}", "citation_text=x;citation_type=DIRECT;extraction_method=RULE;created_at=t;reference_bundle_id=b;reference_target_count=1", None, "review", "missing_external_document_registry"),
    ("REFERS_TO", "Clause", "Article", "a", "b", "citation_text=x;citation_type=ODD;extraction_method=RULE;created_at=t;reference_bundle_id=b;reference_target_count=1", "citation_type", "hard_fail", "ontology_invalid"), ("DEFINES", "Article", "LegalConcept", "a", "z{h}", "confidence=1;llm_model=m;created_at=t", None, "hard_fail", "unresolved_local_endpoint"),
    ("DEFINES", "Point", "LegalConcept", "a", "b", "confidence=1;created_at=t", "missing:llm_model", "hard_fail", "ontology_invalid"), ("GUIDES", "Document", "Document", "a", "b", "", None, "valid", None),
]


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    names = ("relation", "head", "tail", "head_id", "tail_id", "properties")
    rows = _rows(spark, sf_dir, **{n: _at(RELATIONS, i) for i, n in enumerate(names)})
    rows = rows.withColumn("properties", F.when(F.col("properties") == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map("properties", F.lit(";"), F.lit("="))))
    return rows, rules.extraction_error(*[F.col(n) for n in names])


@query(_want(error=_at(RELATIONS, 6), state=_at(RELATIONS, 7), reason=_at(RELATIONS, 8)))
def val5_relation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL1, VAL5, VAL7: faults of extracted relations by the ontology, and what becomes of the records."""
    rows, error = _relations(spark, sf_dir)
    r = rows.withColumn("error", error)
    dated = F.try_element_at("properties", F.lit("effective_from")).isNotNull()
    state = rules.record_consistency(*[F.col(c) for c in ("relation", "head", "tail", "head_id", "tail_id")], dated, F.array(F.lit("a"), F.lit("b")), F.col("error").isNull())
    return r.withColumn("s", state).select(KEY, "error", "s.state", "s.reason")


@query(f"WITH e AS ({_want(error=_at(RELATIONS, 6), state=_at(RELATIONS, 7))}), s AS (SELECT *, round(0.3 + CASE WHEN error IS NULL THEN 0.4 ELSE 0 END + 0.2 * (CASE WHEN {KEY} % 2 = 0 THEN 1.0 ELSE 0.5 END) + 0.1, 6)::DOUBLE AS confidence FROM e) SELECT {KEY}, confidence, CASE WHEN state = 'hard_fail' THEN 'rejected' WHEN state = 'review' THEN 'review' WHEN confidence >= 0.8 THEN 'accepted' ELSE 'review' END AS decision FROM s")
def val8_record_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL8: extracted relations checked, scored by their evidence and decided."""
    from statuta.functions import legal
    from statuta.operators import decisions

    rows, error = _relations(spark, sf_dir)
    r = rows.withColumn("error", error)
    dated = F.try_element_at("properties", F.lit("effective_from")).isNotNull()
    state = rules.record_consistency(*[F.col(c) for c in ("relation", "head", "tail", "head_id", "tail_id")], dated, F.array(F.lit("a"), F.lit("b")), F.col("error").isNull())["state"]
    evidence = legal.evidence_presence(F.when(F.col(KEY) % 2 == 0, "the words stand").otherwise("the nowhere"), F.lit("here the words stand so"))
    score = F.round(decisions.confidence(F.lit(True), F.col("error").isNull(), F.col("error").isNull(), evidence, F.lit(1.0)), 6)
    gate = F.when(state == "review", "review").otherwise(decisions.gate(state == "valid", score, F.lit(False)))
    return r.select(KEY, score.alias("confidence"), gate.alias("decision"))


@query(f"""WITH {LAWS_SQL}, s AS (SELECT *, document_id[2:]::BIGINT % 4 AS k FROM laws) SELECT id, 'runtime_only' AS error FROM s WHERE k = 0 AND point = 'a' UNION ALL SELECT parent_id || '>' || id, 'unknown_tail' FROM s WHERE k = 0 AND point = 'a' UNION ALL SELECT id, 'duplicate' FROM s WHERE k = 1 AND kind = 'Article' AND article = '2'
UNION ALL SELECT id || '_ch1>' || id, CASE WHEN id || '_ch1' IN (SELECT id FROM laws) THEN 'pair' ELSE 'unknown_head' END FROM s WHERE k = 2 AND kind = 'Document' UNION ALL SELECT 'lost>' || id, 'unknown_head' FROM s WHERE k = 3 AND kind = 'Document' UNION ALL SELECT id || '>' || id, 'self_loop' FROM s WHERE k = 3 AND kind = 'Document'""")
def val4_payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL4, VAL6: all faults of payloads with planted ones of each kind."""
    u = laws(spark, sf_dir).select("id", "kind", "parent_id", F.substr("document_id", F.lit(2)).cast("long").alias("n"))
    k = F.col("n") % 4
    nodes = u.withColumn("kind", F.when((k == 0) & F.endswith("id", F.lit("_pa")), "Obligation").otherwise(F.col("kind")))
    nodes = nodes.unionByName(nodes.where((k == 1) & F.endswith("id", F.lit("_art2"))))
    own = u.where("parent_id is not null").select(F.col("parent_id").alias("head_id"), F.lit("CONTAINS").alias("type"), F.col("id").alias("tail_id"))
    d = u.where("kind = 'Document'")
    planted = d.where(k == 2).select(F.concat("id", F.lit("_ch1")).alias("head_id"), F.lit("CONTAINS").alias("type"), F.col("id").alias("tail_id")).unionByName(d.where(k == 3).select(F.explode(F.array(F.lit("lost"), F.col("id"))).alias("head_id"), F.lit("AMENDS").alias("type"), F.col("id").alias("tail_id")))
    return rules.payload_errors(nodes.select("id", "kind"), own.unionByName(planted))


@query("SELECT p_brand, p_size, min(p_type) AS p_type FROM part WHERE p_type IS NOT NULL GROUP BY p_brand, p_size HAVING count(DISTINCT p_type) = 1")
def ref13_identity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF13: keys that stand for one value only."""
    return rules.identity_index(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_type")


UNITS = [
    ("Document", "d{n}", "d{n}", None, None, "{t}", None), ("Document", "d{n}", "d{n}", "a", None, "x", "hierarchy_ids"), ("Article", "d{n}_art1", "d{n}", "d{n}_art1", None, "{t}", None), ("Clause", "d{n}_cl1", "d{n}", None, "d{n}_cl1", "x", "hierarchy_ids"), ("Appendix", "d{n}_app", "d{n}", None, None, " ", "blank_content"), ("Article", "D {h}", "d{n}", "D {h}", None, "{t}", "unit_id"), ("Point", "{h}_p", "d{n}", "a", "c", "{t}", None),
]


@query(_want(fault=_at(UNITS, 6)))
def flt14_evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("label", "id", "document_id", "article_id", "clause_id", "content")
    r = _rows(spark, sf_dir, **{n: _at(UNITS, i) for i, n in enumerate(names)})
    return r.select(KEY, rules.evidence_contract({n: F.col(n) for n in names} | {"citation": F.lit("c")}).alias("fault"))


@query(f"WITH RECURSIVE {LAWS_SQL}, c AS (SELECT id, id AS chain FROM laws WHERE parent_id IS NULL UNION ALL SELECT l.id, chain || '>' || l.id FROM laws l JOIN c ON l.parent_id = c.id) SELECT id, chain FROM c")
def grf20_ancestor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF6, GRF20, AGG14: chains of any depth, by doubling."""
    return rules.ancestor_chains(laws(spark, sf_dir))


@query(f"WITH {LAWS_SQL} SELECT DISTINCT parent_id AS head_id, 'CONTAINS' AS type, id AS tail_id, sha1(parent_id || '|CONTAINS|' || id || '|') AS relation_id FROM laws WHERE parent_id IS NOT NULL")
def grf16_containment_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF16: a tree's containment with relation ids; no node may come with two contents."""
    return rules.containment_payload(laws(spark, sf_dir))


@query(f"WITH {LAWS_SQL} SELECT id FROM laws WHERE kind = 'Article' AND article LIKE '%1' AND document_id[2:]::BIGINT % 2 = 1")
def grf16_payload_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = laws(spark, sf_dir).select("id", "kind", "parent_id")
    odd = F.regexp_extract("id", r"^d(\d+)", 1).cast("long") % 2 == 1
    twin = u.where(odd & F.col("id").rlike("_art[0-9]*1$")).withColumn("parent_id", F.lit("other"))
    issuer = u.limit(0).unionByName(u.where("kind = 'Document'").select(F.lit("issuer").alias("id"), F.lit("Issuer").alias("kind"), F.col("id").alias("parent_id")))
    return rules.payload_conflicts(u.unionByName(twin).unionByName(issuer))


@query(f"""WITH {LAWS_SQL} SELECT document_id || '_inst1' || substr(id, length(document_id) + 1) AS id, CASE WHEN parent_id = document_id THEN document_id || '_inst1' ELSE document_id || '_inst1' || substr(parent_id, length(document_id) + 1) END AS parent_id, kind FROM laws WHERE kind <> 'Document'""")
def grf17_owner_scoped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF17: a document's tree under an instrument attached to it."""
    u = laws(spark, sf_dir).withColumn("owner", F.concat("document_id", F.lit("_inst1")))
    return rules.owner_scoped(u, "owner").select("id", "parent_id", "kind")


@query(f"WITH {LAWS_SQL} SELECT count(DISTINCT document_id) AS components, count(*) AS nodes FROM laws")
def grf9_payload_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF9: components of a payload, lone nodes counted."""
    u = laws(spark, sf_dir)
    parts = connected_components(u.where("parent_id is not null").select(F.xxhash64("parent_id").alias("src"), F.xxhash64("id").alias("dst")))
    return u.select(F.xxhash64("id").alias("node")).join(parts, "node", "left").agg(F.count_distinct(F.coalesce("component", "node")).alias("components"), F.count(F.lit(1)).alias("nodes"))


@query("""WITH k AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || 'a' WHEN 1 THEN 'B' || s_suppkey ELSE s_suppkey::VARCHAR END AS number, s_nationkey AS nation FROM supplier)
SELECT s_suppkey, number, row_number() OVER (PARTITION BY nation ORDER BY CASE WHEN s_suppkey % 3 = 1 THEN 1000000000 ELSE s_suppkey END, lower(number), s_suppkey) AS rank FROM k""")
def top12_browser_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP12: numbers by their leading digits, those without last, then by text."""
    k, n = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(k == 0, F.concat(n, F.lit("a"))).when(k == 1, F.concat(F.lit("B"), n)).otherwise(n).alias("number"))
    lead = F.regexp_extract("number", r"^(\d+)", 1)
    order = Window.partitionBy("s_nationkey").orderBy(F.when(lead != "", lead.cast("long")).otherwise(10**9), F.lower("number"), "s_suppkey")
    return rows.select("s_suppkey", "number", F.row_number().over(order).alias("rank"))


@query(f"""WITH {LAWS_SQL}, g AS (SELECT document_id, document_id[2:]::BIGINT % 3 AS k, count(parent_id) AS edges, count(*) FILTER (kind = 'Part') AS parts FROM laws GROUP BY ALL) SELECT document_id, CASE WHEN k = 2 OR edges = 0 THEN NULL ELSE k = 0 OR parts = 0 END AS hit FROM g""")
def evl10_hierarchy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL10: whether every expected hierarchy edge is among the observed ones; null where none is expected."""
    u = laws(spark, sf_dir)
    seen = rules.containment_payload(u).select("head_id", "tail_id").withColumn("ok", F.lit(True))
    n = F.substr("document_id", F.lit(2)).cast("long") % 3
    gold = u.where((F.col("parent_id").isNotNull()) & (n < 2)).select("document_id", F.when((n == 1) & (F.col("kind") == "Part"), "lost").otherwise(F.col("parent_id")).alias("head_id"), F.col("id").alias("tail_id"))
    hits = gold.join(seen, ["head_id", "tail_id"], "left").groupBy("document_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("hit"))
    return u.where("kind = 'Document'").select("document_id").join(hits, "document_id", "left")


@query("SELECT event_type, count(*) AS cases, avg((value > 20)::INT) AS rate, avg((value > 20)::INT) >= 0.4 AND count(*) >= 10 AND avg((value > 1000)::INT) <= 0.0 AS accepted FROM events GROUP BY event_type")
def evl12_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL12, EVL16: a profile passes if every rate keeps its bound."""
    rate, extra = F.avg((F.col("value") > 20).cast("int")), F.avg((F.col("value") > 1000).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("cases"), rate.alias("rate"), ((rate >= 0.4) & (F.count(F.lit(1)) >= 10) & (extra <= 0.0)).alias("accepted"))


@query(f"""WITH {corpus.CORPUS_SQL}, s AS (SELECT query_id, u.label, u.id, round(list_cosine_similarity(embedding::DOUBLE[], vector::DOUBLE[]), 12) AS score FROM r, embeddings JOIN u ON u.id = vec_id WHERE vector IS NOT NULL)
SELECT query_id, label AS index, id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3""")
def evl17_vector_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL17: the three nearest of fixed questions in each of the three vector indexes."""
    asked = corpus.requests(spark, sf_dir).select("query_id", F.col("vector").alias("q")).where("q is not null")
    return fulltext.vector_candidates(corpus.vectors(spark, sf_dir), asked, 3, "label", own=True).select("query_id", F.col("kind").alias("index"), "id", "score", "rank")
