"""Queries of readiness, batches, diagrams, rewriting, structural soundness and artifact checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import consistency, hierarchy, rules
from statuta.plans.registry import query
from statuta.plans.rule_queries import KEY, _at, _rows, _want
from statuta.runtime import table
from statuta.sources import markup
from statuta.sources.outlines import LAWS_SQL, laws

METADATA = [
    ("L1", "d{n}", "1/2020", "Law", "Quốc hội {t}", "2020-01-01", ""), ("{h}", "d{n}", "1/2020", "Law", "{t}", "2020-01-01", "mismatch:code"), ("L1", "{h}", "1/2020", "{t}", "", "2020-01-01", "mismatch:graph_id,mismatch:doc_type,missing:issuer"), ("", "", None, None, "Quốc hội", None, "missing:issued"),
]


@query(_want(errors=_at(METADATA, 6)))
def val11_document_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL11, VAL18: metadata against the manifest and its required fields."""
    names = ("code", "graph_id", "number", "doc_type", "issuer", "issued")
    r = _rows(spark, sf_dir, **{n: _at(METADATA, i) for i, n in enumerate(names)})
    manifest = {"code": F.lit("L1"), "graph_id": F.concat(F.lit("d"), F.col(KEY).cast("string")), "number": F.lit("1/2020"), "doc_type": F.lit("Law")}
    return r.select(KEY, F.array_join(rules.readiness_errors({n: F.col(n) for n in names}, manifest), ",").alias("errors"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS extract, count(*) FILTER (l_returnflag = 'N') AS accepted, count(*) FILTER (l_returnflag = 'A') AS review, count(*) FILTER (l_returnflag = 'R') AS rejected, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN l_suppkey % 7 = 0 THEN 'ontology_version' WHEN l_suppkey % 5 = 0 THEN 'smoke_subset' WHEN l_suppkey % 3 = 0 AND rejected > 0 THEN 'counts_differ' WHEN accepted = 0 THEN 'nothing_accepted' END AS fault FROM c""")
def val12_extraction_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL12: extractions of the present ontology, of whole documents, whose decisions add up."""
    k, flag = F.col("l_suppkey"), F.col("l_returnflag")
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("extract"), F.count_if(flag == "N").alias("accepted"), F.count_if(flag == "A").alias("review"), F.count_if(flag == "R").alias("all_rejected"), F.count_distinct("l_partkey").alias("entities"))
    c = c.withColumn("rejected", F.when(k % 3 == 0, 0).otherwise(F.col("all_rejected")))
    fault = rules.extraction_readiness({n: F.col(n) for n in ("extract", "accepted", "review", "rejected")}, k % 5 != 0, F.when(k % 7 == 0, "1.14.0").otherwise("1.15.0"), "1.15.0", F.col("entities"))
    return c.select("l_suppkey", fault.alias("fault"))


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'r' || (p_partkey - p_partkey % 20) ELSE 'r' || p_partkey END AS relation_id FROM part),
e AS (SELECT relation_id, 'type' AS error FROM p WHERE k % 11 = 0 UNION ALL SELECT relation_id, 'head' FROM p WHERE k % 7 = 0 UNION ALL SELECT relation_id, 'no_candidate' FROM p WHERE k % 13 = 0 UNION ALL SELECT relation_id, 'wrapper' FROM p WHERE k % 17 = 0 OR k % 13 = 0 UNION ALL SELECT relation_id, 'effective_from' FROM p WHERE k % 19 = 0
 UNION ALL SELECT relation_id, 'duplicate_relation_id' FROM p GROUP BY relation_id HAVING count(*) > 1) SELECT relation_id, error, count(*) AS n FROM e GROUP BY ALL""")
def val14_provider_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL14: all faults of a batch of temporal relations, and ids that come twice."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), F.when(k % 10 == 0, k - k % 20).otherwise(k).cast("string")).alias("relation_id"), F.when(k % 13 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("candidate_id"), F.when(k % 17 == 0, "other").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("wrapped_id"),
        F.when(k % 11 == 0, "GUIDES").otherwise("AMENDS").alias("type"), F.when(k % 7 == 0, "Chapter").otherwise("Clause").alias("head"), F.lit("Article").alias("tail"), F.when(k % 19 != 0, "2020-01-01").alias("effective_from"),
    )
    return rules.provider_batch_errors(p).groupBy("relation_id", "error").agg(F.count(F.lit(1)).alias("n"))


DIAGRAMS = [
    ("AMENDS", "DIAGRAM", "Law", "Decree", "true", None, "valid", None, "2021-01-01"), ("AMENDS", "DIAGRAM", "Law", "Decree", "false", None, "review", "temporal_metadata_incomplete", None), ("REPLACES", "DIAGRAM", "Law", "Law", "false", "2019-05-01", "valid", None, "2019-05-01"), ("GUIDES", "DIAGRAM", "Law", "Decree", "true", None, "valid", None, None),
    ("GUIDES", "DIAGRAM", "Circular", "Law", "true", None, "rejected", "guides_pair", None), ("REFERS_TO", "DIAGRAM", "Law", "Law", "true", None, "rejected", "unsupported_diagram_relation", None), ("AMENDS", "LLM", "Law", "Law", "true", None, "rejected", "unsupported_diagram_relation", None), ("AMENDS", "DIAGRAM", "Law", None, "true", None, "review", "unresolved_diagram_target", None),
]


@query(_want(state=_at(DIAGRAMS, 6), reason=_at(DIAGRAMS, 7), effective=_at(DIAGRAMS, 8)))
def val16_diagram_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("relation", "method", "head", "tail", "own", "effective")
    r = _rows(spark, sf_dir, **{n: _at(DIAGRAMS, i) for i, n in enumerate(names)})
    d = rules.diagram_record(F.col("relation"), F.col("method"), F.col("head").isNotNull(), F.col("tail").isNotNull(), F.col("head"), F.col("tail"), F.col("own") == "true", F.col("effective"), F.lit("2021-01-01"), [("Law", "Decree"), ("Decree", "Circular"), ("Law", "Circular")])
    return r.withColumn("d", d).select(KEY, "d.s.state", "d.s.reason", F.col("d.effective_from").alias("effective"))


ASKED = [("điều này quy định gì {t}", "Điều {n} Luật 5", "gì", "Điều {n} Luật 5 quy định gì {t}"), ("{t} Khoản đó và điều đó", "Khoản 2 $1", "điều", "{t} Khoản 2 $1 và điều đó"), ("điều này với Luật 9 {t}", "Điều 3", "điều này", "điều này với Luật 9 {t}"), ("thuế {t}", None, "thuế", "thuế {t}")]


@query(_want(question=_at(ASKED, 3)))
def ref21_rewritten_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF16, REF21: references back replaced by what they mean, if the anchors stay."""
    r = _rows(spark, sf_dir, text=_at(ASKED, 0), label=_at(ASKED, 1), keep=_at(ASKED, 2))
    return r.select(KEY, rules.rewritten(F.col("text"), F.col("label"), F.array("keep")).alias("question"))


@query(f"""WITH {LAWS_SQL}, s AS (SELECT DISTINCT document_id[2:]::BIGINT AS k FROM laws), f AS (SELECT k, i FROM s, range(5) t(i) WHERE k % 4 = 0), two AS (SELECT id, document_id[2:]::BIGINT AS k FROM laws WHERE kind = 'Article' AND article = '2')
SELECT 'y' || k || '_' || i AS id, p AS problem FROM f, (VALUES ('cycle'), ('invalid_pair'), ('no_parent')) v(p) UNION ALL SELECT id, 'no_parent' FROM two WHERE k % 4 = 1 UNION ALL SELECT 'd' || k || '_art1_cl1', 'several_parents' FROM two WHERE k % 4 = 2""")
def grf7_structure_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF7 whole: cycles of any length (five clauses in a ring), lost and shared units, pairs, child kinds and order."""
    u = laws(spark, sf_dir).select("id", "kind", "parent_id", F.coalesce("point", "clause", "article", "subsection", "section", "chapter", "part", F.lit("")).alias("number"), F.substr("document_id", F.lit(2)).cast("long").alias("n"))
    k = F.col("n") % 4
    ring = u.where((F.col("kind") == "Document") & (k == 0)).select("n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))

    def name(i):
        return F.concat(F.lit("y"), F.col("n").cast("string"), F.lit("_"), i.cast("string"))

    nodes = u.select("id", F.col("kind").alias("label"), "number").unionByName(ring.select(name(F.col("i")).alias("id"), F.lit("Clause").alias("label"), F.col("i").cast("string").alias("number")))
    own = u.where(F.col("parent_id").isNotNull() & ~((k == 1) & F.endswith("id", F.lit("_art2")))).select(F.col("parent_id").alias("head_id"), F.col("id").alias("tail_id"))
    more = u.where((k == 2) & F.endswith("id", F.lit("_art2"))).select(F.col("id").alias("head_id"), F.concat(F.regexp_replace("id", "_art2$", "_art1"), F.lit("_cl1")).alias("tail_id"))
    loop = ring.select(name(F.col("i")).alias("head_id"), name((F.col("i") + 1) % 5).alias("tail_id"))
    found = hierarchy.structure_problems(nodes, own.unionByName(more).unionByName(loop))
    return found.where("problem not like 'order%'")


@query(f"WITH RECURSIVE {LAWS_SQL}, c AS (SELECT parent_id AS ancestor_id, id, 1 AS depth FROM laws WHERE parent_id IS NOT NULL UNION ALL SELECT l.parent_id, c.id, depth + 1 FROM c JOIN laws l ON l.id = c.ancestor_id WHERE l.parent_id IS NOT NULL) SELECT ancestor_id, count(*) AS units, max(depth)::BIGINT AS depth, bool_or(laws.kind = 'Article') AS has_article FROM c JOIN laws USING (id) GROUP BY ancestor_id")
def grf6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF6 whole, JON1: every unit's descendants at any depth, and whether an article is among them."""
    u = laws(spark, sf_dir)
    chain = rules.ancestor_chains(u).withColumn("up", F.split("chain", ">"))
    pairs = chain.select("id", F.size("up").alias("n"), F.posexplode("up").alias("at", "ancestor_id")).where("ancestor_id <> id")
    return pairs.join(u.select("id", "kind"), "id").groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("units"), F.max(F.col("n") - 1 - F.col("at")).cast("long").alias("depth"), F.bool_or(F.col("kind") == "Article").alias("has_article"))


@query(f"""WITH {LAWS_SQL}, a AS (SELECT * FROM laws) SELECT a.id, CASE WHEN a.kind = 'Document' THEN 'Document' WHEN a.kind = 'Appendix' THEN 'Appendix' WHEN a.kind = 'Article' THEN 'Article' ELSE 'Clause' END AS label, CASE WHEN a.kind = 'Article' THEN a.id WHEN p.kind = 'Article' THEN p.id END AS article_id, CASE WHEN a.kind = 'Clause' THEN a.id END AS clause_id,
CASE WHEN a.kind = 'Article' THEN a.article WHEN p.kind = 'Article' THEN p.article END AS article_number, a.document_id FROM a LEFT JOIN laws p ON p.id = a.parent_id WHERE a.kind IN ('Document', 'Appendix', 'Article', 'Clause')""")
def flt10_unit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10, FLT11, JON2: citable units with the ids and numbers of the articles above them."""
    u = laws(spark, sf_dir)
    p = u.where("kind = 'Article'").select(F.col("id").alias("parent_id"), F.col("id").alias("_id"), F.col("article").alias("_n"))
    kind, own = F.col("kind"), F.col("kind") == "Article"
    rows = u.where(kind.isin("Document", "Appendix", "Article", "Clause")).join(p, "parent_id", "left")
    return rows.select("id", F.when(kind.isin("Document", "Appendix", "Article"), kind).otherwise("Clause").alias("label"), F.when(own, F.col("id")).otherwise(F.col("_id")).alias("article_id"), F.when(kind == "Clause", F.col("id")).alias("clause_id"), F.when(own, F.col("article")).otherwise(F.col("_n")).alias("article_number"), "document_id")


@query("SELECT page_id, trim(regexp_replace('Tiêu đề ' || url, '[ ]+', ' ', 'g')) AS title, page_id || '/2020/QH14' AS number, CASE WHEN page_id % 2 = 0 THEN 'Luật' END AS kind FROM pages")
def src14_detail_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC13, SRC14: labelled rows of a detail page, one column for each label, null where the page has none."""
    k = F.col("page_id").cast("string")
    page = F.concat(F.lit("<table><tr><td>Tên văn bản</td><td>Tiêu đề "), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td></tr><tr><th>Số hiệu</th><td> "), k, F.lit("/2020/QH14 </td></tr>"), F.when(F.col("page_id") % 2 == 0, "<tr><td>Loại</td><td>Luật</td></tr>").otherwise(""), F.lit("</table>"))
    p = table(spark, sf_dir, "pages").select("page_id", page.alias("html"))
    v = markup.properties(p, "page_id", "html")
    fields = {"title": "Tên văn bản", "number": "Số hiệu", "kind": "Loại"}
    return v.groupBy(F.col("id").alias("page_id")).agg(*[F.max(F.when(F.col("key") == label, F.col("value"))).alias(name) for name, label in fields.items()])


@query(f"WITH {LAWS_SQL}, g AS (SELECT id, kind, sha256(coalesce(parent_id, '')) AS h FROM laws), a AS (SELECT id, kind, CASE WHEN kind = 'Point' THEN 'old' ELSE h END AS h FROM g WHERE kind <> 'Part' UNION ALL SELECT id || 'x', kind, h FROM g WHERE kind = 'Appendix') SELECT coalesce(a.kind, g.kind) AS kind, CASE WHEN g.id IS NULL THEN 'not_in_graph' WHEN a.id IS NULL THEN 'not_in_artifact' WHEN a.h <> g.h THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN g ON a.id = g.id GROUP BY ALL")
def evl14_artifact_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL14, JON18: a stored artifact against the graph: units that differ, by kind."""
    g = laws(spark, sf_dir).select("id", "kind", F.sha2(F.coalesce("parent_id", F.lit("")).cast("binary"), 256).alias("h"))
    a = g.where("kind <> 'Part'").withColumn("h", F.when(F.col("kind") == "Point", "old").otherwise(F.col("h"))).unionByName(g.where("kind = 'Appendix'").withColumn("id", F.concat("id", F.lit("x"))))
    both = a.select("id", F.col("kind").alias("ak"), F.col("h").alias("ah")).join(g, "id", "full_outer")
    state = F.when(F.col("h").isNull(), "not_in_graph").when(F.col("ah").isNull(), "not_in_artifact").when(F.col("ah") != F.col("h"), "changed").otherwise("same")
    return both.groupBy(F.coalesce("ak", "kind").alias("kind"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


PARSED_SQL = f"""{LAWS_SQL}, b AS (SELECT document_id[2:]::BIGINT AS doc_id, document_id[2:]::BIGINT % 8 AS k, kind, CASE kind WHEN 'Part' THEN part WHEN 'Section' THEN section ELSE article END AS number, CASE WHEN kind <> 'Part' THEN part END AS part, chapter, CASE WHEN kind = 'Article' THEN section END AS section, NULL::VARCHAR AS subsection FROM laws WHERE kind IN ('Part', 'Section', 'Article')),
c AS (SELECT doc_id, k, kind, number, part, CASE WHEN kind = 'Part' THEN NULL ELSE chapter END AS chapter, CASE WHEN k = 6 AND kind = 'Article' AND number = '1' THEN NULL ELSE section END AS section, CASE WHEN kind = 'Article' AND number = '1' AND k IN (6, 7) THEN '7' END AS subsection FROM b WHERE NOT (k = 2 AND kind = 'Part') AND NOT (k = 3 AND kind = 'Section' AND number = '2')
 UNION ALL SELECT * FROM b WHERE k = 1 AND kind = 'Article' AND number = '1'
 UNION ALL SELECT doc_id, k, 'Subsection', '1', '1', 'I', '9', NULL FROM b WHERE k = 4 AND kind = 'Part' AND number = '1' UNION ALL SELECT doc_id, k, 'Subsection', '1', '1', 'I', '1', NULL FROM b, range(2) WHERE k = 5 AND kind = 'Part' AND number = '1')"""


@query(f"""WITH {PARSED_SQL}, part AS (SELECT DISTINCT doc_id, number FROM c WHERE kind = 'Part'), sec AS (SELECT DISTINCT doc_id, part, chapter, number FROM c WHERE kind = 'Section'),
f AS (SELECT doc_id, 'duplicate_article' AS problem, number, count(*) - 1 AS n FROM c WHERE kind = 'Article' GROUP BY doc_id, part, number HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate_subsection', number, count(*) - 1 FROM c WHERE kind = 'Subsection' GROUP BY doc_id, part, chapter, section, number HAVING count(*) > 1
 UNION ALL SELECT doc_id, lower(kind) || '_missing_part', number, count(*) FROM c WHERE kind IN ('Section', 'Article') AND part IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.doc_id = c.doc_id AND p.number = c.part) GROUP BY ALL
 UNION ALL SELECT doc_id, 'subsection_missing_section', number, count(*) FROM c WHERE kind = 'Subsection' AND NOT EXISTS (SELECT 1 FROM sec s WHERE s.doc_id = c.doc_id AND s.part = c.part AND s.chapter = c.chapter AND s.number = c.section) GROUP BY ALL
 UNION ALL SELECT doc_id, 'subsection_without_section', number, count(*) FROM c WHERE kind = 'Article' AND subsection IS NOT NULL AND section IS NULL GROUP BY ALL
 UNION ALL SELECT doc_id, 'article_missing_section', number, count(*) FROM c WHERE kind = 'Article' AND section IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sec s WHERE s.doc_id = c.doc_id AND s.part = c.part AND s.chapter = c.chapter AND s.number = c.section) GROUP BY ALL
 UNION ALL SELECT doc_id, 'article_missing_subsection', number, count(*) FROM c WHERE kind = 'Article' AND section IS NOT NULL AND subsection IS NOT NULL GROUP BY ALL) SELECT doc_id, problem, number, n FROM f""")
def ing5_document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING5 whole: parsed documents whose groups and articles don't hang together, with faults of every kind planted."""
    none = F.lit(None).cast("string")
    kind = F.col("kind")
    b = laws(spark, sf_dir).where("kind in ('Part', 'Section', 'Article')").select(F.substr("document_id", F.lit(2)).cast("long").alias("doc_id"), "kind", F.when(kind == "Part", F.col("part")).when(kind == "Section", F.col("section")).otherwise(F.col("article")).alias("number"), F.when(kind != "Part", F.col("part")).alias("part"), F.when(kind != "Part", F.col("chapter")).alias("chapter"), F.when(kind == "Article", F.col("section")).alias("section"), none.alias("subsection"))
    k, first = F.col("doc_id") % 8, (kind == "Article") & (F.col("number") == "1")
    c = b.where(~((k == 2) & (kind == "Part")) & ~((k == 3) & (kind == "Section") & (F.col("number") == "2")))
    c = c.withColumns({"section": F.when((k == 6) & first, none).otherwise(F.col("section")), "subsection": F.when(first & k.isin(6, 7), "7")})
    root = b.where((kind == "Part") & (F.col("number") == "1"))
    below = lambda section: ("doc_id", F.lit("Subsection").alias("kind"), F.lit("1").alias("number"), F.lit("1").alias("part"), F.lit("I").alias("chapter"), F.lit(section).alias("section"), none.alias("subsection"))
    twice = root.where(k == 5).select(*below("1"))
    return consistency.problems(c.unionByName(b.where((k == 1) & first)).unionByName(root.where(k == 4).select(*below("9"))).unionByName(twice).unionByName(twice))
