"""Queries of parsing, citations, evidence paths and conversations, over texts written from the order tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import strings
from statuta.operators import graph, hierarchy, ranking, references, routing
from statuta.plans.registry import query
from statuta.plans.retrieval_queries import HYBRID_SQL, hybrid
from statuta.runtime import table
from statuta.sources import markup
from statuta.sources.units import EDGES_SQL, UNITS_SQL, edges, units

#: Lines of a customer's law: orders are articles, their lines clauses with one point each.
LAW_SQL = """clause AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of small law texts."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    c = li.join(o, li.l_orderkey == o.o_orderkey).withColumn("n", F.row_number().over(order))
    piece = F.concat(F.col("n").cast("string"), F.lit(". Part "), F.col("l_partkey").cast("string"), F.lit(" per điểm a khoản 1 Điều "), F.col("l_partkey").cast("string"), F.lit("\na) point of "), F.col("n").cast("string"))
    article = c.groupBy("o_custkey", "o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    head = F.concat(F.lit("Điều "), F.col("o_orderkey").cast("string"), F.lit(". Order\n"), F.col("body"))
    return article.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("Preamble\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", head.alias("t")))), lambda x: x["t"]), "\n")).alias("text"))


@query(f"""WITH {LAW_SQL}, a AS (SELECT DISTINCT doc_id, o_orderkey FROM clause)
SELECT doc_id, doc_id || '_art' || o_orderkey AS unit_id, 'Article' AS label, doc_id::VARCHAR AS parent_id, 'Điều ' || o_orderkey || '. Order' AS first_line FROM a
UNION ALL SELECT doc_id, doc_id || '_art' || o_orderkey || '_cl' || n, 'Clause', doc_id || '_art' || o_orderkey, n || '. Part ' || l_partkey || ' per điểm a khoản 1 Điều ' || l_partkey FROM clause
UNION ALL SELECT doc_id, doc_id || '_art' || o_orderkey || '_cl' || n || '_pa', 'Point', doc_id || '_art' || o_orderkey || '_cl' || n, 'a) point of ' || n FROM clause""")
def ing1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.parse(laws(spark, sf_dir)).select("doc_id", "unit_id", "label", "parent_id", F.substring_index("content", "\n", 1).alias("first_line"))


@query(f"""WITH {LAW_SQL}, a AS (SELECT DISTINCT doc_id, o_orderkey FROM clause), c AS (SELECT doc_id, o_orderkey, n, length(n || '. Part ' || l_partkey || ' per điểm a khoản 1 Điều ' || l_partkey || chr(10) || 'a) point of ' || n) AS len FROM clause)
SELECT doc_id || '_art' || o_orderkey AS unit_id, (length('Điều ' || o_orderkey || '. Order') + sum(len + 1))::BIGINT AS n_chars FROM c GROUP BY doc_id, o_orderkey""")
def ing5_article_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.spans(laws(spark, sf_dir)).where("label = 'Article'").select("unit_id", (F.col("end_char") - F.col("start_char")).alias("n_chars"))


@query(f"""WITH {LAW_SQL} SELECT doc_id || '_art' || o_orderkey || '_cl' || n || '_pa' AS unit_id, doc_id || '_art' || o_orderkey || '_cl' || n || ',' || doc_id || '_art' || o_orderkey || ',' || doc_id AS chain FROM clause""")
def grf20_ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = hierarchy.ancestors(hierarchy.spans(laws(spark, sf_dir)))
    return chains.where(F.col("unit_id").endswith("_pa")).select("unit_id", F.array_join("chain", ",").alias("chain"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 1::BIGINT AS pos, l_partkey::VARCHAR AS article, l_linenumber::VARCHAR AS clause, 'b' AS point, false AS relative FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 0, l_orderkey::VARCHAR, NULL, NULL, false FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 2, NULL, NULL, NULL, true FROM lineitem""")
def ref1_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    text = F.concat(F.lit("Theo điều "), F.col("l_orderkey").cast("string"), F.lit(" và điểm b Khoản "), F.col("l_linenumber").cast("string"), F.lit(" ĐIỀU "), F.col("l_partkey").cast("string"), F.lit(", Điều này."))
    return references.mentions(li.withColumn("t", text), "key", "t").select("id.*", F.col("pos").cast("long").alias("pos"), "article", "clause", "point", "relative")


@query(f"""WITH {UNITS_SQL}, m AS (SELECT DISTINCT l_orderkey AS bundle, 'd' || (l_suppkey * 16) AS target FROM lineitem), k AS (SELECT DISTINCT id FROM units), v AS (SELECT bundle, count(k.id) = count(*) AS resolved FROM m LEFT JOIN k ON k.id = m.target GROUP BY bundle) SELECT bundle, target, resolved FROM m JOIN v USING (bundle)""")
def ref5_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle"), F.concat(F.lit("d"), (F.col("l_suppkey") * 16).cast("string")).alias("target")).distinct()
    return references.all_or_nothing(m, units(spark, sf_dir).select("id"), "bundle", "target").select("bundle", "target", "resolved")


@query(f"""WITH {EDGES_SQL} SELECT head_id, tail_id, sha256(head_id || '|0|' || length(citation_text) || '|' || citation_text) AS bundle_id, sha1(head_id || '|' || type || '|' || tail_id || '|' || citation_text) AS relation_id FROM edges WHERE type = 'REFERS_TO'""")
def ref_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("type = 'REFERS_TO'")
    return e.select("head_id", "tail_id", references.bundle_id(F.col("head_id"), F.lit(0), F.length("citation_text"), F.concat(F.lit(" "), F.regexp_replace("citation_text", " ", "  \n"))).alias("bundle_id"), graph.relation_id(F.col("citation_text")).alias("relation_id"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'beta' WHEN 1 THEN 'gamma' WHEN 2 THEN NULL ELSE 'alpha' END AS choice FROM conversations""")
def ref18_clarification_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    reply = F.when(k == 0, " 2 ").when(k == 1, "GAMMA").when(k == 2, "9").otherwise("Alpha ")
    options = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", references.reply_choice(reply, options).alias("choice"))


@query("""SELECT p_partkey AS id, 'Brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'Size & type', p_size || ' ' || p_type FROM part""")
def src8_property_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>Brand<b></b></th><td> "), F.col("p_brand"), F.lit("</td></tr><tr><td>only one</td></tr><tr><td>Size &amp; type</td><td>"), F.col("p_size").cast("string"), F.lit("\n "), F.col("p_type"), F.lit("</td></tr></table>"))
    return markup.properties(table(spark, sf_dir, "part").withColumn("html", html), "p_partkey", "html")


@query("""SELECT p_partkey AS id, 'Amended by' AS category, p_brand AS title FROM part UNION ALL SELECT p_partkey, 'Amended by', p_type FROM part UNION ALL SELECT p_partkey, 'Guides', p_name FROM part WHERE p_size > 10""")
def src9_diagram_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    guides = F.when(F.col("p_size") > 10, F.concat(F.lit("<h3>Guides (1)</h3><ul><li>"), F.col("p_name"), F.lit("</li></ul>"))).otherwise(F.lit("<h3>Guides (0)</h3>"))
    html = F.concat(F.lit("<h3>Amended by (2)</h3><ul><li><a>"), F.col("p_brand"), F.lit("</a></li><li>"), F.col("p_type"), F.lit("</li></ul>"), guides)
    found = markup.grouped_lists(table(spark, sf_dir, "part").withColumn("html", html), "p_partkey", "html")
    return found.withColumn("category", strings.count_suffix_stripped(F.col("category")))


@query("""WITH c AS (SELECT 'amended' AS category, 'AMENDS' AS relation, true AS swapped UNION ALL SELECT 'guides', 'GUIDES', false), d AS (SELECT o_orderkey AS id, 'd' || o_custkey AS subject, 'd' || (o_orderkey % 50 + 1) AS other, CASE o_orderkey % 3 WHEN 0 THEN 'amended' WHEN 1 THEN 'guides' ELSE 'other' END AS category FROM orders)
SELECT id, CASE WHEN swapped THEN other ELSE subject END AS head, relation, CASE WHEN swapped THEN subject ELSE other END AS tail FROM d JOIN c USING (category) WHERE subject <> other""")
def jon14_diagram_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("amended", "AMENDS", "guides", "GUIDES")])
    k = F.col("o_orderkey") % 3
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("subject"), F.concat(F.lit("d"), (F.col("o_orderkey") % 50 + 1).cast("string")).alias("other"), F.when(k == 0, "amended").when(k == 1, "guides").otherwise("other").alias("category"))
    swapped = F.col("category") == "amended"
    return d.withColumn("relation", F.try_element_at(kinds, F.col("category"))).where("relation is not null and subject <> other").select("id", F.when(swapped, F.col("other")).otherwise(F.col("subject")).alias("head"), "relation", F.when(swapped, F.col("subject")).otherwise(F.col("other")).alias("tail"))


@query(f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT head_id, tail_id, citation_text FROM edges WHERE type = 'REFERS_TO') SELECT head_id, tail_id, count(*) AS n_parallel, min(citation_text) AS first_citation FROM e GROUP BY head_id, tail_id""")
def grf4_topology_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("type = 'REFERS_TO'").select("head_id", "tail_id", "type", "citation_text").distinct()
    return e.groupBy("head_id", "tail_id").agg(F.count(F.lit(1)).alias("n_parallel"), F.min("citation_text").alias("first_citation"))


@query("""WITH e AS (SELECT 'n' || l_partkey AS head_id, 'n' || l_suppkey AS tail_id FROM lineitem), m AS (SELECT tail_id AS id FROM e GROUP BY tail_id HAVING count(DISTINCT head_id) > 1)
SELECT id, 'several_parents' AS problem FROM m UNION SELECT tail_id, 'own_parent' FROM e WHERE head_id = tail_id UNION SELECT a.tail_id, 'cycle' FROM e a JOIN e b ON a.head_id = b.tail_id AND a.tail_id = b.head_id WHERE a.head_id <> a.tail_id""")
def grf7_hierarchy_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("head_id"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("tail_id"))
    return hierarchy.problems(e)


@query(f"""WITH {UNITS_SQL}, {EDGES_SQL}, s AS (SELECT DISTINCT id FROM units WHERE legal_status = 'EXPIRED'), o AS (SELECT DISTINCT tail_id AS id FROM edges WHERE head_id IN (SELECT id FROM s) UNION SELECT head_id FROM edges WHERE tail_id IN (SELECT id FROM s)) SELECT id FROM s UNION SELECT id FROM o""")
def grf11_written_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = units(spark, sf_dir).where("legal_status = 'EXPIRED'").select("id").distinct()
    near = graph.both_ways(edges(spark, sf_dir)).join(own.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return own.unionByName(near).distinct()


@query(f"""WITH {UNITS_SQL}, {EDGES_SQL}, p AS (SELECT a.head_id AS anchor, a.tail_id AS article, b.tail_id AS target FROM edges a JOIN edges b ON b.head_id = a.tail_id WHERE a.type = 'CONTAINS' AND b.type = 'AMENDS' AND a.head_id <> b.tail_id),
v AS (SELECT p.*, u.effective_from <= DATE '1996-01-01' AND (u.effective_to IS NULL OR u.effective_to > DATE '1996-01-01') AS ok FROM p JOIN units u ON u.id = p.article), q AS (SELECT DISTINCT id AS anchor FROM units WHERE label = 'Document'),
c AS (SELECT q.anchor, count(v.article) AS n, count(*) FILTER (v.ok) AS n_ok, count(DISTINCT CASE WHEN v.ok THEN v.target END) AS n_targets FROM q LEFT JOIN v USING (anchor) GROUP BY q.anchor)
SELECT anchor, CASE WHEN n > 4 THEN 'PATH_BUDGET_EXCEEDED' WHEN n = 0 THEN 'NO_PATH' WHEN n_ok = 0 THEN 'TEMPORAL_REJECTED' WHEN n_targets > 1 THEN 'AMBIGUOUS_PATH' ELSE 'SATISFIED' END AS reason FROM c""")
def pln7_planned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.planning import path_outcomes

    u = units(spark, sf_dir)
    docs = u.where("label = 'Document'").select("id").distinct()
    paths = graph.exact_paths(edges(spark, sf_dir), u, [("CONTAINS", "out", "Article"), ("AMENDS", "out", "Document")], docs)
    return path_outcomes(docs, paths, u.where("label = 'Article'"), date(1996, 1, 1), 4)


@query(f"""WITH {HYBRID_SQL}, t AS (SELECT query_id, id, rank FROM fused WHERE rank <= 10), mixed AS (SELECT query_id, id, rank, 0 AS pin FROM t UNION ALL SELECT item_id, item_id, 0, 1 FROM benchmark), pinned AS (SELECT query_id, id, max(pin) AS pin, min(rank) AS rank FROM mixed GROUP BY query_id, id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pin DESC, rank, id) AS pos FROM pinned) SELECT query_id, id, pin = 1 AS pinned, pos FROM o WHERE pos <= 10""")
def top7_pinned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hybrid(spark, sf_dir).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("pin"))
    pins = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("rank"), F.lit(1).alias("pin"))
    f = t.unionByName(pins).groupBy("query_id", "id").agg(F.max("pin").alias("pin"), F.min("rank").alias("rank"))
    placed = f.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pin"), "rank", "id")))
    return placed.where("pos <= 10").select("query_id", "id", (F.col("pin") == 1).alias("pinned"), "pos")


@query(f"""WITH {HYBRID_SQL}, t AS (SELECT query_id, id, rank, unnest(string_split(sources, ',')) AS channel FROM fused WHERE rank <= 5) SELECT query_id, id, channel, rank, rank <= 3 AS eligible FROM t""")
def ret10_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hybrid(spark, sf_dir, 5)
    return t.select("query_id", "id", F.explode(F.split("sources", ",")).alias("channel"), "rank", (F.col("rank") <= 3).alias("eligible"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN 'FORCED' WHEN contains(text, 'th') AND turn % 5 = 0 THEN 'MULTI_HOP' WHEN turn % 3 = 0 THEN 'LISTING' WHEN turn % 2 = 0 THEN 'MODEL' ELSE 'LISTING' END AS intent FROM conversations""")
def rte2_intent_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    goal = F.when(F.contains("text", F.lit("th")) & (t % 5 == 0), "REFERS_TO")
    i = routing.intent(F.when(t % 7 == 0, "FORCED"), goal, F.lit("LISTING"), t % 3 == 0, F.when(t % 2 == 0, "MODEL"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", i.alias("intent"))


@query("""WITH g AS (SELECT l_orderkey AS query_id, count(*) AS n_gold, count(*) FILTER (l_quantity > 25) AS n_hit FROM lineitem GROUP BY l_orderkey) SELECT query_id, n_hit > 0 AS any_hit, n_hit = n_gold AS all_hit FROM g""")
def evl8_path_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("l_quantity") > 25
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.bool_or(hit).alias("any_hit"), F.bool_and(hit).alias("all_hit"))


@query("""WITH a AS (SELECT l_orderkey, array_to_string(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), ',') AS steps FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, steps, steps = 'N,N' OR steps = 'R,A' AS exact, contains(steps, 'N,N') AS has_pair FROM a""")
def evl11_plan_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))), lambda x: x["l_returnflag"]), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(steps.alias("steps")).select("l_orderkey", "steps", F.col("steps").isin("N,N", "R,A").alias("exact"), F.contains("steps", F.lit("N,N")).alias("has_pair"))


@query("""WITH g AS (SELECT l_orderkey AS case_id, l_suppkey % 3 AS grp, bool_or(l_linestatus = 'F') AS covered FROM lineitem GROUP BY ALL) SELECT case_id, bool_and(covered) AS passed, count(*) AS n_groups FROM g GROUP BY case_id""")
def evl15_citation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 3).alias("grp")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("covered"))
    return g.groupBy("case_id").agg(F.bool_and("covered").alias("passed"), F.count(F.lit(1)).alias("n_groups"))


@query("""WITH r AS (SELECT source AS query_id, doc_id AS id, n_chars AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM r) SELECT query_id, id, rank, running::BIGINT AS running FROM b WHERE rank = 1 OR running <= 20000""")
def gen4_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.top_k(table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("cost")), 1 << 30, ["query_id"], [F.desc("cost"), "id"])
    return ranking.running_budget(r, ["query_id"], ["rank"], F.col("cost"), 20000).select("query_id", "id", "rank", "running")


@query("""WITH t AS (SELECT user_id, sha256(array_to_string(list_sort(list('{"id":' || event_id || ',"kind":"' || event_type || '"}')), chr(10))) AS projection FROM events GROUP BY user_id) SELECT * FROM t""")
def agg28_projection_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256).alias("projection"))


@query(f"""WITH {UNITS_SQL} SELECT u.id, coalesce(p.content || chr(10), '') || u.content AS text, 'Doc ' || u.document_id || coalesce(', art. ' || p.number, '') || ', ' || lower(u.label) || ' ' || u.number AS citation FROM units u LEFT JOIN units p ON p.id = u.parent_id AND p.label = 'Article'""")
def str17_labels_and_embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    p = u.where("label = 'Article'").select(F.col("id").alias("_p"), F.col("content").alias("p_content"), F.col("number").alias("p_number"))
    text = F.concat_ws("\n", F.col("p_content"), F.col("content"))
    citation = F.concat_ws(", ", F.concat(F.lit("Doc "), F.col("document_id")), F.concat(F.lit("art. "), F.col("p_number")), F.concat(F.lower("label"), F.lit(" "), F.col("number")))
    return u.join(p, F.col("parent_id") == F.col("_p"), "left").select("id", text.alias("text"), citation.alias("citation"))
