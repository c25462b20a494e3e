"""Queries of text functions, graph paths, retrieval, validation, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import dates, strings
from statuta.operators import decisions, fulltext, graph, ranking, sets
from statuta.plans.registry import query
from statuta.runtime import table
from statuta.sources.units import EDGES_SQL, UNITS_SQL, edges, units

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
MARKS, BASES = "".join(strings.FOLDED.values()), "".join(k * len(v) for k, v in strings.FOLDED.items())


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(translate(lower(text), '{MARKS}', '{BASES}'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, nullif(upper(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'SS')), '') AS number, length(text)::VARCHAR || ':' || substr(sha256(text), 1, 16) || ':' || substr(text, 1, 12) AS redacted FROM documents""")
def str_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", strings.slug(t).alias("slug"), strings.squeeze(t).alias("squeezed"), strings.document_number(t).alias("number"), strings.redact(t).alias("redacted"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(translate(lower(text), '{MARKS}', '{BASES}'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, nullif(upper(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'SS')), '') AS number FROM documents""")
def str_normalised_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of str_normalised, of whole texts."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", strings.slug(t).alias("slug"), strings.squeeze(t).alias("squeezed"), strings.document_number(t).alias("number"))


@query("""WITH n AS (SELECT o_orderkey, o_orderkey % 3999 + 1 AS v FROM orders), r AS (SELECT o_orderkey, v, repeat('M', (v // 1000)::INT) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(v // 100) % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(v // 10) % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][v % 10 + 1] AS numeral FROM n)
SELECT o_orderkey, numeral, v::BIGINT AS value FROM r""")
def str2_roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_orderkey") % 3999 + 1
    places = (("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))
    digit = [F.element_at(F.array(*map(F.lit, p)), (F.floor(v / 10 ** (2 - i)) % 10 + 1).cast("int")) for i, p in enumerate(places)]
    numeral = F.concat(F.repeat(F.lit("M"), F.floor(v / 1000).cast("int")), *digit)
    return table(spark, sf_dir, "orders").select("o_orderkey", numeral.alias("numeral")).withColumn("value", strings.roman(F.col("numeral")).cast("long"))


@query(f"""WITH {UNITS_SQL} SELECT DISTINCT id, CASE WHEN regexp_matches(id, '_cl[0-9a-z]+$') THEN 'Clause' WHEN regexp_matches(id, '_art[0-9a-z]+$') THEN 'Article' ELSE 'Document' END AS kind, string_split(id, '_cl')[1] AS grp, regexp_full_match(number, '[0-9]+[a-z]?') AS legal FROM units""")
def str27_structural_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return units(spark, sf_dir).select("id", strings.structural_type(i).alias("kind"), strings.relevance_group(i).alias("grp"), strings.is_legal_number(F.col("number")).alias("legal")).distinct()


@query("""SELECT conv_id, turn, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 60 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 59) || '…' END AS title,
len(regexp_extract_all(text, '(?s).{1,160}')) AS chunks FROM conversations""")
def str35_titles_and_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", strings.conversation_title(F.col("text")).alias("title"), F.size(fulltext.chunks(F.col("text"))).cast("long").alias("chunks"))


@query("""SELECT doc_id, coalesce(string_split(string_split(text, chr(10))[1], ' ')[1], '') AS first_word, list_reduce(list_prepend('', string_split(substr(text, 1, 50), chr(10))[-1:]), lambda a, b: b) || string_split(substr(text, 51), chr(10))[1] AS line FROM documents""")
def str33_line_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.substring_index(t, "\n", 1), " ", 1).alias("first_word"), strings.line_at(t, F.lit(50)).alias("line"))


@query("""WITH o AS (SELECT doc_id, text, (doc_id * 7919 % greatest(length(text), 1))::BIGINT AS place FROM documents)
SELECT doc_id, place, string_split(substr(text, 1, place), chr(10))[-1] || string_split(substr(text, place + 1), chr(10))[1] AS line FROM o""")
def str33_line_at_any_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line at an offset of each document's own, anywhere in its text; an empty text has an empty line."""
    place = (F.col("doc_id") * 7919 % F.greatest(F.length("text"), F.lit(1))).cast("long")
    return table(spark, sf_dir, "documents").withColumn("place", place).select("doc_id", "place", strings.line_at(F.col("text"), F.col("place").cast("int")).alias("line"))


@query("""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'valid on ' || strftime(o_orderdate, '%d/%m/%Y') || ' hiện hành' WHEN 1 THEN 'currently in force' WHEN 2 THEN 'month ' || strftime(o_orderdate, '%m/%Y') WHEN 3 THEN 'in ' || strftime(o_orderdate, '%Y') ELSE 'no date 31/02/2020' END AS question, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'current' WHEN 2 THEN 'month' WHEN 3 THEN 'year' ELSE 'none' END AS granularity,
CASE o_orderkey % 5 WHEN 0 THEN d WHEN 2 THEN date_trunc('month', d)::DATE WHEN 3 THEN date_trunc('year', d)::DATE END AS range_start, CASE o_orderkey % 5 WHEN 0 THEN d WHEN 2 THEN last_day(d) WHEN 3 THEN make_date(year(d)::INT, 12, 31) END AS range_end FROM q""")
def dat1_temporal_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    question = F.when(k == 0, F.concat(F.lit("valid on "), F.date_format(d, "dd/MM/yyyy"), F.lit(" hiện hành"))).when(k == 1, "currently in force").when(k == 2, F.concat(F.lit("month "), F.date_format(d, "MM/yyyy"))).when(k == 3, F.concat(F.lit("in "), F.date_format(d, "yyyy"))).otherwise("no date 31/02/2020")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.temporal_scope(question).alias("s")).select("o_orderkey", F.col("s.granularity"), F.col("s.start").alias("range_start"), F.col("s.end").alias("range_end"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc, coalesce(CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END::DATE, CASE WHEN event_id % 2 = 0 THEN DATE '2001-02-03' END, DATE '1970-01-01') AS effective FROM events""")
def dat5_canonical_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    effective = F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a date")
    issued = F.when(i % 2 == 0, "2001-02-03").otherwise("2001-99-03")
    return table(spark, sf_dir, "events").select("event_id", dates.canonical_utc(F.col("ts")).alias("utc"), dates.effective_date(effective, issued).alias("effective"))


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events""")
def jsn1_noisy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(strings.json_object(noisy), "$.k").cast("long").alias("k"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 0.3 * (l_tax < 0.07)::INT + 0.3 * (l_discount < 0.09)::INT + 0.2 * (l_quantity / 50.0) + 0.1 * (CASE WHEN l_linenumber > 2 THEN 1.0 ELSE 0.5 END) + 0.1 * (l_returnflag = 'N')::INT AS confidence,
CASE WHEN l_discount >= 0.095 THEN 'rejected' WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'accepted' WHEN round(0.3 * (l_tax < 0.07)::INT + 0.3 * (l_discount < 0.09)::INT + 0.2 * (l_quantity / 50.0) + 0.1 * (CASE WHEN l_linenumber > 2 THEN 1.0 ELSE 0.5 END) + 0.1 * (l_returnflag = 'N')::INT, 6) >= 0.8 THEN 'accepted'
 WHEN round(0.3 * (l_tax < 0.07)::INT + 0.3 * (l_discount < 0.09)::INT + 0.2 * (l_quantity / 50.0) + 0.1 * (CASE WHEN l_linenumber > 2 THEN 1.0 ELSE 0.5 END) + 0.1 * (l_returnflag = 'N')::INT, 6) >= 0.55 THEN 'review' ELSE 'rejected' END AS decision FROM lineitem""")
def val9_decision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decisions.confidence(F.col("l_tax") < 0.07, F.col("l_discount") < 0.09, F.col("l_returnflag") == "N", F.col("l_quantity") / 50.0, F.when(F.col("l_linenumber") > 2, 1.0).otherwise(0.5))
    rows = table(spark, sf_dir, "lineitem").withColumn("confidence", c)
    rule = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "confidence", decisions.gate(F.col("l_discount") < 0.095, F.round("confidence", 6), rule).alias("decision"))


@query(f"""WITH {UNITS_SQL}, {EDGES_SQL}, u AS (SELECT DISTINCT id, label FROM units)
SELECT e.head_id, e.type, e.tail_id, CASE WHEN h.id IS NULL OR t.id IS NULL THEN 'missing_endpoint' WHEN e.head_id = e.tail_id THEN 'self_loop' WHEN NOT ((e.type = 'CONTAINS' AND h.label || '>' || t.label IN ('Document>Article', 'Article>Clause')) OR (e.type = 'REFERS_TO' AND h.label || '>' || t.label IN ('Clause>Document')) OR (e.type = 'AMENDS' AND h.label || '>' || t.label IN ('Document>Document'))) THEN 'pair_not_allowed' WHEN e.type = 'AMENDS' AND e.effective_from IS NULL THEN 'missing_effective_from' END AS error
FROM (SELECT DISTINCT * FROM edges) e LEFT JOIN u h ON h.id = e.head_id LEFT JOIN u t ON t.id = e.tail_id WHERE e.type <> 'CONTAINS'""")
def val1_relation_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.validation import relation_errors

    allowed = {"CONTAINS": [("Document", "Article"), ("Article", "Clause")], "REFERS_TO": [("Clause", "Document")], "AMENDS": [("Document", "Document")]}
    e = edges(spark, sf_dir).where("type <> 'CONTAINS'").distinct()
    return relation_errors(e, units(spark, sf_dir).select("id", "label").distinct(), allowed, {"AMENDS": ["effective_from"]}).select("head_id", "type", "tail_id", "error")


@query("""WITH t AS (SELECT p_brand AS entity, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand) SELECT p_partkey, CASE WHEN kinds > 1 THEN 'review' ELSE 'accepted' END AS decision FROM part JOIN t ON entity = p_brand""")
def val15_type_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = p.groupBy("p_brand").agg(F.count_distinct("p_type").alias("kinds"))
    return p.join(kinds, "p_brand").select("p_partkey", F.when(F.col("kinds") > 1, "review").otherwise("accepted").alias("decision"))


@query("""WITH t AS (SELECT p_brand AS entity, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand) SELECT p_partkey, CASE WHEN kinds > 1 THEN 'review' ELSE 'accepted' END AS decision FROM part LEFT JOIN t ON entity = p_brand""")
def val15_all_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of val15_type_conflict from all parts; parts without a brand are accepted."""
    p = table(spark, sf_dir, "part")
    kinds = p.groupBy("p_brand").agg(F.count_distinct("p_type").alias("kinds"))
    return p.join(kinds, "p_brand", "left").select("p_partkey", F.when(F.col("kinds") > 1, "review").otherwise("accepted").alias("decision"))


@query(f"""WITH {UNITS_SQL}, {EDGES_SQL}, e AS (SELECT *, sha1(head_id || '|' || type || '|' || tail_id || '|' || coalesce(citation_text, '')) AS relation_id FROM (SELECT DISTINCT * FROM edges) WHERE type <> 'CONTAINS'), seeds AS (SELECT DISTINCT id FROM units WHERE label = 'Document'),
side AS (SELECT head_id AS a, tail_id AS b, type, relation_id FROM e UNION ALL SELECT tail_id, head_id, type, relation_id FROM e WHERE head_id <> tail_id),
p1 AS (SELECT b AS last, [id, b] AS nodes, [relation_id] AS ids, [type] AS types FROM seeds JOIN side ON a = id), p2 AS (SELECT b, list_append(nodes, b), list_append(ids, relation_id), list_append(types, type) FROM p1 JOIN side ON a = last WHERE NOT list_contains(ids, relation_id))
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types FROM p1 UNION ALL SELECT array_to_string(c1, '>'), array_to_string(c3, '>') FROM p2 t(c0, c1, c2, c3)""")
def grf1_bounded_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("type <> 'CONTAINS'").distinct().withColumn("relation_id", graph.relation_id(F.col("citation_text")))
    seeds = units(spark, sf_dir).where("label = 'Document'").select("id").distinct()
    return graph.trails(e, seeds, 2).select(F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"))


@query(f"""WITH {EDGES_SQL}, {UNITS_SQL}, e AS (SELECT *, sha1(head_id || '|' || type || '|' || tail_id || '|' || coalesce(citation_text, '')) AS relation_id FROM (SELECT DISTINCT * FROM edges) WHERE type <> 'CONTAINS'), seeds AS (SELECT DISTINCT id FROM units WHERE label = 'Document'),
side AS (SELECT head_id AS a, tail_id AS b, type, relation_id FROM e UNION ALL SELECT tail_id, head_id, type, relation_id FROM e WHERE head_id <> tail_id),
p1 AS (SELECT b AS last, [id, b] AS nodes, [relation_id] AS ids, [type] AS types FROM seeds JOIN side ON a = id), p2 AS (SELECT b, list_append(nodes, b), list_append(ids, relation_id), list_append(types, type) FROM p1 JOIN side ON a = last WHERE NOT list_contains(ids, relation_id))
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types FROM p1 UNION ALL SELECT array_to_string(c1, '>'), array_to_string(c3, '>') FROM p2 t(c0, c1, c2, c3)""")
def grf1_all_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trails of grf1_bounded_trails from every document."""
    e = edges(spark, sf_dir).where("type <> 'CONTAINS'").distinct().withColumn("relation_id", graph.relation_id(F.col("citation_text")))
    seeds = units(spark, sf_dir).where("label = 'Document'").select("id").distinct()
    return graph.trails(e, seeds, 2).select(F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"))


@query(f"""WITH {EDGES_SQL}, e AS (SELECT head_id, tail_id, type FROM edges WHERE type = 'AMENDS') SELECT head_id, 'path_' || substr(sha256('{{"edges":["' || type || '"],"node_ids":["' || head_id || '","' || tail_id || '"]}}'), 1, 20) AS fingerprint, head_id || ' -[AMENDS]-> ' || tail_id AS description FROM e""")
def grf5_path_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, types = F.array("head_id", "tail_id"), F.array("type")
    return edges(spark, sf_dir).where("type = 'AMENDS'").select("head_id", graph.path_fingerprint(nodes, types).alias("fingerprint"), graph.describe_path(nodes, types, F.array(F.lit(True))).alias("description"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT DISTINCT head_id, tail_id FROM edges WHERE type = 'CONTAINS'), x AS (SELECT head_id AS ancestor_id, tail_id AS unit_id, 1 AS depth FROM c UNION ALL SELECT x.ancestor_id, c.tail_id, x.depth + 1 FROM x JOIN c ON x.unit_id = c.head_id) SELECT ancestor_id, depth, count(*) AS n FROM x GROUP BY ALL""")
def grf6_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF6: how many units every unit contains at each depth, to the end."""
    return graph.closure(edges(spark, sf_dir)).groupBy("ancestor_id", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT l_partkey AS unit, 'd' || l_suppkey AS parent, count(*) AS rank FROM lineitem GROUP BY ALL) SELECT unit, arg_max(parent, rank * 100000 - substr(parent, 2)::BIGINT) AS parent FROM p GROUP BY unit""")
def grf15_best_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("unit"), "l_suppkey").agg(F.count(F.lit(1)).alias("rank"))
    return p.groupBy("unit").agg(F.max_by(F.concat(F.lit("d"), F.col("l_suppkey").cast("string")), F.struct("rank", -F.col("l_suppkey"))).alias("parent"))


WORDS_SQL = """d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
p AS (SELECT term, id, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_len FROM d), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT query_id, id, sum(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len))) AS score FROM p JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL),
top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm)"""


@query(f"WITH {WORDS_SQL} SELECT query_id, id, score, rank FROM top WHERE rank <= 20")
def ret2_fulltext_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return fulltext.bm25(table(spark, sf_dir, "documents"), asked, 20)


VECTORS_SQL = """s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
vtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query(f"WITH {VECTORS_SQL} SELECT query_id, id, score, rank FROM vtop WHERE rank <= 10")
def ret1_vector_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return fulltext.vector_top_k(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


def hybrid(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Full-text and vector channels of the benchmark questions, fused; a question's vector is that of its id."""
    text = ret2_fulltext_channel(spark, sf_dir).select("query_id", F.lit("fulltext").alias("channel"), "id", F.round("score", 9).alias("score"))
    v = table(spark, sf_dir, "embeddings")
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    near = fulltext.vector_top_k(v, asked, 20).select("query_id", F.lit("vector").alias("channel"), "id", "score")
    return ranking.top_k(ranking.reciprocal_rank_fusion(text.unionByName(near), ["fulltext", "vector"]), k, ["query_id"], [F.desc("rrf"), "id"])


HYBRID_SQL = f"""{WORDS_SQL}, vc AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id <> q.vec_id QUALIFY rank <= 20),
parts AS (SELECT query_id, id, 'fulltext' AS channel, rank FROM top WHERE rank <= 20 UNION ALL SELECT query_id, id, 'vector', rank FROM vc),
rrf AS (SELECT query_id, id, coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'fulltext'), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (channel = 'vector'), 0) AS rrf, string_agg(channel, ',' ORDER BY channel) AS sources FROM parts GROUP BY ALL), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM rrf)"""


@query(f"WITH {HYBRID_SQL} SELECT query_id, id, rrf, sources, rank FROM fused WHERE rank <= 10")
def ret4_reciprocal_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir)


@query("""WITH r AS (SELECT doc_id AS id, source AS query_id, doc_id AS rank, text FROM documents) SELECT id, query_id, CASE WHEN id % 10 = 0 THEN id ELSE first_value(id) OVER (PARTITION BY query_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY rank, id) END AS retained_unit_id FROM r""")
def gen2_evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), "text")
    return ranking.dedup_evidence(rows, ["query_id"], F.col("text"), protected=F.col("id") % 10 == 0).select("id", "query_id", "retained_unit_id")


@query("""SELECT doc_id, item_id, contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) AS grounded FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)""")
def gen6_verbatim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    # documents are dealt to all items in turn; gen6_grounded_quotes tries every pair
    n = (b.agg(F.max("item_id")).first()[0] or 0) + 1
    d = table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % n)
    return d.join(b, "item_id").select("doc_id", "item_id", strings.contains_quote(F.col("text"), F.col("quote")).alias("grounded"))


@query("""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents), b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark) SELECT DISTINCT doc_id, item_id FROM d JOIN b ON q <> '' AND contains(t, q)""")
def gen6_grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with every benchmark item whose text it quotes verbatim."""
    return fulltext.grounded_quotes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


GOLD_SQL = f"""WITH {VECTORS_SQL}, ranked AS (SELECT query_id, id, rank FROM vtop WHERE rank <= 10), gold AS (SELECT q.vec_id AS query_id, v.vec_id AS id, 1 + v.vec_id % 3 AS relevance FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND v.label = q.label),
h AS (SELECT g.query_id, g.id, relevance, rank FROM gold g LEFT JOIN ranked USING (query_id, id)), i AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS i FROM gold),
best AS (SELECT query_id, sum(1.0 / log2(i + 1)) AS b, sum((2 ** relevance - 1) / log2(i + 1)) AS g FROM i WHERE i <= 10 GROUP BY query_id),
m AS (SELECT query_id, count(rank) / count(*) AS recall, coalesce(1.0 / min(rank), 0.0) AS mrr, coalesce(sum(1.0 / log2(rank + 1)), 0.0) AS d, coalesce(sum((2 ** relevance - 1) / log2(rank + 1)), 0.0) AS e FROM h GROUP BY query_id),
scored AS (SELECT query_id, recall, mrr, d / b AS ndcg, e / g AS graded_ndcg FROM m JOIN best USING (query_id))"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = v.join(F.broadcast(q), "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 3).alias("relevance"))
    return ranking.metrics(ret1_vector_channel(spark, sf_dir), gold, 10)


@query(f"{GOLD_SQL} SELECT * FROM scored")
def evl1_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query(f"{GOLD_SQL} SELECT count(*) AS cases, avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(graded_ndcg) AS graded_ndcg, avg((mrr = 0)::INT) AS no_results FROM scored")
def agg18_evaluation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg", "graded_ndcg")]
    return _metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("cases"), *means, F.avg((F.col("mrr") == 0).cast("int")).alias("no_results"))


@query(f"""WITH {VECTORS_SQL}, r AS (SELECT query_id, id, rank FROM vtop WHERE rank <= 10), g AS (SELECT query_id, id // 7 AS grp, min(rank) AS pos, max(CASE WHEN id % 4 <> 0 THEN id % 3 END) AS grade FROM r GROUP BY ALL) SELECT query_id, grp, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank, grade FROM g""")
def evl6_relevance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ret1_vector_channel(spark, sf_dir)
    g = r.groupBy("query_id", F.floor(F.col("id") / 7).alias("grp")).agg(F.min("rank").alias("pos"), F.max(F.when(F.col("id") % 4 != 0, F.col("id") % 3)).alias("grade"))
    return g.select("query_id", "grp", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("rank"), "grade")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(compare|differ)') THEN 'COMPARISON' WHEN regexp_matches(text, '(?i)\\b(valid|in force)') THEN 'VALIDITY' WHEN regexp_matches(text, '(?i)\\b(how many|list)\\b') THEN 'LISTING' WHEN role = 'user' AND contains(text, '?') THEN 'FACTUAL_HIGH' ELSE 'FACTUAL' END AS intent FROM conversations""")
def rte1_intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.routing import classify

    rules = [("COMPARISON", r"(?iu)\b(compare|differ)"), ("VALIDITY", r"(?iu)\b(valid|in force)"), ("LISTING", r"(?iu)\b(how many|list)\b")]
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.coalesce(classify(F.col("text"), rules), F.when((F.col("role") == "user") & F.contains("text", F.lit("?")), "FACTUAL_HIGH"), F.lit("FACTUAL")).alias("intent"))


@query(f"""WITH {UNITS_SQL}, s AS (SELECT DISTINCT document_id, effective_from AS s, coalesce(effective_to, effective_from + 30) AS e FROM units WHERE label = 'Article' AND effective_to IS NOT NULL),
days AS (SELECT document_id, (DATE '1992-01-01' + i::INT)::DATE AS day FROM (SELECT DISTINCT document_id FROM s), range(0, 2922) t(i)), free AS (SELECT * FROM days d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.document_id = d.document_id AND s.s <= day AND day < s.e))
SELECT document_id, count(*) AS free_days FROM free GROUP BY document_id""")
def set7_interval_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir).where("label = 'Article' and effective_to is not null")
    day0 = F.lit("1992-01-01").cast("date")
    spans = u.select("document_id", F.datediff("effective_from", day0).alias("s"), F.datediff("effective_to", day0).alias("e")).distinct()
    order = Window.partitionBy("document_id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum((F.col("s") > F.coalesce(reach, F.lit(-1))).cast("int")).over(order)
    joined = spans.withColumn("run", run).groupBy("document_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    listed = joined.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("taken"))
    free = listed.select("document_id", F.explode(sets.subtract_intervals(F.lit(0), F.lit(2922), F.col("taken"))).alias("g"))
    return free.groupBy("document_id").agg(F.sum(F.col("g.e") - F.col("g.s")).alias("free_days"))
