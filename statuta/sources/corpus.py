"""A retrieval corpus seen in the driver's tables: documents as articles, clauses and appendices with vectors and relations, benchmark items as questions.

The same views exist as DuckDB SQL (``CORPUS_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.runtime import table

INTENTS = ["FACTUAL", "DEFINITION", "VALIDITY", "HIERARCHY", "COMPARISON", "MULTI_HOP"]
KINDS = ["Law", "Decree", "Circular", "Decision"]
TYPES = ["REFERS_TO", "AMENDS", "DEFINES", "GUIDES", "REGULATES"]


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def _day(first: str, days: Column) -> Column:
    return F.date_add(F.lit(first).cast("date"), days.cast("int"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, article_id, document_id, doc_type, document_status, document_from, document_to, effective_from, effective_to, legal_status, family``."""
    i = F.col("doc_id")
    d = F.floor(i / 10)
    none = F.lit(None).cast("date")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), _pick(["Article", "Clause", "Appendix"], i % 3).alias("label"), F.when(i % 3 < 2, i - i % 3).alias("article_id"), d.alias("document_id"), _pick(KINDS, d % 4).alias("doc_type"),
        F.when(d % 5 == 0, "EXPIRED").otherwise("EFFECTIVE").alias("document_status"), _day("2000-01-01", d % 500).alias("document_from"), none.alias("document_to"),
        F.when(i % 11 != 0, _day("2000-01-01", i % 2000)).alias("effective_from"), F.when(i % 4 == 0, _day("2000-01-01", i % 2000 + 900)).alias("effective_to"),
        F.when(i % 6 == 0, "EXPIRED").otherwise("EFFECTIVE").alias("legal_status"), F.when(i % 2 == 0, F.floor(i / 20)).alias("family"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``head_id, type, tail_id, relation_id, effective_from``: one relation from each passage, and articles with their clauses."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    n = d.count()
    i = F.col("i")
    out = d.select(i.alias("head_id"), _pick(TYPES, i % 5).alias("type"), ((i * 37 + 11) % n).alias("tail_id"), F.when(i % 5 == 1, _day("2001-01-01", i % 1500)).alias("effective_from"))
    has = d.where("i % 3 = 1").select((i - 1).alias("head_id"), F.lit("CONTAINS").alias("type"), i.alias("tail_id"), F.lit(None).cast("date").alias("effective_from"))
    both = out.unionByName(has)
    return both.withColumn("relation_id", F.concat("type", F.lit(":"), F.col("head_id").cast("string"), F.lit(">"), F.col("tail_id").cast("string")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each benchmark item: intent, day, scope, anchors and goal go by its id, its vector is that of the same id."""
    q = F.col("item_id")
    n = table(spark, sf_dir, "documents").count()
    no_text, no_id = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    items = table(spark, sf_dir, "benchmark").select(
        q.alias("query_id"), "text", _pick(INTENTS, q % 6).alias("intent"), F.when(q % 5 != 1, F.lit("2003-06-01").cast("date")).alias("query_date"), no_id.alias("document_ids"),
        F.when(q % 3 == 0, F.array(F.lit("Law"), F.lit("Decree"))).otherwise(no_text).alias("doc_types"), F.when(q % 5 == 0, F.array(F.lit("EFFECTIVE"))).otherwise(no_text).alias("legal_statuses"),
        F.when(q % 4 == 2, F.array(q * 3 % n, (q * 5 + 1) % n)).when(q % 4 == 1, F.array(q * 3 % n)).otherwise(no_id).alias("anchors"), F.when((q % 6 == 5) & (q % 4 == 1), "REFERS_TO").alias("goal"),
    )
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(v, "query_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, v, label`` of the passages that have a vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v.join(passages(spark, sf_dir).select("id", "label"), "id")


def _listed(values: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({i} + 1)::INT]"


CORPUS_SQL = f"""
n AS (SELECT count(*) AS n FROM documents),
u AS (SELECT doc_id AS id, {_listed(["Article", "Clause", "Appendix"], "doc_id % 3")} AS label, CASE WHEN doc_id % 3 < 2 THEN doc_id - doc_id % 3 END AS article_id, doc_id // 10 AS document_id, {_listed(KINDS, "doc_id // 10 % 4")} AS doc_type,
 CASE WHEN doc_id // 10 % 5 = 0 THEN 'EXPIRED' ELSE 'EFFECTIVE' END AS document_status, (DATE '2000-01-01' + (doc_id // 10 % 500)::INT)::DATE AS document_from, NULL::DATE AS document_to,
 CASE WHEN doc_id % 11 <> 0 THEN (DATE '2000-01-01' + (doc_id % 2000)::INT)::DATE END AS effective_from, CASE WHEN doc_id % 4 = 0 THEN (DATE '2000-01-01' + (doc_id % 2000 + 900)::INT)::DATE END AS effective_to,
 CASE WHEN doc_id % 6 = 0 THEN 'EXPIRED' ELSE 'EFFECTIVE' END AS legal_status, CASE WHEN doc_id % 2 = 0 THEN doc_id // 20 END AS family FROM documents),
e AS (SELECT *, type || ':' || head_id || '>' || tail_id AS relation_id FROM (
 SELECT doc_id AS head_id, {_listed(TYPES, "doc_id % 5")} AS type, (doc_id * 37 + 11) % n AS tail_id, CASE WHEN doc_id % 5 = 1 THEN (DATE '2001-01-01' + (doc_id % 1500)::INT)::DATE END AS since FROM documents, n
 UNION ALL SELECT doc_id - 1, 'CONTAINS', doc_id, NULL FROM documents WHERE doc_id % 3 = 1)),
r AS (SELECT item_id AS query_id, text, {_listed(INTENTS, "item_id % 6")} AS intent, CASE WHEN item_id % 5 <> 1 THEN DATE '2003-06-01' END AS query_date, CASE WHEN item_id % 3 = 0 THEN ['Law', 'Decree'] ELSE []::VARCHAR[] END AS doc_types,
 CASE WHEN item_id % 5 = 0 THEN ['EFFECTIVE'] ELSE []::VARCHAR[] END AS legal_statuses, CASE item_id % 4 WHEN 2 THEN [item_id * 3 % n, (item_id * 5 + 1) % n] WHEN 1 THEN [item_id * 3 % n] ELSE []::BIGINT[] END AS anchors,
 CASE WHEN item_id % 6 = 5 AND item_id % 4 = 1 THEN 'REFERS_TO' END AS goal, embedding AS vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id, n)"""
