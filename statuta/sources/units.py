"""A structured-document graph seen in the order tables: customers as documents, orders as articles, lines as clauses.

The same views exist as DuckDB SQL (``UNITS_SQL``, ``EDGES_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.runtime import table


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, number, document_id, parent_id, effective_from, effective_to, legal_status, family, content``."""
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    none_d, none_s = F.lit(None).cast("date"), F.lit(None).cast("string")
    doc_id = F.concat(F.lit("d"), F.col("c_custkey").cast("string"))
    docs = c.select(
        doc_id.alias("id"), F.lit("Document").alias("label"), F.col("c_custkey").cast("string").alias("number"), doc_id.alias("document_id"), none_s.alias("parent_id"),
        F.when(F.col("c_custkey") % 10 != 0, F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))).alias("effective_from"), none_d.alias("effective_to"),
        F.when(F.col("c_acctbal") < 0, "EXPIRED").when(F.col("c_acctbal") < 5000, "EFFECTIVE").otherwise("PENDING").alias("legal_status"), none_s.alias("family"), F.col("c_name").alias("content"),
    )
    owner = F.concat(F.lit("d"), F.col("o_custkey").cast("string"))
    article = F.concat(owner, F.lit("_art"), F.col("o_orderkey").cast("string"))
    day = F.col("o_orderdate").cast("date")
    articles = o.select(
        article.alias("id"), F.lit("Article").alias("label"), F.col("o_orderkey").cast("string").alias("number"), owner.alias("document_id"), owner.alias("parent_id"),
        day.alias("effective_from"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 400)).alias("effective_to"),
        F.when(F.col("o_orderstatus") == "F", "EXPIRED").when(F.col("o_orderstatus") == "O", "EFFECTIVE").otherwise("PENDING").alias("legal_status"),
        F.concat(owner, F.lit("_"), F.substring("o_orderpriority", 1, 1)).alias("family"), F.col("o_orderpriority").alias("content"),
    )
    ship = F.col("l_shipdate").cast("date")
    keys = o.select("o_orderkey", "o_custkey")
    clauses = li.join(keys, li.l_orderkey == keys.o_orderkey).select(
        F.concat(article, F.lit("_cl"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("Clause").alias("label"), F.col("l_linenumber").cast("string").alias("number"), owner.alias("document_id"), article.alias("parent_id"),
        ship.alias("effective_from"), F.when(F.col("l_returnflag") == "R", F.date_add(ship, 200)).alias("effective_to"),
        F.when(F.col("l_linestatus") == "F", "EXPIRED").otherwise("EFFECTIVE").alias("legal_status"), none_s.alias("family"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("content"),
    )
    return docs.unionByName(articles).unionByName(clauses)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``head_id, type, tail_id, effective_from, citation_text``: containment, references to documents, amendments between articles."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    none_d, none_s = F.lit(None).cast("date"), F.lit(None).cast("string")
    owner = F.concat(F.lit("d"), F.col("o_custkey").cast("string"))
    article = F.concat(owner, F.lit("_art"), F.col("o_orderkey").cast("string"))
    keys = o.select("o_orderkey", "o_custkey")
    lines = li.join(keys, li.l_orderkey == keys.o_orderkey)
    clause = F.concat(article, F.lit("_cl"), F.col("l_linenumber").cast("string"))
    has = o.select(owner.alias("head_id"), F.lit("CONTAINS").alias("type"), article.alias("tail_id"), none_d.alias("effective_from"), none_s.alias("citation_text"))
    deeper = lines.select(article.alias("head_id"), F.lit("CONTAINS").alias("type"), clause.alias("tail_id"), none_d.alias("effective_from"), none_s.alias("citation_text"))
    refers = lines.where("l_returnflag = 'R'").select(clause.alias("head_id"), F.lit("REFERS_TO").alias("type"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("tail_id"), none_d.alias("effective_from"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("citation_text"))
    amends = o.where("o_orderpriority like '1%'").select(article.alias("head_id"), F.lit("AMENDS").alias("type"), F.concat(F.lit("d"), ((F.col("o_custkey") * 7) % 97 + 1).cast("string")).alias("tail_id"), F.col("o_orderdate").cast("date").alias("effective_from"), none_s.alias("citation_text"))
    return has.unionByName(deeper).unionByName(refers).unionByName(amends)


UNITS_SQL = """
units AS (
 SELECT 'd' || c_custkey AS id, 'Document' AS label, c_custkey::VARCHAR AS number, 'd' || c_custkey AS document_id, NULL::VARCHAR AS parent_id,
  CASE WHEN c_custkey % 10 <> 0 THEN (DATE '1992-01-01' + (c_custkey % 2000)::INTEGER)::DATE END AS effective_from, NULL::DATE AS effective_to,
  CASE WHEN c_acctbal < 0 THEN 'EXPIRED' WHEN c_acctbal < 5000 THEN 'EFFECTIVE' ELSE 'PENDING' END AS legal_status, NULL::VARCHAR AS family, c_name AS content FROM customer
 UNION ALL
 SELECT 'd' || o_custkey || '_art' || o_orderkey, 'Article', o_orderkey::VARCHAR, 'd' || o_custkey, 'd' || o_custkey, o_orderdate::DATE,
  CASE WHEN o_orderstatus = 'F' THEN (o_orderdate::DATE + 400)::DATE END,
  CASE WHEN o_orderstatus = 'F' THEN 'EXPIRED' WHEN o_orderstatus = 'O' THEN 'EFFECTIVE' ELSE 'PENDING' END,
  'd' || o_custkey || '_' || substr(o_orderpriority, 1, 1), o_orderpriority FROM orders
 UNION ALL
 SELECT 'd' || o_custkey || '_art' || o_orderkey || '_cl' || l_linenumber, 'Clause', l_linenumber::VARCHAR, 'd' || o_custkey, 'd' || o_custkey || '_art' || o_orderkey, l_shipdate::DATE,
  CASE WHEN l_returnflag = 'R' THEN (l_shipdate::DATE + 200)::DATE END, CASE WHEN l_linestatus = 'F' THEN 'EXPIRED' ELSE 'EFFECTIVE' END, NULL, l_returnflag || ' ' || l_linestatus
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EDGES_SQL = """
edges AS (
 SELECT 'd' || o_custkey AS head_id, 'CONTAINS' AS type, 'd' || o_custkey || '_art' || o_orderkey AS tail_id, NULL::DATE AS effective_from, NULL::VARCHAR AS citation_text FROM orders
 UNION ALL
 SELECT 'd' || o_custkey || '_art' || o_orderkey, 'CONTAINS', 'd' || o_custkey || '_art' || o_orderkey || '_cl' || l_linenumber, NULL, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL
 SELECT 'd' || o_custkey || '_art' || o_orderkey || '_cl' || l_linenumber, 'REFERS_TO', 'd' || l_suppkey, NULL, 'Part ' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
 UNION ALL
 SELECT 'd' || o_custkey || '_art' || o_orderkey, 'AMENDS', 'd' || ((o_custkey * 7) % 97 + 1), o_orderdate::DATE, NULL FROM orders WHERE o_orderpriority LIKE '1%')"""
