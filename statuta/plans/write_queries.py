"""Queries of merges and guarded writes, and of page discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.plans.registry import query
from statuta.runtime import table
from statuta.sources import files, upsert
from statuta.sources.units import UNITS_SQL, units


@query("""WITH n AS (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'new ' || c_name END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer)
SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o FULL JOIN n USING (c_custkey)""")
def snk1_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("new "), F.col("c_name"))).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return upsert.merged(old, new, "c_custkey")


@query(f"""WITH {UNITS_SQL}, e AS (SELECT l_orderkey AS bundle, 'd' || (l_suppkey * 3) AS tail_id, l_linenumber FROM lineitem), c AS (SELECT bundle, count(*) AS n FROM e GROUP BY bundle), d AS (SELECT DISTINCT id FROM units WHERE label = 'Document' AND legal_status <> 'PENDING'),
f AS (SELECT e.bundle FROM e LEFT JOIN d ON d.id = e.tail_id GROUP BY e.bundle HAVING count(*) = count(d.id)) SELECT bundle, tail_id, l_linenumber FROM e WHERE bundle IN (SELECT bundle FROM f)""")
def snk3_atomic_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle"), F.concat(F.lit("d"), (F.col("l_suppkey") * 3).cast("string")).alias("tail_id"), "l_linenumber")
    counted = e.join(e.groupBy("bundle").agg(F.count(F.lit(1)).alias("expected")), "bundle")
    nodes = units(spark, sf_dir).where("label = 'Document' and legal_status <> 'PENDING'")
    return upsert.whole_bundles(counted, nodes, "bundle", "expected").select("bundle", "tail_id", "l_linenumber")


@query("""WITH p AS (SELECT page_id, page_id // 10 AS page_index, page_id % 10 AS pos, regexp_replace(url, '[0-9]+.*$', '') AS url FROM pages) SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_index, pos) > 1 AS duplicate FROM p""")
def src10_page_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("page_index"), (F.col("page_id") % 10).alias("pos"), F.regexp_replace("url", "[0-9]+.*$", "").alias("url"))
    return files.search_pages(p).select("page_id", "url", "duplicate")


@query("""WITH RECURSIVE p AS (SELECT page_id, page_id // 50 AS search, page_id % 50 // 10 + 1 AS page_index, page_id % 10 AS pos, CASE WHEN page_id // 50 % 4 = 2 AND page_id % 50 // 10 = 2 THEN 'again' || page_id % 10 WHEN page_id // 50 % 4 = 2 AND page_id % 50 // 10 < 2 AND page_id % 10 < 10 AND page_id % 50 < 10 THEN 'again' || page_id % 10 ELSE url END AS url FROM pages WHERE NOT (page_id // 50 % 4 = 1 AND page_id % 50 // 10 = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY search, url ORDER BY page_index, pos) = 1 AS fresh FROM p), c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY search ORDER BY page_index, pos) AS so_far FROM n), g AS (SELECT search, page_index, count(*) FILTER (fresh) AS k FROM n GROUP BY ALL),
walk AS (SELECT search, 1::BIGINT AS page_index FROM g WHERE page_index = 1 UNION ALL SELECT w.search, w.page_index + 1 FROM walk w JOIN g now ON now.search = w.search AND now.page_index = w.page_index JOIN g nxt ON nxt.search = w.search AND nxt.page_index = w.page_index + 1 WHERE now.k > 0 AND w.page_index < 4)
SELECT page_id, search, page_index, NOT fresh AS duplicate FROM c JOIN walk USING (search, page_index) WHERE so_far < 35 OR (so_far = 35 AND fresh)""")
def src10_walked_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10 whole: searches of five pages that go on until a page is missing or has nothing new, four pages or 35 documents."""
    i = F.col("page_id")
    search, page = F.floor(i / 50), F.floor(i % 50 / 10) + 1
    again = (search % 4 == 2) & page.isin(1, 3)
    p = table(spark, sf_dir, "pages").where(~((search % 4 == 1) & (page == 4))).select("page_id", search.alias("search"), page.alias("page_index"), (i % 10).alias("pos"), F.when(again, F.concat(F.lit("again"), (i % 10).cast("string"))).otherwise(F.col("url")).alias("url"))
    return files.discovered(p, ["search"], 4, 35).select("page_id", "search", "page_index", "duplicate")
