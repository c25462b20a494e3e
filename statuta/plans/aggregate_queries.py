"""Queries of aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import quality_report, ranking
from statuta.operators.components import connected_components
from statuta.plans.registry import query
from statuta.runtime import table
from statuta.sources.units import EDGES_SQL, UNITS_SQL, edges, units


@query(f"WITH {UNITS_SQL}, {EDGES_SQL} SELECT 'label' AS kind, label AS name, count(*) AS n FROM units GROUP BY label UNION ALL SELECT 'relation', type, count(*) FROM edges GROUP BY type")
def agg1_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report.counts_by_kind(units(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH {UNITS_SQL}, {EDGES_SQL}, d AS (SELECT id, count(*) AS n FROM units GROUP BY id), r AS (SELECT head_id, type, tail_id, count(*) AS n FROM edges GROUP BY ALL)
SELECT (SELECT count(*) FROM d WHERE n > 1) AS duplicate_ids, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM d) AS extra_ids, (SELECT count(*) FROM r WHERE n > 1) AS duplicate_edges, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM r) AS extra_edges""")
def agg2_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report.duplicates(units(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH {UNITS_SQL}, {EDGES_SQL}, n AS (SELECT DISTINCT id, label FROM units), ends AS (SELECT head_id AS id FROM edges WHERE type <> 'CONTAINS' UNION ALL SELECT tail_id FROM edges WHERE type <> 'CONTAINS'), g AS (SELECT id, count(*) AS d FROM ends GROUP BY id)
SELECT label, count(*) AS n_nodes, count(*) FILTER (d IS NULL) AS n_orphans, max(coalesce(d, 0)) AS most, avg(coalesce(d, 0)) AS mean FROM n LEFT JOIN g USING (id) GROUP BY label""")
def agg5_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report.degrees(units(spark, sf_dir).select("id", "label").distinct(), edges(spark, sf_dir).where("type <> 'CONTAINS'"))


@query(f"WITH {UNITS_SQL} SELECT label, count(*) AS total, count(effective_to) AS covered, CASE WHEN count(*) = 0 THEN 1.0 ELSE count(effective_to) / count(*) END AS coverage FROM units GROUP BY label")
def agg7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report.coverage(units(spark, sf_dir), "label", "effective_to")


@query(f"WITH {UNITS_SQL}, {EDGES_SQL}, n AS (SELECT count(DISTINCT id) AS n FROM units), e AS (SELECT count(*) AS e FROM edges) SELECT e / (n::DOUBLE * (n - 1)) AS density, 2.0 * e / n AS average_degree FROM n, e")
def agg8_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report.density(units(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {UNITS_SQL}, {EDGES_SQL}, a AS (SELECT DISTINCT id FROM units WHERE label = 'Article'), s AS (SELECT head_id AS id FROM edges WHERE type <> 'CONTAINS' UNION SELECT tail_id FROM edges WHERE type <> 'CONTAINS') SELECT count(s.id) / count(*) AS coverage FROM a LEFT JOIN s USING (id)")
def agg9_article_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report.semantic_coverage(units(spark, sf_dir), edges(spark, sf_dir), "Article")


DECIDED = """CASE WHEN l_discount > 0.08 THEN 'rejected' WHEN l_tax > 0.05 OR l_quantity < 10 THEN 'review' ELSE 'accepted' END"""


@query(f"WITH d AS (SELECT {DECIDED} AS decision, l_returnflag AS reason FROM lineitem) SELECT decision, reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS rate FROM d GROUP BY ALL")
def agg10_decision_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_discount") > 0.08, "rejected").when((F.col("l_tax") > 0.05) | (F.col("l_quantity") < 10), "review").otherwise("accepted").alias("decision"), F.col("l_returnflag").alias("reason"))
    return quality_report.histogram(d, ["decision", "reason"])


@query("SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_totalprice < 1000 THEN 1 ELSE 0 END)::BIGINT AS violations, avg(CASE WHEN o_totalprice < 1000 THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY o_custkey ORDER BY violations DESC, o_custkey LIMIT 50")
def agg12_first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("o_totalprice") < 1000, 1).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("violations"), F.avg(bad.cast("double")).alias("rate")).orderBy(F.desc("violations"), "o_custkey").limit(50)


@query("SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT lpad(l_partkey::VARCHAR, 8, '0'))), ',') AS parts FROM lineitem GROUP BY ALL")
def agg13_distinct_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("part")).distinct()
    return parts.groupBy("l_suppkey", "l_returnflag").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("parts"))


@query("SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT CASE WHEN length(l_partkey::VARCHAR) < 8 THEN lpad(l_partkey::VARCHAR, 8, '0') ELSE l_partkey::VARCHAR END)), ',') AS parts FROM lineitem GROUP BY ALL")
def agg13_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of agg13_distinct_collect of all lines; repeats go before anything is collected."""
    key = F.col("l_partkey").cast("string")
    each = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.when(F.length(key) < 8, F.lpad(key, 8, "0")).otherwise(key).alias("part")).distinct()
    return each.groupBy("l_suppkey", "l_returnflag").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("parts"))


@query("WITH b AS (SELECT l_orderkey AS bundle, count(*) AS n, count(DISTINCT l_quantity::INTEGER % 4) AS kinds, max(l_quantity::INTEGER % 4) AS expected FROM lineitem GROUP BY l_orderkey) SELECT bundle, n, CASE WHEN kinds <> 1 THEN 'conflict' WHEN expected < 1 THEN 'invalid' WHEN expected <> n THEN 'incomplete' ELSE 'complete' END AS status FROM b")
def agg15_bundle_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle"), (F.col("l_quantity").cast("int") % 4).alias("expected"))
    return quality_report.bundle_completeness(li, "bundle", "expected")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS capabilities, list_contains(list(DISTINCT event_type), 'purchase') AS can_buy FROM events GROUP BY user_id")
def agg17_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.collect_set("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(kinds), ",").alias("capabilities"), F.array_contains(kinds, "purchase").alias("can_buy"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'xx') AS xx FROM documents GROUP BY source")
def agg19_zero_filled_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "xx"]).count().na.fill(0)


@query("SELECT l.quality, avg(CASE WHEN l.toxic = 1 THEN 1.0 WHEN l.toxic = 0 AND l.doc_id % 3 > 0 THEN 0.0 END) AS rate FROM labels l GROUP BY l.quality")
def agg20_nullable_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("toxic") == 1, 1.0).when((F.col("toxic") == 0) & (F.col("doc_id") % 3 > 0), 0.0)
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.avg(flag).alias("rate"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, median(value) AS p50, max(value) FILTER (i = greatest(1, floor(n * 0.95))) AS p95_floor, max(value) FILTER (i = ceil(n * 0.95)) AS p95_ceil FROM r GROUP BY event_type""")
def agg21_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'missing') AS missing, min(event_id) FILTER (event_type = 'click') AS next_job, arg_min(event_id, value * 1000000000 + event_id) AS cheapest, bool_and(event_type = 'click') AS complete FROM events GROUP BY user_id""")
def agg23_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "missing").alias("missing"), F.min(F.when(kind == "click", F.col("event_id"))).alias("next_job"),
        F.min_by("event_id", F.struct("value", "event_id")).alias("cheapest"), F.bool_and(kind == "click").alias("complete"),
    )


@query("SELECT o_orderpriority AS family, count(DISTINCT o_custkey) AS documents FROM orders GROUP BY o_orderpriority HAVING count(DISTINCT o_custkey) >= 2")
def agg25_version_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count_distinct("o_custkey").alias("documents")).where("documents >= 2")


@query("SELECT p_brand, sha256(array_to_string(list_sort(list(DISTINCT lpad(p_partkey::VARCHAR, 9, '0'))), chr(10))) AS content FROM part GROUP BY p_brand")
def agg27_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(quality_report.set_hash(F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("content"))


@query("""WITH c AS (SELECT doc_id AS case_id, (doc_id % 97) / 97.0 AS score, (doc_id % 31) / 31.0 AS margin, quality = 1 AS good FROM labels), t AS (SELECT s.range / 100.0 AS min_score, m.range / 20.0 AS min_margin FROM range(1, 101) s, range(1, 21) m),
g AS (SELECT min_score, min_margin, count(*) FILTER (score >= min_score AND margin >= min_margin AND good) AS correct, count(*) FILTER (score >= min_score AND margin >= min_margin AND NOT good) AS wrong FROM c, t GROUP BY ALL)
SELECT min_score, min_margin, correct, wrong FROM g ORDER BY wrong, correct DESC, min_score, min_margin LIMIT 1""")
def agg29_calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "labels").select(((F.col("doc_id") % 97) / 97.0).alias("score"), ((F.col("doc_id") % 31) / 31.0).alias("margin"), (F.col("quality") == 1).alias("good"))
    return quality_report.calibrate(cases, [i / 100.0 for i in range(1, 101)], [i / 20.0 for i in range(1, 21)])


@query("SELECT lower(p_type) AS entity, arg_max(p_name, length(p_name) * 10000000 - p_partkey) AS label, max(CASE WHEN p_size > 40 THEN 'Entity' END) AS kind FROM part GROUP BY lower(p_type)")
def agg30_entity_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("entity")).agg(F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("label"), F.max(F.when(F.col("p_size") > 40, "Entity")).alias("kind"))


@query(f"""WITH {UNITS_SQL}, f AS (SELECT id, family, effective_from, row_number() OVER (PARTITION BY family ORDER BY coalesce(effective_from, DATE '0001-01-01') DESC, id) AS n FROM units WHERE family IS NOT NULL)
SELECT id, family FROM f WHERE n = 1 UNION ALL SELECT id, family FROM units WHERE family IS NULL""")
def win2_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.validity import latest_version

    return latest_version(units(spark, sf_dir)).select("id", "family")


@query("""WITH p AS (SELECT l_suppkey AS query_id, l_partkey AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS path FROM lineitem),
f AS (SELECT query_id, unit, min(path) AS path FROM p GROUP BY ALL) SELECT query_id, unit, 1.0 / row_number() OVER (PARTITION BY query_id ORDER BY path) AS graph_score FROM f""")
def win3_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("unit"), path.alias("path"))
    first = p.groupBy("query_id", "unit").agg(F.min("path").alias("path"))
    return first.select("query_id", "unit", (1.0 / F.row_number().over(Window.partitionBy("query_id").orderBy("path"))).alias("graph_score"))


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS cost, sum(length(text)) OVER w AS running, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, running::BIGINT AS running FROM r WHERE n = 1 OR running <= 800""")
def win6_history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.running_budget(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], F.length("text"), 800).select("conv_id", "turn", "running")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rank, max(turn) OVER (PARTITION BY conv_id) - turn AS age FROM conversations) SELECT conv_id, turn, role, rank FROM r WHERE rank <= 5 AND age <= 5""")
def win7_recent_focuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("age", F.max("turn").over(Window.partitionBy("conv_id")) - F.col("turn"))
    return ranking.top_k(t, 5, ["conv_id"], [F.desc("turn"), "role"]).where("age <= 5").select("conv_id", "turn", "role", "rank")


LINES = """l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""


@query(f"""WITH {LINES}, s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS start FROM l),
h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[A-ZÀ-Þ][^ ]*[.]$') THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s)
SELECT doc_id, i::BIGINT AS line_no, start::BIGINT AS start_char, heading::BIGINT AS heading_line, coalesce(length(before), -1) AS before_length FROM h""")
def win9_line_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.sources.lines import headings, source_lines

    lines = headings(source_lines(table(spark, sf_dir, "documents")), "^[A-ZÀ-Þ][^ ]*[.]$")
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.select("doc_id", "line_no", "start_char", "heading_line", F.coalesce(F.length(before), F.lit(-1)).alias("before_length"))


@query("""WITH t AS (SELECT l_orderkey AS bundle, l_linenumber, l_partkey, CASE WHEN l_discount > 0.09 THEN 'rejected' ELSE 'accepted' END AS own FROM lineitem) SELECT bundle, l_linenumber, l_partkey, CASE WHEN max(own = 'rejected') OVER (PARTITION BY bundle) THEN 'rejected' ELSE own END AS decision FROM t""")
def win14_bundle_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.decisions import atomic_bundles

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle"), "l_linenumber", "l_partkey", F.when(F.col("l_discount") > 0.09, "rejected").otherwise("accepted").alias("decision"))
    return atomic_bundles(li, "bundle")


@query("""WITH r AS (SELECT l_partkey AS mention, l_suppkey AS candidate, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, candidate) AS n, lead(score) OVER (PARTITION BY mention ORDER BY score DESC, candidate) AS next FROM r)
SELECT mention, candidate, score, score - coalesce(next, 0.0) AS margin FROM w WHERE n = 1""")
def win16_top_and_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mention"), F.col("l_suppkey").alias("candidate")).agg(F.max("l_extendedprice").alias("score"))
    order = Window.partitionBy("mention").orderBy(F.desc("score"), "candidate")
    return scores.withColumns({"n": F.row_number().over(order), "next": F.lead("score").over(order)}).where("n = 1").select("mention", "candidate", "score", (F.col("score") - F.coalesce("next", F.lit(0.0))).alias("margin"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey OFFSET 20 LIMIT 30")
def top9_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 20, 30)


@query("""WITH n AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer) SELECT c_nationkey, c_custkey, rank, total, total > 7 AS truncated FROM n WHERE rank <= 7""")
def top10_capped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")))
    return ranking.top_k(c, 7, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "rank", "total", (F.col("total") > 7).alias("truncated"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END AS number FROM orders) SELECT o_custkey, number, row_number() OVER (PARTITION BY o_custkey ORDER BY regexp_extract(number, '^[0-9]+')::BIGINT, regexp_extract(number, '[a-z]*$')) AS place FROM a""")
def top11_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("b")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    numbers = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.col("o_orderkey").cast("string"), suffix).alias("number"))
    natural = [F.regexp_extract("number", "^[0-9]+", 0).cast("long"), F.regexp_extract("number", "[a-z]*$", 0)]
    return numbers.select("o_custkey", "number", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*natural)).alias("place"))


@query("""WITH j AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS status_rank FROM events) SELECT user_id, arg_min(event_id, status_rank * 1000000000 + event_id) AS claimed FROM j WHERE status_rank < 2 GROUP BY user_id""")
def top15_claim_next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    jobs = table(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("status_rank")).where("status_rank < 2")
    return jobs.groupBy("user_id").agg(F.min_by("event_id", F.struct("status_rank", "event_id")).alias("claimed"))


@query("""WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, (o_totalprice / 1000)::BIGINT AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000) * 1000 AS o_totalprice FROM orders)),
p AS (SELECT o_custkey, 0::BIGINT AS rank, 0::BIGINT AS used, '' AS taken FROM r WHERE rank = 1 UNION ALL
 SELECT r.o_custkey, r.rank, CASE WHEN used + cost <= 600 THEN used + cost ELSE used END, CASE WHEN used + cost <= 600 THEN taken || ',' || o_orderkey ELSE taken END FROM p JOIN r ON r.o_custkey = p.o_custkey AND r.rank = p.rank + 1)
SELECT o_custkey, substr(arg_max(taken, rank), 2) AS taken, arg_max(used, rank) AS used FROM p GROUP BY o_custkey""")
def top16_greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("cost"))
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("cost"), "o_orderkey")))
    return ranking.greedy_pack(ranked, ["o_custkey"], "rank", "o_orderkey", "cost", 600).select("o_custkey", F.array_join("taken", ",").alias("taken"), "used")


@query("""WITH b AS (SELECT o_custkey, o_orderpriority AS bundle, min(o_orderkey) AS first, sum(floor(o_totalprice / 1000))::BIGINT AS cost FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first, cost, bundle) AS n FROM b WHERE cost <= 300) SELECT o_custkey, bundle, cost FROM r WHERE n = 1""")
def top17_cheapest_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("bundle")).agg(F.min("o_orderkey").alias("first"), F.sum(F.floor(F.col("o_totalprice") / 1000)).alias("cost"))
    return ranking.top_k(b.where("cost <= 300"), 1, ["o_custkey"], ["first", "cost", "bundle"]).select("o_custkey", "bundle", "cost")


@query("""WITH c AS (SELECT 1 AS ctx, doc_id AS unit, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT 2, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ctx, pos) AS n FROM c) SELECT unit, ctx, pos FROM f WHERE n = 1""")
def set4_merge_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.sets import merge_contexts

    d = table(spark, sf_dir, "documents")
    # the first context has two of three documents, the second all of them
    a = d.where("doc_id % 3 < 2").select(F.lit(1).alias("ctx"), F.col("doc_id").alias("unit"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("pos"))
    b = d.select(F.lit(2).alias("ctx"), F.col("doc_id").alias("unit"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("pos"))
    return merge_contexts(a.unionByName(b), "unit", ["ctx", "pos"]).select("unit", "ctx", "pos")


@query("SELECT DISTINCT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set5_missing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").distinct().join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH t AS (SELECT a.doc_id, list_distinct(string_split(lower(a.text), ' ')) AS x, list_distinct(string_split(lower(b.text), ' ')) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, len(list_intersect(x, y)) / len(x) AS overlap FROM t""")
def set9_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.sets import token_overlap

    d = table(spark, sf_dir, "documents")
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(b, "doc_id").select("doc_id", token_overlap(F.col("text"), F.col("other")).alias("overlap"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, few AS (SELECT DISTINCT head_id AS a, tail_id AS b FROM edges WHERE type = 'AMENDS'), sides AS (SELECT a, b FROM few UNION SELECT b, a FROM few),
reach AS (SELECT a AS node, a AS seen FROM sides UNION SELECT r.node, s.b FROM reach r JOIN sides s ON s.a = r.seen) SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def grf8_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("type = 'AMENDS'")
    return connected_components(e.select(F.col("head_id").alias("src"), F.col("tail_id").alias("dst")))
