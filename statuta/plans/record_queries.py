"""Queries of record checks, references in conversations, windows over lines and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import conversation, records, routing
from statuta.plans.document_queries import LAW_SQL, laws
from statuta.plans.registry import query
from statuta.runtime import table
from statuta.sources import lines
from statuta.sources.units import UNITS_SQL, units

LINES_SQL = """pieces AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS p FROM documents), lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS line_no FROM pieces)"""


@query(f"""WITH {LINES_SQL}, e AS (SELECT doc_id, line_no, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS end_char FROM lines) SELECT doc_id, line_no, (end_char - length(line))::BIGINT AS start_char, end_char::BIGINT AS end_char FROM e""")
def src5_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.source_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "start_char", "end_char")


@query(f"""WITH {LINES_SQL}, c AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, length(line) < 60 AND coalesce(before, '') NOT LIKE '%,' AND length(coalesce(after, '')) > length(line) AS heading FROM c""")
def win10_line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before, after = F.coalesce(F.lag("line").over(order), F.lit("")), F.coalesce(F.lead("line").over(order), F.lit(""))
    heading = (F.length("line") < 60) & ~before.endswith(",") & (F.length(after) > F.length("line"))
    return lines.source_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", heading.alias("heading"))


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM lines)
SELECT doc_id, line_no, coalesce(len(list_filter(list_filter(ahead, lambda x: trim(x) <> '')[1:3], lambda x: contains(x, 'an'))) > 0, false) AS adopted FROM c""")
def win11_bounded_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.collect_list("line").over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, 5))
    near = F.slice(F.filter(ahead, lambda x: F.trim(x) != ""), 1, 3)
    return lines.source_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.exists(near, lambda x: F.contains(x, F.lit("an"))).alias("adopted"))


@query("""SELECT o_custkey AS doc_id, lower(o_orderstatus) AS label, string_agg(o_orderkey || ':' || o_orderpriority, ' ' ORDER BY o_orderkey) AS content FROM orders GROUP BY ALL""")
def win13_merged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_orderpriority"))
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", piece.alias("t"))))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.lower("o_orderstatus").alias("label")).agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("content"))


@query("""WITH q AS (SELECT conv_id, turn, translate(text, 'ae', '“”') AS p FROM conversations), i AS (SELECT *, strpos(reverse(p), '“') AS o, strpos(reverse(p), '”') AS c FROM q) SELECT conv_id, turn, o > 0 AND (c = 0 OR o < c) AS open FROM i""")
def win15_quote_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", conversation.open_quote(F.translate("text", "ae", "“”")).alias("open"))


@query("""WITH q AS (SELECT conv_id, turn, translate(text, 'ae', '“”') AS t FROM conversations), p AS (SELECT conv_id, turn, t, unnest(list_append(range(40, length(t), 40), length(t))) AS place FROM q),
i AS (SELECT conv_id, turn, place, strpos(reverse(substr(t, 1, place)), '“') AS o, strpos(reverse(substr(t, 1, place)), '”') AS c FROM p) SELECT conv_id, turn, place::BIGINT AS place, o > 0 AND (c = 0 OR o < c) AS open FROM i""")
def win15_quote_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote is open at every 40th character of a turn and at its end."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate("text", "ae", "“”").alias("t"))
    return t.select("conv_id", "turn", F.explode(conversation.quote_states(F.col("t"), 40)).alias("s")).select("conv_id", "turn", F.col("s.at").alias("place"), F.col("s.open").alias("open"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY first, role) AS place FROM f""")
def win5_stable_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return f.select("conv_id", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "role")).alias("place"))


@query("""WITH f AS (SELECT conv_id, length(text) % 4 AS focus, max(turn) AS turn FROM conversations GROUP BY ALL) SELECT conv_id, focus, turn, max(turn) OVER (PARTITION BY conv_id) - turn > 2 AS expired FROM f""")
def win8_focus_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "conversations").groupBy("conv_id", (F.length("text") % 4).alias("focus")).agg(F.max("turn").alias("turn"))
    return records.expired_focuses(f, "conv_id", "turn", 2)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, 1.0::DOUBLE / n AS score FROM r WHERE o_orderstatus <> 'F'""")
def win4_anchor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, sf_dir, "orders").withColumn("score", 1.0 / F.row_number().over(order))
    return ranked.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "score")


@query("""WITH r AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents), f AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM r WHERE n <= 20 AND source <> 'src0') SELECT lang, doc_id, rank FROM f WHERE rank <= 5""")
def top1_over_fetch_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.ranking import top_k

    d, order = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"]
    fetched = top_k(d, 4 * 5, ["lang"], order).where("source <> 'src0'").drop("rank")
    return top_k(fetched, 5, ["lang"], order).select("lang", "doc_id", "rank")


@query("""SELECT o_custkey, least(count(*), 12) AS n_probed, count(*) > 11 AS overflow FROM orders GROUP BY o_custkey""")
def top8_overflow_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.least(n, F.lit(12)).alias("n_probed"), (n > 11).alias("overflow"))


@query("""SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY last DESC, conv_id LIMIT 20 OFFSET 10""")
def top14_conversation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators.ranking import page

    return page(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")), [F.desc("last"), "conv_id"], 10, 20)


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Theo KHOẢN NÀY và điều này' WHEN 1 THEN 'Luật này sửa gì' ELSE text END AS text FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'khoản này' WHEN 1 THEN 'luật này' END AS phrase, CASE turn % 3 WHEN 0 THEN 'Theo Unit ' || conv_id || ' và điều này' WHEN 1 THEN 'Unit ' || conv_id || ' sửa gì' ELSE text END AS rewritten, turn % 3 < 2 AS kept FROM t""")
def ref16_anaphora_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    t = table(spark, sf_dir, "conversations").withColumn("text", F.when(k == 0, "Theo KHOẢN NÀY và điều này").when(k == 1, "Luật này sửa gì").otherwise(F.col("text")))
    unit = F.concat(F.lit("Unit "), F.col("conv_id").cast("string"))
    t = t.withColumn("phrase", conversation.anaphora(F.col("text"))).withColumn("rewritten", conversation.replace_first(F.col("text"), F.col("phrase"), unit))
    return t.select("conv_id", "turn", "phrase", "rewritten", conversation.anchors_kept(F.col("rewritten"), F.array(unit)).alias("kept"))


@query("""WITH l AS (SELECT o_custkey, list(DISTINCT 'L' || o_orderstatus ORDER BY 'L' || o_orderstatus) AS i, list(DISTINCT substr(o_orderpriority, 1, 1) ORDER BY substr(o_orderpriority, 1, 1)) AS n FROM orders GROUP BY o_custkey),
p AS (SELECT o_custkey, a AS identity, b AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY a, b) AS pos FROM (SELECT o_custkey, a, unnest(n) AS b FROM (SELECT o_custkey, n, unnest(i) AS a FROM l))) SELECT o_custkey, pos, identity, number FROM p WHERE pos <= 5""")
def ref15_explicit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("L"), "o_orderstatus"))).alias("i"), F.array_sort(F.collect_set(F.substring("o_orderpriority", 1, 1))).alias("n"))
    return named.select("o_custkey", F.posexplode(conversation.explicit_references(F.col("i"), F.col("n"))).alias("pos", "p")).select("o_custkey", (F.col("pos") + 1).cast("long").alias("pos"), "p.identity", "p.number")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem JOIN orders ON o_orderkey = l_partkey WHERE l_orderkey <> l_partkey) SELECT source, target, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN 'RANGE' ELSE 'DIRECT' END AS method FROM r""")
def ref8_reference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("named"))
    return records.reference_records(m.join(known, F.col("named") == F.col("target"), "left"), "source", "target")


@query(f"""WITH {LAW_SQL} SELECT doc_id || '_art' || o_orderkey AS unit_id, (length('Điều ' || o_orderkey || '. Order') + count(*))::BIGINT AS own_chars FROM clause GROUP BY doc_id, o_orderkey""")
def ref7_unit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.operators import hierarchy

    n = F.col("end_char") - F.col("start_char")
    u = hierarchy.spans(laws(spark, sf_dir)).where("label in ('Article', 'Clause')").withColumn("article", F.when(F.col("label") == "Article", F.col("unit_id")).otherwise(F.col("parent_id")))
    # an article meets its clauses in one pass over the units
    sums = u.groupBy(F.col("article").alias("unit_id")).agg(F.collect_list(F.when(F.col("label") == "Article", n)).alias("whole"), F.sum(F.when(F.col("label") == "Clause", n)).alias("inner"))
    return sums.select("unit_id", "inner", F.explode("whole").alias("n")).select("unit_id", (F.col("n") - F.coalesce("inner", F.lit(0))).alias("own_chars"))


@query("""SELECT l_orderkey AS bundle, concat_ws(',', CASE WHEN count(DISTINCT l_suppkey) < count(*) THEN 'repeated_target' END, CASE WHEN count(*) > 5 THEN 'too_many' END, CASE WHEN bool_or(l_quantity < 3) THEN 'weak_evidence' END, CASE WHEN bool_or(l_shipdate >= TIMESTAMP '2001-01-01') THEN 'not_yet_effective' END) AS reasons FROM lineitem GROUP BY l_orderkey""")
def ref10_bundle_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    checks = [("repeated_target", F.count_distinct("l_suppkey") < n), ("too_many", n > 5), ("weak_evidence", F.bool_or(F.col("l_quantity") < 3)), ("not_yet_effective", F.bool_or(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp")))]
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bundle")).agg(*[bad.alias(name) for name, bad in checks])
    return g.select("bundle", records.reasons([(name, F.col(name)) for name, _ in checks]).alias("reasons"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\bamend|the (an|or)') THEN 'AMENDS' WHEN regexp_matches(text, '(?i)\\band\\b') THEN 'REFERS_TO' WHEN regexp_matches(text, '(?i)\\bis\\b') THEN 'REQUIRES' END AS goal FROM conversations""")
def ref19_relation_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal = routing.classify(F.col("text"), [("AMENDS", r"(?iu)\bamend|the (an|or)"), ("REFERS_TO", r"(?i)\band\b"), ("REQUIRES", r"(?i)\bis\b")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", goal.alias("goal"))


@query(f"""WITH {UNITS_SQL} SELECT id, concat_ws(',', CASE WHEN legal_status NOT IN ('EFFECTIVE', 'EXPIRED') THEN 'bad_status' END, CASE WHEN effective_from IS NULL THEN 'no_start' END, CASE WHEN effective_to <= effective_from THEN 'empty_interval' END, CASE WHEN label <> 'Document' AND parent_id IS NULL THEN 'no_parent' END, CASE WHEN family IS NULL THEN 'no_family' END) AS errors FROM units""")
def val3_node_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        ("bad_status", ~F.col("legal_status").isin("EFFECTIVE", "EXPIRED")), ("no_start", F.col("effective_from").isNull()), ("empty_interval", F.col("effective_to") <= F.col("effective_from")),
        ("no_parent", (F.col("label") != "Document") & F.col("parent_id").isNull()), ("no_family", F.col("family").isNull()),
    ]
    return units(spark, sf_dir).select("id", records.reasons(checks).alias("errors"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing_k' WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'k_is_no_int' WHEN try_cast(event_type AS DOUBLE) IS NULL AND event_type <> 'click' THEN 'type_is_text' END AS error FROM events""")
def val2_property_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    error = F.when(k.isNull(), "missing_k").when(k.try_cast("int").isNull(), "k_is_no_int").when(F.col("event_type").try_cast("double").isNull() & (F.col("event_type") != "click"), "type_is_text")
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"))


@query("""SELECT p_partkey, substr(p_brand, 7) NOT IN ('1', '2', '12') AS conflict FROM part""")
def val17_number_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.regexp_extract_all(F.concat(F.lit("No "), F.substring("p_brand", 7, 9), F.lit(" of year")), F.lit(r"(\d+)"), F.lit(1))
    own = F.array(F.lit("1"), F.lit("2"), F.lit("12"))
    return table(spark, sf_dir, "part").select("p_partkey", (F.size(F.array_intersect(seen, own)) == 0).alias("conflict"))


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, (c_nationkey + (c_acctbal > 9000)::INT)::INT AS nation FROM customer)
SELECT c.c_custkey, concat_ws(',', CASE WHEN m.name IS DISTINCT FROM c.c_name THEN 'name' END, CASE WHEN m.nation IS DISTINCT FROM c.c_nationkey THEN 'nation' END) AS mismatched FROM customer c JOIN m USING (c_custkey)""")
def val18_identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    manifest = c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), (F.col("c_nationkey") + (F.col("c_acctbal") > 9000).cast("int")).alias("nation"))
    found = records.reasons([("name", ~F.col("name").eqNullSafe(F.col("c_name"))), ("nation", ~F.col("nation").eqNullSafe(F.col("c_nationkey")))])
    return c.join(manifest, "c_custkey").select("c_custkey", found.alias("mismatched"))


@query("""WITH j AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id FROM j JOIN l USING (user_id) WHERE n = 1 AND event_type <> 'purchase'""")
def ing9_ledger_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ledger = e.withColumn("status", F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "FAILED").otherwise("PENDING"))
    return records.ledger_remainder(e.select("user_id").distinct(), ledger, "user_id", "status", ["ts", "event_id"])


@query(f"""WITH {LAW_SQL}, n AS (SELECT doc_id, count(DISTINCT o_orderkey) + 2 * count(*) + 1 AS main FROM clause GROUP BY doc_id) SELECT doc_id, 'main' AS region, main AS n_lines FROM n UNION ALL SELECT doc_id, 'appendix', 3 FROM n""")
def ing3_source_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = laws(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nPHỤ LỤC I\na list\n1. not a clause")))
    marked = lines.headings(lines.source_lines(texts), r"(?iu)^phụ lục\s+[IVX\d]+\b")
    region = F.when(F.col("heading_line").isNull(), "main").otherwise("appendix")
    return marked.groupBy("doc_id", region.alias("region")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT page_id, CASE WHEN strpos(html, m) > 0 AND len(string_split(html, m)) = 2 THEN strpos(html, m) - 1 END AS start, CASE WHEN m IS NULL OR m = '' OR strpos(html, m) = 0 THEN 'missing' WHEN len(string_split(html, m)) = 2 THEN 'unique' ELSE 'repeated' END AS status FROM (SELECT page_id, html, substr(html, greatest(length(html) // 2, 1), 6) AS m FROM pages)""")
def src12_unique_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one place of each page's six middle characters."""
    return src12_all_spans(spark, sf_dir)


@query("""SELECT page_id, CASE WHEN strpos(html, m) > 0 AND len(string_split(html, m)) = 2 THEN strpos(html, m) - 1 END AS start, CASE WHEN m IS NULL OR m = '' OR strpos(html, m) = 0 THEN 'missing' WHEN len(string_split(html, m)) = 2 THEN 'unique' ELSE 'repeated' END AS status FROM (SELECT page_id, html, substr(html, greatest(length(html) // 2, 1), 6) AS m FROM pages)""")
def src12_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of src12_unique_spans of all pages; null and empty ones have none."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.expr("substr(html, cast(greatest(length(html) div 2, 1) as int), 6)").alias("m"))
    at, n = F.position(F.col("m"), F.col("html")), (F.length("html") - F.length(F.replace("html", F.col("m"), F.lit("")))) / F.length("m")
    status = F.when(F.coalesce(F.length("m"), F.lit(0)) == 0, "missing").when(at == 0, "missing").when(n == 1, "unique").otherwise("repeated")
    return p.select("page_id", F.when(status == "unique", (at - 1).cast("long")).alias("start"), status.alias("status"))


@query("""SELECT source, arg_max(doc_id, (CASE WHEN contains(text, '. ') THEN 1 ELSE 0 END) * 1000000000000 + n_chars * 100000 + 99999 - doc_id % 100000) AS body, max(CASE WHEN contains(text, '. ') THEN 1 ELSE 0 END) = 1 AS has_heading FROM documents WHERE text IS NOT NULL GROUP BY source""")
def src11_body_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("has", F.contains("text", F.lit(". ")).cast("int"))
    return d.groupBy("source").agg(F.max_by("doc_id", F.struct("has", "n_chars", -F.col("doc_id"))).alias("body"), (F.max("has") == 1).alias("has_heading"))


@query("""WITH r AS (SELECT l_orderkey AS query_id, list_sort(list(DISTINCT l_suppkey) FILTER (l_linenumber <= 2)) AS need, list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R') AS have FROM lineitem GROUP BY l_orderkey) SELECT query_id, len(list_filter(coalesce(need, []), lambda x: NOT list_contains(coalesce(have, []), x))) = 0 AS covered FROM r""")
def set8_fingerprint_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    need, have = F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey"))), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg((F.size(F.array_except(need, have)) == 0).alias("covered"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def set6_unknown_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("""SELECT lang AS variant, source, count(*) AS n, avg(CASE WHEN quality IS NULL THEN NULL ELSE quality::DOUBLE END) AS mean_quality, count(quality) * 2 >= count(*) AS enough_judged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def evl7_variant_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy(F.col("lang").alias("variant"), "source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("quality").cast("double")).alias("mean_quality"), (F.count("quality") * 2 >= F.count(F.lit(1))).alias("enough_judged"))


@query(f"""WITH {UNITS_SQL}, p AS (SELECT document_id, effective_from <= DATE '1996-01-01' AND (effective_to IS NULL OR effective_to > DATE '1996-01-01') AS said, legal_status = 'EFFECTIVE' AS gold FROM units WHERE label = 'Article') SELECT document_id, avg((said = gold)::INT) AS accuracy, bool_and(said = gold) AS complete FROM p GROUP BY document_id""")
def evl9_temporal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import date

    from statuta.operators.validity import valid_on

    right = valid_on(date(1996, 1, 1)) == (F.col("legal_status") == "EFFECTIVE")
    return units(spark, sf_dir).where("label = 'Article'").groupBy("document_id").agg(F.avg(right.cast("int")).alias("accuracy"), F.bool_and(right).alias("complete"))


@query(f"""WITH {UNITS_SQL}, f AS (SELECT family, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS members FROM units WHERE family IS NOT NULL GROUP BY family) SELECT family, n, members, n >= 2 AS complete FROM f""")
def gen3_required_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_sort(F.collect_set("id"))
    return units(spark, sf_dir).where("family is not null").groupBy("family").agg(F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("members"), (F.size(ids) >= 2).alias("complete"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 AND length(text) % 2 = 0 THEN 'CONFLICT' WHEN turn % 4 = 1 THEN 'EXPLICIT' WHEN length(text) % 2 = 0 THEN 'EXPRESSION' WHEN role = 'assistant' THEN 'NONE' ELSE 'DEFAULT' END AS temporal FROM conversations""")
def rte3_temporal_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, said, history = F.col("turn") % 4 == 1, F.length("text") % 2 == 0, F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.temporal_source(asked, said, asked & said, history).alias("temporal"))


@query("""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS part, unnest(range(len(string_split(text, '. ')))) AS pos FROM conversations WHERE role = 'user') SELECT conv_id, turn, pos::INT AS pos, trim(part) AS question, CASE WHEN pos > 0 THEN (pos - 1)::INT END AS depends_on FROM s WHERE trim(part) <> ''""")
def rte8_sub_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.sub_queries(table(spark, sf_dir, "conversations").where("role = 'user'"), "text", r"\. ").select("conv_id", "turn", "pos", "question", "depends_on")


@query("""SELECT o_orderkey, 'Luat ' || o_custkey || ', art. ' || o_orderkey AS label, coalesce(nullif(trim(substr(o_orderpriority, 3, 3)), 'LOW'), 'doc_' || o_orderkey) AS graph_id FROM orders""")
def str25_labels_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, owner = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    label = F.concat_ws(", ", F.concat(F.lit("Luat "), owner), F.concat(F.lit("art. "), key))
    graph_id = F.coalesce(F.nullif(F.trim(F.substring("o_orderpriority", 3, 3)), F.lit("LOW")), F.concat(F.lit("doc_"), key))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), graph_id.alias("graph_id"))


@query("""SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm, len(embedding) = 64 AS right_size FROM embeddings""")
def mth5_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, sf_dir, "embeddings").select("vec_id", norm.alias("norm"), (F.size("embedding") == 64).alias("right_size"))
