"""Queries of plans that are run over the graph of the order tables: plans as rows, gold cases and cases that must fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import planning, ranking
from statuta.plans.registry import query
from statuta.plans.retrieval_queries import VECTORS_SQL, ret1_vector_channel
from statuta.runtime import checkpointed, table
from statuta.sources.units import EDGES_SQL, UNITS_SQL, edges, units

DAY = "1996-01-01"


def _steps(*steps: tuple[str, str, str]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(d).alias("direction"), F.lit(n).alias("label")) for r, d, n in steps])


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The edges and nodes; clauses and articles can be cited, documents can't."""
    u = units(spark, sf_dir)
    nodes = u.select("id", "label", F.when(F.col("label") != "Document", F.col("id")).alias("citable"), "effective_from", "effective_to")
    return checkpointed(edges(spark, sf_dir).select("head_id", "type", "tail_id", "effective_from")), checkpointed(nodes)


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five plans for each document: what its articles amend, what its clauses refer to, who amends it, to any target, and one of a single step."""
    c = F.col("c_custkey")
    doc = lambda x: F.concat(F.lit("d"), x.cast("string"))
    amended, day, none = doc((c * 7) % 97 + 1), F.lit(DAY).cast("date"), F.lit(None).cast("string")
    kinds = {
        "amends": (doc(c), amended, _steps(("CONTAINS", "outgoing", "Article"), ("AMENDS", "outgoing", "Document")), day),
        "refers": (doc(c), doc(c % 10 + 1), _steps(("CONTAINS", "outgoing", "Article"), ("CONTAINS", "outgoing", "Clause"), ("REFERS_TO", "outgoing", "Document")), F.lit(None).cast("date")),
        "amended": (amended, doc(c), _steps(("AMENDS", "incoming", "Article"), ("CONTAINS", "incoming", "Document")), day),
        "any": (doc(c), none, _steps(("CONTAINS", "outgoing", "Article"), ("AMENDS", "outgoing", "Document")), F.lit(None).cast("date")),
        "short": (doc(c), amended, _steps(("CONTAINS", "outgoing", "Article")), day),
    }
    each = [F.struct(F.concat(F.lit(f"{name}:"), c.cast("string")).alias("plan_id"), a.alias("anchor"), t.alias("target"), s.alias("steps"), d.alias("query_date")) for name, (a, t, s, d) in kinds.items()]
    return table(spark, sf_dir, "customer").select(F.explode(F.array(*each)).alias("p")).select("p.*")


PATHS_SQL = f"""{UNITS_SQL}, {EDGES_SQL}, docs AS (SELECT DISTINCT id FROM units WHERE label = 'Document'), arts AS (SELECT id, min(effective_from) AS f, max(effective_to) AS t FROM units WHERE label = 'Article' GROUP BY id), dd AS (SELECT id, min(effective_from) AS f, max(effective_to) AS t FROM units WHERE label = 'Document' GROUP BY id),
am AS (SELECT a.head_id AS doc, a.tail_id AS art, b.tail_id AS target, b.effective_from AS since FROM edges a JOIN edges b ON b.head_id = a.tail_id WHERE a.type = 'CONTAINS' AND b.type = 'AMENDS' AND a.head_id IN (FROM docs) AND b.tail_id IN (FROM docs) AND a.head_id <> b.tail_id),
rf AS (SELECT a.head_id AS doc, a.tail_id AS art, b.tail_id AS cl, c.tail_id AS target FROM edges a JOIN edges b ON b.head_id = a.tail_id JOIN edges c ON c.head_id = b.tail_id WHERE a.type = 'CONTAINS' AND b.type = 'CONTAINS' AND c.type = 'REFERS_TO' AND a.head_id IN (FROM docs) AND c.tail_id IN (FROM docs) AND a.head_id <> c.tail_id),
plans AS (SELECT c_custkey AS c, 'd' || c_custkey AS doc, 'd' || (c_custkey * 7 % 97 + 1) AS amended, 'd' || (c_custkey % 10 + 1) AS referred FROM customer),
ways AS (
 SELECT 'amends:' || c AS plan_id, [p.doc, art, target] AS nodes, ['CONTAINS', 'AMENDS'] AS types, [art] AS citable, since, true AS dated FROM plans p JOIN am ON am.doc = p.doc AND am.target = p.amended
 UNION ALL SELECT 'refers:' || c, [p.doc, art, cl, target], ['CONTAINS', 'CONTAINS', 'REFERS_TO'], [art, cl], NULL, false FROM plans p JOIN rf ON rf.doc = p.doc AND rf.target = p.referred
 UNION ALL SELECT 'amended:' || c, [p.amended, art, p.doc], ['AMENDS', 'CONTAINS'], [art], since, true FROM plans p JOIN am ON am.doc = p.doc AND am.target = p.amended
 UNION ALL SELECT 'any:' || c, [p.doc, art, target], ['CONTAINS', 'AMENDS'], [art], since, false FROM plans p JOIN am ON am.doc = p.doc),
held AS (SELECT w.*, NOT dated OR (coalesce(since <= DATE '{DAY}', true) AND NOT EXISTS (SELECT 1 FROM (FROM arts UNION ALL FROM dd) n WHERE list_contains(w.nodes, n.id) AND NOT (coalesce(f <= DATE '{DAY}', false) AND (t IS NULL OR t > DATE '{DAY}')))) AS ok FROM ways w),
told AS (SELECT plan_id, count(*) AS n, count(DISTINCT (nodes, types)) FILTER (ok) AS n_ok, min((nodes, types, citable)) FILTER (ok) AS path FROM held GROUP BY plan_id),
every AS (SELECT unnest(['amends', 'refers', 'amended', 'any', 'short']) || ':' || c AS plan_id FROM plans),
outcome AS (SELECT plan_id, CASE WHEN starts_with(plan_id, 'short') THEN 'INVALID_PLAN' WHEN coalesce(n, 0) > 4 THEN 'PATH_BUDGET_EXCEEDED' WHEN n IS NULL THEN 'NO_PATH' WHEN n_ok = 0 THEN 'TEMPORAL_REJECTED' WHEN n_ok > 1 THEN 'AMBIGUOUS_PATH' ELSE 'SATISFIED' END AS reason, path FROM every LEFT JOIN told USING (plan_id))"""


@query(f"WITH {PATHS_SQL} SELECT plan_id, reason, CASE WHEN reason = 'SATISFIED' THEN array_to_string(path[1], '>') END AS nodes, CASE WHEN reason = 'SATISFIED' THEN array_to_string(path[2], '>') END AS types, CASE WHEN reason = 'SATISFIED' THEN array_to_string(path[3], ',') END AS citable FROM outcome")
def pln7_executed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN7, JON7, GRF12, GRF14, TOP8: five plans for each document, run together, each with what came of it."""
    out = planning.executed(_plans(spark, sf_dir), *_graph(spark, sf_dir), budget=4)
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return out.select("plan_id", "reason", joined("nodes", ">"), joined("types", ">"), joined("citable", ","))


@query(f"""WITH {PATHS_SQL}, urgent AS (SELECT 'd' || o_custkey AS doc, o_custkey AS c, min('d' || o_custkey || '_art' || o_orderkey) AS art FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) = 1),
gold AS (SELECT u.c, 'd' || (u.c * 7 % 97 + 1) AS target, art, u.doc FROM urgent u WHERE u.doc <> 'd' || (u.c * 7 % 97 + 1)),
real AS (SELECT g.*, target IN (FROM docs) AS there FROM gold g)
SELECT 'gold:' || c AS plan_id, CASE WHEN there THEN 'SATISFIED' ELSE 'NO_PATH' END AS reason, there AS exact, there AS passed FROM real
UNION ALL SELECT 'reversed:' || c, 'NO_PATH', false, true FROM real UNION ALL SELECT 'missing:' || c, 'NO_PATH', false, true FROM real""")
def evl13_gold_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL13: gold plans run to their exact path; with a step reversed, and with an edge taken out of the graph, they must find none."""
    e, nodes = _graph(spark, sf_dir)
    doc = lambda x: F.concat(F.lit("d"), x.cast("string"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").join(known, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat(doc(F.col("o_custkey")), F.lit("_art"), F.col("o_orderkey").cast("string"))).alias("art")).where("n = 1")
    c = F.col("o_custkey")
    gold = checkpointed(urgent.select("o_custkey", doc(c).alias("anchor"), doc((c * 7) % 97 + 1).alias("target"), "art").where("anchor <> target"))
    out_, back = (("CONTAINS", "outgoing", "Article"), ("AMENDS", "outgoing", "Document")), (("CONTAINS", "incoming", "Article"), ("AMENDS", "outgoing", "Document"))

    def named(kind: str, steps: tuple) -> DataFrame:
        return gold.select(F.concat(F.lit(f"{kind}:"), c.cast("string")).alias("plan_id"), "anchor", "target", _steps(*steps).alias("steps"), F.lit(None).cast("date").alias("query_date"), F.array("anchor", "art", "target").alias("expected_nodes"), F.array(F.lit("CONTAINS"), F.lit("AMENDS")).alias("expected_types"), F.lit("SATISFIED" if kind == "gold" else "NO_PATH").alias("expected_reason"))

    # the graph without the gold cases' amending edges
    torn = e.join(gold.select(F.col("art").alias("head_id"), F.lit("AMENDS").alias("type")), ["head_id", "type"], "left_anti").select(e.columns)
    whole, broken = named("gold", out_).unionByName(named("reversed", back)), named("missing", out_)
    done = planning.executed(whole, e, nodes).unionByName(planning.executed(broken, torn, nodes))
    return planning.gold_verdicts(whole.unionByName(broken), done)


@query(f"""WITH {VECTORS_SQL}, r AS (SELECT query_id, id, rank FROM vtop WHERE rank <= 10), rel AS (SELECT vec_id AS id, vec_id // 7 AS grp, vec_id % 4 AS relevance FROM embeddings),
got AS (SELECT query_id, grp, min(rank) AS first, max(relevance) AS relevance FROM r JOIN rel USING (id) GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM got),
ideal AS (SELECT grp, max(relevance) AS relevance FROM rel GROUP BY grp HAVING max(relevance) > 0), best AS (SELECT sum((2 ** relevance - 1) / log2(n + 1)) AS ideal FROM (SELECT relevance, row_number() OVER (ORDER BY relevance DESC, grp) AS n FROM ideal) WHERE n <= 5)
SELECT query_id, sum((2 ** relevance - 1) / log2(place + 1)) FILTER (place <= 5) / any_value(ideal) AS grouped_ndcg FROM placed, best GROUP BY query_id""")
def evl5_grouped_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL5, EVL6: graded nDCG over relevance groups: a group counts once, at its first unit, with the best grade that was returned of it."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 7).alias("grp"), (F.col("vec_id") % 4).cast("int").alias("relevance"))
    ranked = ret1_vector_channel(spark, sf_dir).select("query_id", "id", "rank")
    gold = ranked.select("query_id").distinct().crossJoin(F.broadcast(v.groupBy("grp").agg(F.max("relevance").alias("relevance")).where("relevance > 0").orderBy(F.desc("relevance"), "grp").limit(5)))
    return ranking.grouped_ndcg(ranked.join(v, "id"), gold, 5)
