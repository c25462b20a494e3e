"""Queries of state machines: reconciliation over a log of runs, and references resolved turn by turn in conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import reconciliation, resolution
from statuta.plans.registry import query
from statuta.runtime import table
from statuta.sources import statutes


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs made of the events: views and signups resolve a bundle, the others try to write it; every 13th comes late."""
    i, kind = F.col("event_id"), F.col("event_type")
    errors = F.array(*map(F.lit, ("bundle_target_conflict_in_graph", "partial_materialized_bundle_in_graph", "write_refused")))
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), (i % 8).cast("string")).alias("bundle_id"), i.alias("seq"), F.when(i % 13 == 0, i - 400).otherwise(i).alias("run"),
        F.when(kind.isin("view", "signup"), "resolve").otherwise("attempt").alias("kind"), F.when(i % 7 == 0, "UNRESOLVED").otherwise("RESOLVED").alias("resolution"), (i % 5 != 0).alias("external"), (i % 17 == 0).alias("self_reference"),
        F.array(F.concat(F.lit("d"), (F.floor("value") % 3).cast("string")), F.concat(F.lit("e"), (F.floor("value") % 2).cast("string"))).alias("targets"), (i % 6 != 0).alias("valid"),
        F.when(kind == "purchase", "COMMITTED").when(kind == "click", "NOT_COMMITTED").when(kind == "error", "UNKNOWN").alias("outcome"),
        F.when(kind == "click", F.get(errors, (i % 4).cast("int"))).when(kind == "error", "commit_outcome_unknown").alias("error"),
    )


RUNS_SQL = """log AS (
 SELECT user_id || ':' || event_id % 8 AS bundle_id, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN event_id - 400 ELSE event_id END AS run, event_type IN ('view', 'signup') AS resolves, event_id % 7 <> 0 AS sound, event_id % 5 <> 0 AS ext, event_id % 17 = 0 AS own,
  list_sort(['d' || (floor(value)::BIGINT % 3), 'e' || (floor(value)::BIGINT % 2)]) AS targets, event_id % 6 <> 0 AS valid, event_type AS kind,
  CASE event_type WHEN 'click' THEN ['bundle_target_conflict_in_graph', 'partial_materialized_bundle_in_graph', 'write_refused', NULL][event_id % 4 + 1] WHEN 'error' THEN 'commit_outcome_unknown' END AS error,
  row_number() OVER (PARTITION BY user_id || ':' || event_id % 8 ORDER BY event_id) AS n FROM events),
trace AS (
 SELECT bundle_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BIGINT AS last, NULL::BOOLEAN AS applied, NULL::VARCHAR AS status, NULL::VARCHAR AS reason, NULL::VARCHAR[] AS was, false AS wanted, []::VARCHAR[][] AS committed, 0::BIGINT AS attempts FROM (SELECT DISTINCT bundle_id FROM log)
 UNION ALL
 SELECT bundle_id, n, seq, CASE WHEN ok THEN run ELSE last END, ok,
  CASE WHEN NOT ok THEN status WHEN resolves THEN CASE WHEN same THEN status WHEN stuck THEN 'BLOCKED' WHEN sound AND ext THEN 'PENDING' ELSE 'NOT_APPLICABLE' END
   WHEN still THEN status WHEN moved THEN 'BLOCKED' WHEN NOT valid THEN 'FAILED' WHEN kind = 'purchase' THEN 'WRITTEN' WHEN contains(coalesce(error, ''), '_in_graph') THEN 'BLOCKED' ELSE 'FAILED' END,
  CASE WHEN NOT ok THEN reason WHEN resolves THEN CASE WHEN same THEN reason WHEN stuck THEN 'resolved_target_changed_after_materialization' WHEN own THEN 'self_reference_no_edge' WHEN sound AND NOT ext THEN 'local_reference_not_external' END
   WHEN still THEN reason WHEN moved OR (valid AND kind <> 'purchase' AND error = 'bundle_target_conflict_in_graph') THEN 'resolved_target_changed_after_materialization' WHEN NOT valid THEN 'external_reference_validation_failed' WHEN kind = 'purchase' THEN NULL ELSE coalesce(error, 'materialization_failed') END,
  CASE WHEN ok AND resolves THEN targets ELSE was END, CASE WHEN ok AND resolves THEN sound AND ext ELSE wanted END,
  CASE WHEN ok AND NOT resolves AND NOT still AND NOT moved AND valid AND kind = 'purchase' AND NOT list_contains(committed, was) THEN list_append(committed, was) ELSE committed END,
  attempts + (ok AND NOT resolves AND NOT still AND NOT moved AND valid)::BIGINT
 FROM (SELECT l.*, t.last, t.status, t.reason, t.was, t.wanted, t.committed, t.attempts, (t.last IS NULL AND resolves) OR coalesce(run > t.last, false) AS ok, t.was IS NOT NULL AND coalesce(targets = t.was, false) AS same,
   coalesce(len(t.committed) > 0 OR t.status IN ('WRITTEN', 'BLOCKED'), false) AS stuck, NOT t.wanted OR coalesce(t.status IN ('WRITTEN', 'BLOCKED'), false) AS still, len(t.committed) > 0 AND NOT list_contains(t.committed, t.was) AS moved
  FROM trace t JOIN log l ON l.bundle_id = t.bundle_id AND l.n = t.n + 1))"""


@query(f"WITH RECURSIVE {RUNS_SQL} SELECT bundle_id, seq, applied, status, reason, attempts, len(committed)::BIGINT AS n_committed FROM trace WHERE n > 0")
def ref9_reconciliation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF9: each bundle's state after each run of its history."""
    return reconciliation.reconciled(run_log(spark, sf_dir))


@query(f"WITH RECURSIVE {RUNS_SQL}, s AS (SELECT status FROM trace WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY n DESC) = 1) SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x.lower()}" for x in reconciliation.STATES) + " FROM s")
def agg26_materialization_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG26: how many bundles end in each state."""
    return reconciliation.counts(reconciliation.latest(reconciliation.reconciled(run_log(spark, sf_dir))))


#: The order in which the messages of every other conversation name, choose and point back.
ORDER = [7, 2, 6, 0, 1, 3, 4, 5]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' messages of all conversations; most also name a law, point back, choose or cancel."""
    c, turn = F.col("conv_id"), F.col("turn")
    n = table(spark, sf_dir, "documents").count()
    in_order = F.get(F.array(*map(F.lit, ORDER)), ((F.floor(c / 2) + F.floor(turn / 2)) % 8).cast("int"))
    k = F.when(c % 2 == 0, in_order).otherwise((c * 5 + F.floor(turn / 2) * 3 + turn % 2) % 8)
    number = lambda x: F.concat((x % n).cast("string"), F.lit("/2020/QH14"))
    added = (
        F.when(k == 0, F.concat(F.lit(" Điều 1 Luật số "), number(c), F.lit(" quy định gì?"))).when(k == 1, " điều này quy định gì?").when(k == 3, F.concat(F.lit(" Theo Điều "), (turn % 4 + 1).cast("string"), F.lit(" thì sao?")))
        .when(k == 6, " luật này còn hiệu lực?").when(k == 7, F.concat(F.lit(" Luật số "), number(c), F.lit(" và Luật số "), number(c * 7), F.lit("?"))).otherwise("")
    )
    text = F.when(k == 2, " 2. ").when(k == 4, "Hủy!").otherwise(F.concat("text", added))
    return table(spark, sf_dir, "conversations").where("role = 'user' and conv_id is not null and turn is not null").select("conv_id", "turn", text.alias("text"))


def named_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, type, number, article`` of the laws and their articles."""
    texts, _, documents = statutes.statutes(spark, sf_dir)
    numbers = documents.select(F.col("id").alias("document_id"), F.col("number").alias("of"))
    r = statutes.registry(texts, documents).where("type in ('Document', 'Article')").join(numbers, "document_id")
    article = F.when(F.col("type") == "Article", F.col("number"))
    return r.select("id", F.concat(F.coalesce(F.concat(F.lit("Điều "), article, F.lit(" ")), F.lit("")), F.lit("Luật "), "of").alias("label"), "type", F.col("of").alias("number"), article.alias("article"))


@query(f"""WITH RECURSIVE {statutes.STATUTES_SQL}, nd AS (SELECT count(*) AS n FROM documents),
m AS (SELECT conv_id, turn, k, conv_id % n AS a, conv_id * 7 % n AS b, turn % 4 + 1 AS art, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN {ORDER}[(conv_id // 2 + turn // 2) % 8 + 1] ELSE (conv_id * 5 + turn // 2 * 3 + turn % 2) % 8 END AS k FROM conversations WHERE role = 'user'), nd),
heads AS (SELECT DISTINCT document_id, id, regexp_extract(id, '_art(.*)$', 1) AS art FROM sunits WHERE type = 'Article'), first6 AS (SELECT art, list(id ORDER BY id)[1:6] AS ids FROM heads GROUP BY art),
asked AS (SELECT m.*, k IN (0, 3, 7) AS names, CASE k WHEN 0 THEN CASE WHEN h.id IS NULL THEN []::VARCHAR[] ELSE [h.id] END WHEN 3 THEN coalesce(f.ids, []::VARCHAR[]) WHEN 7 THEN list_distinct([a::VARCHAR, b::VARCHAR]) ELSE []::VARCHAR[] END AS raw, a, b FROM m LEFT JOIN heads h ON h.id = m.a || '_art1' LEFT JOIN first6 f ON f.art = m.art::VARCHAR),
msg AS (SELECT conv_id, turn, u, k, names, CASE WHEN k = 7 AND a <> b THEN [a::VARCHAR, b::VARCHAR] ELSE raw END AS found FROM asked),
talk AS (
 SELECT conv_id, 0::BIGINT AS u, NULL::BIGINT AS turn, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason, NULL::VARCHAR AS unit, NULL::VARCHAR[] AS pending, []::STRUCT(o BIGINT, id VARCHAR)[] AS focuses, 0::BIGINT AS n_focuses FROM (SELECT DISTINCT conv_id FROM msg)
 UNION ALL
 SELECT conv_id, u, turn, outcome, reason, unit, choices, CASE WHEN unit IS NULL THEN alive ELSE list_append(list_filter(alive, lambda f: f.id <> unit), {{'o': -u, 'id': unit}}) END, len(focus)::BIGINT FROM (
  SELECT *, CASE WHEN cancelled OR outcome = 'RESOLVED' OR outcome = 'STANDALONE' THEN NULL WHEN chosen THEN pending WHEN outcome = 'CLARIFY_RESTATE' THEN []::VARCHAR[] ELSE pool[1:5] END AS choices, CASE WHEN outcome <> 'RESOLVED' THEN NULL WHEN chosen THEN pending[2] ELSE pool[1] END AS unit FROM (
   SELECT *, CASE WHEN cancelled THEN 'CANCEL' WHEN chosen THEN CASE WHEN k = 2 AND len(pending) >= 2 THEN 'RESOLVED' ELSE 'CLARIFY_SELECT' END WHEN NOT names AND k NOT IN (1, 6) THEN 'STANDALONE' WHEN len(pool) = 1 THEN 'RESOLVED' WHEN len(pool) > 1 THEN 'CLARIFY_SELECT' ELSE 'CLARIFY_RESTATE' END AS outcome,
    CASE WHEN cancelled THEN NULL WHEN chosen THEN CASE WHEN k = 2 AND len(pending) >= 2 THEN 'PENDING_CLARIFICATION' ELSE 'SELECT_INPUT_INVALID' END WHEN NOT names AND k NOT IN (1, 6) THEN NULL WHEN len(pool) = 0 THEN 'REFERENT_NOT_FOUND' WHEN len(pool) = 1 THEN CASE WHEN names THEN 'CURRENT_MESSAGE' ELSE 'HISTORY_FOCUS' END WHEN names THEN 'SEVERAL_CANDIDATES' ELSE 'SEVERAL_FOCUSES' END AS reason
   FROM (SELECT *, CASE WHEN names THEN found WHEN k = 1 THEN list_filter(list_transform(focus, lambda f: f.id), lambda x: contains(x, '_art')) ELSE list_filter(list_transform(focus, lambda f: f.id), lambda x: NOT contains(x, '_art')) END AS pool FROM (
     SELECT conv_id, u, turn, k, names, found, pending, alive, list_sort(alive)[1:5] AS focus, pending IS NOT NULL AND k = 4 AS cancelled, pending IS NOT NULL AND k <> 4 AND len(pending) > 0 AS chosen
     FROM (SELECT g.conv_id, g.u, g.turn, g.k, g.names, g.found, t.pending, list_filter(t.focuses, lambda f: g.u + f.o <= 5) AS alive FROM talk t JOIN msg g ON g.conv_id = t.conv_id AND g.u = t.u + 1))))))
SELECT conv_id::VARCHAR AS conv_id, turn, outcome, reason, unit, coalesce(array_to_string(pending, ','), '') AS choices, n_focuses FROM talk WHERE u > 0""")
def ref17_conversation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF17, REF15, REF18, WIN7, WIN8: what each message of each conversation refers to, by its own words and by the turns before it."""
    return resolution.resolved(messages(spark, sf_dir), named_units(spark, sf_dir))
