"""Hybrid retrieval for batches of questions: scoped seed channels, expansion by intent, two fusions, versions, pins.

Requests are rows ``query_id, text, vector, intent, query_date, document_ids, doc_types, legal_statuses, anchors, goal``; units are
rows ``id, label, article_id, document_id, doc_type, document_status, document_from, document_to, effective_from, effective_to,
legal_status, family``.  Every step is keyed by ``query_id``, so many questions run as one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators import fulltext
from statuta.operators.ranking import top_k
from statuta.runtime import checkpointed

# The relations, depth and direction that an intent expands by.
POLICIES = {
    "FACTUAL": (["REGULATES", "DEFINES", "REQUIRES", "REFERS_TO"], 2, "outgoing"),
    "VALIDITY": (["AMENDS", "REPLACES", "REPEALS"], 3, "both"),
    "HIERARCHY": (["GUIDES", "CONTAINS"], 3, "both"),
    "COMPARISON": (["AMENDS", "REPLACES"], 5, "both"),
    "DEFINITION": (["DEFINES"], 1, "outgoing"),
    "MULTI_HOP": (["ISSUED_BY", "CONTAINS", "GUIDES", "REFERS_TO", "AMENDS", "REPEALS", "REPLACES", "DEFINES", "REGULATES", "REQUIRES"], 3, "both"),
}
OVER_FETCH, PATHS, RRF = 4, 50, 60
DATED = ["Document", "Article", "Clause"]


@dataclass(frozen=True)
class Limits:
    candidates: int = 20
    final: int = 10
    entries: int = 3

    def __post_init__(self) -> None:
        if not 1 <= self.final <= self.candidates <= 200:
            raise ValueError("require 1 <= final <= candidates <= 200")


def filter_values(values: list[str]) -> list[str]:
    """Trimmed filter values; blank or repeated ones are an error."""
    out = [v.strip() for v in values]
    if not all(out) or len(set(out)) < len(out):
        raise ValueError("filter values must be non-blank and unique")
    return out


def in_scope() -> Column:
    """The identity filter: documents and kinds, an empty list meaning all; neither date nor status."""
    return ((F.size("document_ids") == 0) | F.array_contains("document_ids", F.col("document_id"))) & ((F.size("doc_types") == 0) | F.array_contains("doc_types", F.col("doc_type")))


def _status(column: str) -> Column:
    return (F.size("legal_statuses") == 0) | F.array_contains("legal_statuses", F.col(column))


def _valid(start: Column, end: Column) -> Column:
    return F.col("query_date").isNull() | (start.isNotNull() & (start <= F.col("query_date")) & (end.isNull() | (end > F.col("query_date"))))


def seed_filter() -> Column:
    """Seeds and expanded units: scope, the document's status, and validity with the document's dates where the unit has none."""
    return in_scope() & _status("document_status") & _valid(F.coalesce("effective_from", "document_from"), F.coalesce("effective_to", "document_to"))


def anchor_filter() -> Column:
    """Anchors under active filters: as for seeds, but by the unit's own dates alone."""
    return in_scope() & _status("document_status") & _valid(F.col("effective_from"), F.col("effective_to"))


def structural_filter() -> Column:
    """Structural lookup: the unit's own status and dates, and no scope."""
    return _status("legal_status") & _valid(F.col("effective_from"), F.col("effective_to"))


def channels_of(intent: Column, hierarchy_vectors: bool = False) -> Column:
    """The seed channels of an intent in order; hierarchy questions have no vector channel unless asked for."""
    words_first = intent.isin("DEFINITION", "VALIDITY", "HIERARCHY")
    both = F.when(words_first, F.array(F.lit("fulltext"), F.lit("vector"))).otherwise(F.array(F.lit("vector"), F.lit("fulltext")))
    return both if hierarchy_vectors else F.when(intent == "HIERARCHY", F.array(F.lit("fulltext"))).otherwise(both)


def seeds(requests: DataFrame, units: DataFrame, texts: DataFrame, vectors: DataFrame, limits: Limits) -> DataFrame:
    """``query_id, channel, id, score, rank`` of the routed channels.

    Each index gives four times the candidates before scope and dates are tested, so fewer than the candidates may be left.
    """
    routed = requests.withColumn("channels", channels_of(F.col("intent")))
    fetch = OVER_FETCH * limits.candidates
    asked = routed.where(F.array_contains("channels", "vector")).select("query_id", F.col("vector").alias("q")).where("q is not null")
    by_vector = fulltext.vector_candidates(vectors, asked, fetch, "label", own=True).select("query_id", F.lit("vector").alias("channel"), "id", "score")
    words = routed.where(F.array_contains("channels", "fulltext")).select("query_id", "text")
    by_words = fulltext.bm25(texts, words, fetch).select("query_id", F.lit("fulltext").alias("channel"), "id", F.round("score", 9).alias("score"))
    fetched = by_vector.unionByName(by_words).join(units, "id").join(requests, "query_id").where(seed_filter())
    return top_k(fetched.select("query_id", "channel", "id", "score"), limits.candidates, ["query_id", "channel"], [F.desc("score"), "id"])


def fused(ranked: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, sources, rank`` of ``ranked(query_id, channel, id, rank)``: reciprocal ranks added in the channels' order of name."""
    part = [F.coalesce(F.sum(F.when(F.col("channel") == c, 1.0 / (RRF + F.col("rank")))), F.lit(0.0)) for c in ("fulltext", "graph", "vector")]
    both = ranked.groupBy("query_id", "id").agg((part[0] + part[1] + part[2]).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))
    return top_k(both, k, ["query_id"], [F.desc("score"), "id"])


def anchors(requests: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, id, rank``: the anchors that are in scope, numbered as asked for, each once; dates and statuses don't count."""
    asked = requests.select("*", F.posexplode("anchors").alias("pos", "id"))
    found = asked.join(units, "id").where(in_scope()).groupBy("query_id", "id").agg((F.min("pos") + 1).alias("rank"))
    return found


def unavailable(requests: DataFrame, hydrated: DataFrame) -> DataFrame:
    """``query_id`` of requests with an anchor that is missing or out of scope."""
    return requests.select("query_id", F.explode("anchors").alias("id")).distinct().join(hydrated, ["query_id", "id"], "left_anti").select("query_id").distinct()


def decided_negative(requests: DataFrame, hydrated: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id`` of validity questions on a day that lies outside the closed interval of every anchor."""
    asked = hydrated.join(requests.where("intent = 'VALIDITY' and query_date is not null").select("query_id", "query_date"), "query_id").join(units.select("id", "effective_from", "effective_to", "document_from", "document_to"), "id")
    start, end = F.coalesce("effective_from", "document_from"), F.coalesce("effective_to", "document_to")
    outside = F.coalesce(start.isNotNull() & ((F.col("query_date") < start) | F.coalesce(F.col("query_date") >= end, F.lit(False))), F.lit(False))
    return asked.groupBy("query_id").agg(F.bool_and(outside).alias("_out")).where("_out").select("query_id")


def expansion(requests: DataFrame, entries: DataFrame, edges: DataFrame, units: DataFrame, paths: int = PATHS) -> tuple[DataFrame, DataFrame]:
    """The accepted paths ``query_id, nodes, edge_ids, types, heads, rank`` and how many the day ruled out, ``query_id, rejected``.

    Paths go from ``entries(query_id, id)`` along the intent's relations (the goal's alone, if there is one) and use no edge
    twice.  Those that end in scope are cut to the first ``paths`` by length and nodes before their dates are tested.  Length is the
    first key, so a question's expansion ends, exactly, with the level at which it has so many; each level is written once.
    """
    policy = requests.sparkSession.createDataFrame([(i, r, d, w) for i, (rs, d, w) in POLICIES.items() for r in rs], "intent string, type string, depth int, way string")
    rules = requests.join(F.broadcast(policy), "intent").where("goal is null or goal = type").select("query_id", "type", "depth", "way")
    out = edges.select(F.col("head_id").alias("a"), F.col("tail_id").alias("b"), "type", "relation_id", F.lit(True).alias("forward"), F.col("effective_from").alias("since"))
    back = out.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "type", "relation_id", F.lit(False).alias("forward"), "since")
    sides = out.unionByName(back)
    none = F.array().cast("array<string>")
    level = entries.select("query_id", F.col("id").alias("at"), F.array("id").alias("nodes"), none.alias("edge_ids"), none.alias("types"), F.array().cast(f"array<{entries.schema['id'].dataType.simpleString()}>").alias("heads"), F.lit(None).cast("date").alias("since"))
    scope = checkpointed(units.withColumnRenamed("id", "at"))
    kept = None
    for step in range(1, max(d for _, d, _ in POLICIES.values()) + 1):
        allowed = rules.where(F.col("depth") >= step)
        level = (
            level.withColumnRenamed("since", "last").join(sides, F.col("at") == F.col("a")).join(allowed, ["query_id", "type"]).where("way = 'both' or forward")
            .where(~F.array_contains("edge_ids", F.col("relation_id")))
            .select("query_id", F.col("b").alias("at"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("edge_ids", F.col("relation_id")).alias("edge_ids"), F.array_append("types", F.col("type")).alias("types"), F.array_append("heads", F.when(F.col("forward"), F.col("a")).otherwise(F.col("b"))).alias("heads"), F.greatest("last", "since").alias("since"))
        )
        level = checkpointed(level)
        ending = level.join(scope, "at").join(requests, "query_id").where(seed_filter()).select("query_id", "nodes", "edge_ids", "types", "heads", "since", "query_date")
        # all paths of a level are as long, so a level's first ones come behind all that were kept before
        best = top_k(ending, paths, ["query_id"], ["nodes", "edge_ids"]).drop("rank")
        kept = checkpointed(best if kept is None else top_k(kept.unionByName(best), paths, ["query_id"], [F.size("edge_ids"), "nodes", "edge_ids"]).drop("rank"))
        full = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= paths).select("query_id")
        level = level.join(full, "query_id", "left_anti")
        if not level.limit(1).count():
            break
    own = units.select("id", "label", "effective_from", "effective_to")
    start, end = F.col("effective_from"), F.col("effective_to")
    fine = ~F.col("label").isin(DATED) | _valid(start, end)
    nodes = kept.select("query_id", "query_date", "edge_ids", F.explode(F.array_distinct("nodes")).alias("id")).join(own, "id", "left")
    verdict = nodes.groupBy("query_id", "edge_ids", "query_date").agg(F.bool_and(F.coalesce(fine, F.col("query_date").isNull())).alias("_ok"))
    judged = kept.join(verdict.drop("query_date"), ["query_id", "edge_ids"]).withColumn("_ok", F.col("_ok") & (F.col("query_date").isNull() | F.col("since").isNull() | (F.col("since") <= F.col("query_date"))))
    judged = checkpointed(judged)
    order = [F.size("edge_ids"), F.get("nodes", F.lit(0)), F.element_at("nodes", -1), F.col("types"), F.col("nodes"), F.col("edge_ids")]
    same = judged.where("_ok").groupBy("query_id", "nodes", "types").agg(F.min(F.struct("edge_ids", "heads")).alias("e")).select("query_id", "nodes", "types", "e.*")
    accepted = same.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return accepted, judged.groupBy("query_id").agg(F.count_if(~F.col("_ok")).alias("rejected"))


def expanded_units(accepted: DataFrame) -> DataFrame:
    """``query_id, id, rank``: the ends of accepted paths by the first path that they occur in anywhere, then by id."""
    ends = accepted.select("query_id", F.element_at("nodes", -1).alias("id")).distinct()
    first = accepted.select("query_id", "rank", F.explode("nodes").alias("id")).groupBy("query_id", "id").agg(F.min("rank").alias("first"))
    return ends.join(first, ["query_id", "id"]).select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "id")).alias("rank"))


@dataclass
class Retrieved:
    """What a batch gave: the seed channels, the anchors, the accepted paths, the final units, and a row for each request."""

    seeds: DataFrame
    anchors: DataFrame
    paths: DataFrame
    units: DataFrame
    contexts: DataFrame


def retrieve(requests: DataFrame, units: DataFrame, texts: DataFrame, vectors: DataFrame, edges: DataFrame, limits: Limits | None = None) -> Retrieved:
    """Both fusions around one expansion.

    A request with an unavailable anchor gives no units.  Where every anchor already decides a validity question, nothing is expanded.
    Of the units of a family the latest stays, but for comparisons; anchors and what the goal's paths from them reach come first.
    """
    limits = limits or Limits()
    hydrated = checkpointed(anchors(requests, units))
    missing = unavailable(requests, hydrated)
    live = requests.join(missing, "query_id", "left_anti")
    found = checkpointed(seeds(live, units, texts, vectors, limits))
    ranked = fused(found, limits.candidates)
    decided = checkpointed(decided_negative(live, hydrated, units))
    here = hydrated.join(live.select("query_id"), "query_id", "left_semi")
    entries = here.select("query_id", "id").unionByName(ranked.where(F.col("rank") <= limits.entries).select("query_id", "id")).distinct().join(decided, "query_id", "left_anti")
    accepted, rejected = expansion(live, entries, edges, units)
    accepted = checkpointed(accepted)
    reached = expanded_units(accepted)
    order = Window.partitionBy("query_id").orderBy("_group", "rank")
    merged = here.withColumn("_group", F.lit(0)).unionByName(reached.join(here, ["query_id", "id"], "left_anti").withColumn("_group", F.lit(1)))
    graph = checkpointed(merged.select("query_id", F.lit("graph").alias("channel"), "id", F.row_number().over(order).alias("rank"), (F.col("_group") == 0).alias("anchor")))
    final = fused(found.select("query_id", "channel", "id", "rank").unionByName(graph.drop("anchor")), limits.candidates).withColumnRenamed("rank", "place")
    # the first channel by name that has a unit tells its dates: seeds and anchors the document's where it has none, and no family
    seen = final.join(units, "id").join(live.select("query_id", "intent", "query_date"), "query_id").join(graph.select("query_id", "id", "anchor"), ["query_id", "id"], "left")
    own = F.contains("sources", F.lit("graph")) & ~F.contains("sources", F.lit("fulltext")) & ~F.col("anchor")
    seen = seen.withColumns({"_from": F.when(own, F.col("effective_from")).otherwise(F.coalesce("effective_from", "document_from")), "_to": F.when(own, F.col("effective_to")).otherwise(F.coalesce("effective_to", "document_to")), "_family": F.when(own & (F.col("intent") != "COMPARISON"), F.col("family"))})
    valid = seen.where(_valid(F.col("_from"), F.col("_to")))
    latest = Window.partitionBy("query_id", F.coalesce(F.col("_family").cast("string"), F.concat(F.lit("u"), F.col("id").cast("string")))).orderBy(F.desc(F.coalesce("_from", F.lit("0001-01-01").cast("date"))), "place")
    current = valid.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("query_id", "id", "score", "sources")
    goal = live.where("goal is not null").select("query_id", "goal")
    steps = accepted.join(goal, "query_id").join(here.groupBy("query_id").agg(F.collect_set("id").alias("_anchors")), "query_id")
    hits = F.exists(F.arrays_zip("types", "heads"), lambda e: (e["types"] == F.col("goal")) & F.array_contains("_anchors", e["heads"]))
    wanted = steps.where(hits).select("query_id", "rank", F.posexplode("nodes").alias("_at", "id")).join(graph.select("query_id", "id"), ["query_id", "id"], "left_semi")
    pins = here.select("query_id", "id", F.lit(0).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c")).unionByName(wanted.select("query_id", "id", F.lit(1).alias("a"), F.col("rank").alias("b"), F.col("_at").alias("c")))
    pins = pins.groupBy("query_id", "id").agg(F.min(F.struct("a", "b", "c")).alias("pin"))
    best = Window.partitionBy("query_id").orderBy(F.col("pin").isNull(), "pin", F.desc("score"), "id")
    out = current.join(pins, ["query_id", "id"], "full_outer").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limits.final)
    chosen = checkpointed(out.select("query_id", "rank", "id", F.col("pin").isNotNull().alias("pinned"), "score", F.coalesce("sources", F.lit("graph")).alias("sources")))
    sources = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_units"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", ","))))), ",").alias("sources"))
    n_paths = accepted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_paths"))
    zero = F.lit(0).cast("long")
    each = requests.select("query_id").join(sources, "query_id", "left").join(n_paths, "query_id", "left").join(rejected, "query_id", "left").join(missing.withColumn("_m", F.lit(True)), "query_id", "left").join(decided.withColumn("_d", F.lit(True)), "query_id", "left")
    n_units, paths, src = F.coalesce("n_units", zero), F.coalesce("n_paths", zero), F.coalesce("sources", F.lit(""))
    mode = F.when(F.coalesce("_m", F.lit(False)), "unavailable").when((n_units == 0) & (paths == 0), "no_results").when((src == "vector") & (paths == 0), "vector_only").when((src == "fulltext") & (paths == 0), "fulltext_only").when((F.contains(src, F.lit("graph")) | (paths > 0)) & ~F.contains(src, F.lit("fulltext")), "vector_graph").otherwise("hybrid")
    contexts = each.select("query_id", n_units.alias("n_units"), paths.alias("n_paths"), F.coalesce("rejected", zero).alias("rejected"), F.coalesce("_d", F.lit(False)).alias("decided"), mode.alias("mode"), mode.isin("no_results", "vector_only", "fulltext_only").alias("penalty"))
    return Retrieved(found, hydrated, accepted, chosen, contexts)
