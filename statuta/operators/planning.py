"""Outcomes of planned path queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.operators.validity import valid_on
from statuta.runtime import checkpointed


def path_outcomes(anchors: DataFrame, paths: DataFrame, dated: DataFrame, day: date, budget: int) -> DataFrame:
    """``anchor, reason`` for each anchor: over budget, no path, none valid, several targets, or satisfied.

    ``paths`` has n0 (anchor), n1 (the dated unit) and n2 (target).
    """
    ok = dated.select(F.col("id").alias("n1"), valid_on(day).alias("_ok"))
    seen = paths.join(ok, "n1").groupBy("n0").agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("n_ok"), F.count_distinct(F.when(F.col("_ok"), F.col("n2"))).alias("n_targets"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n > budget, "PATH_BUDGET_EXCEEDED").when(n == 0, "NO_PATH").when(F.col("n_ok") == 0, "TEMPORAL_REJECTED").when(F.col("n_targets") > 1, "AMBIGUOUS_PATH").otherwise("SATISFIED")
    return anchors.select(F.col("id").alias("anchor")).join(seen.withColumnRenamed("n0", "anchor"), "anchor", "left").select("anchor", reason.alias("reason"))


# Kinds of target that must be lifted to a unit that can be cited, kinds with dates, and what comes of a plan.
LIFTED = ("LegalConcept", "LegalSubject", "LegalAction")
DATED = ("Document", "Article", "Clause")
REASONS = ("INVALID_PLAN", "PATH_BUDGET_EXCEEDED", "NO_PATH", "TEMPORAL_REJECTED", "AMBIGUOUS_PATH", "EVIDENCE_UNLIFTABLE", "SATISFIED")
MOST_STEPS = 3


def _walks(starts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``anchor, steps, target, nodes, types, since``: all paths of the steps from each of ``starts(anchor, steps)``, whatever their end."""
    labels = nodes.select(F.col("id").alias("b"), "label")
    # a walk's rows repeat their steps, so they take far more memory than the packed size tells by which Spark would broadcast them: they are always merged
    level = starts.select("anchor", "steps", F.col("anchor").alias("a"), F.array("anchor").alias("nodes"), F.array().cast("array<string>").alias("types"), F.lit(None).cast("date").alias("last"))
    for i in range(MOST_STEPS):
        step = F.get("steps", F.lit(i))
        key = {"type": step["relation"], "way": step["direction"], "label": step["label"]}
        # kinds of step are few: edges and nodes of other kinds leave before they are shuffled
        kinds = F.broadcast(starts.where(F.size("steps") > i).select(*[v.alias(k) for k, v in key.items()]).distinct())
        out = F.col("way") == "outgoing"
        used = edges.join(kinds, "type").select(F.when(out, F.col("head_id")).otherwise(F.col("tail_id")).alias("a"), "type", "way", "label", F.when(out, F.col("tail_id")).otherwise(F.col("head_id")).alias("b"), F.col("effective_from").alias("since"))
        used = used.join(labels.join(kinds, "label", "left_semi"), ["b", "label"], "left_semi")
        # a walk that has ended has no further kind, meets nothing and stays
        near = level.withColumns(key).hint("merge").join(used, ["a", *key], "left").where((F.size("steps") <= i) | ~F.array_contains("nodes", F.col("b")))
        more = F.col("b").isNotNull()
        level = near.select("anchor", "steps", F.coalesce("b", "a").alias("a"), F.when(more, F.array_append("nodes", F.col("b"))).otherwise(F.col("nodes")).alias("nodes"), F.when(more, F.array_append("types", F.col("type"))).otherwise(F.col("types")).alias("types"), F.greatest("last", "since").alias("last"))
    return level.select("anchor", "steps", F.col("a").alias("target"), "nodes", "types", F.col("last").alias("since"))


def executed(plans: DataFrame, edges: DataFrame, nodes: DataFrame, budget: int = 20) -> DataFrame:
    """``plan_id, reason, nodes, types, citable``: what came of each plan, and its one path where it was satisfied.

    A plan is ``plan_id, anchor, target, steps, query_date``, its steps two or three ``relation, direction, label``; a null target is any node of the last label.  All plans
    run together, step by step: a path follows the step's relation in its direction to a node of its label and meets no node twice.  Plans of one anchor and the same steps
    are walked once, and then meet the ends of the walk by their targets.  ``edges`` is ``head_id, type, tail_id, effective_from``, ``nodes`` is ``id, label, citable,
    effective_from, effective_to``.  More paths than the budget are an error of the plan before dates are looked at; paths that differ in parallel edges alone are one.
    """
    if not 1 <= budget <= 100:
        raise ValueError("the path budget must be between 1 and 100")
    shape = F.coalesce(F.size("steps"), F.lit(0)).between(2, MOST_STEPS) & F.forall("steps", lambda s: s["direction"].isin("outgoing", "incoming") & s["relation"].isNotNull() & s["label"].isNotNull()) & F.col("anchor").isNotNull()
    judged = plans.withColumn("_fine", F.coalesce(shape, F.lit(False)))
    asked = judged.where("_fine").select("plan_id", "anchor", "target", "steps", "query_date")
    ways = _walks(asked.select("anchor", "steps").distinct(), edges, nodes).hint("merge")
    aimed, free = ways.join(asked.where("target is not null"), ["anchor", "steps", "target"]), ways.drop("target").join(asked.where("target is null"), ["anchor", "steps"])
    done = aimed.select("plan_id", "query_date", "nodes", "types", "since").unionByName(free.select("plan_id", "query_date", "nodes", "types", "since"))
    done = checkpointed(done)
    counted = done.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    # the nodes of no more paths than the budget are looked at
    few = done.join(counted.where(F.col("n") <= budget), "plan_id", "left_semi")
    dates = nodes.withColumnRenamed("id", "_id").join(few.select(F.explode("nodes").alias("_id")).distinct(), "_id", "left_semi").groupBy("_id").agg(F.min("label").alias("label"), F.max("citable").alias("citable"), F.min("effective_from").alias("effective_from"), F.max("effective_to").alias("effective_to"))
    on = few.select("plan_id", "nodes", "types", "since", "query_date", F.posexplode("nodes").alias("_n", "_id")).join(dates, "_id", "left")
    valid = F.col("query_date").isNull() | ~F.coalesce(F.col("label").isin(*DATED), F.lit(False)) | valid_on(F.col("query_date"))
    paths = on.groupBy("plan_id", "nodes", "types", "since", "query_date").agg(F.bool_and(valid).alias("_ok"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("citable").isNotNull(), F.struct("_n", "citable")))), lambda x: x["citable"])).alias("citable"))
    holds = F.col("_ok") & (F.col("query_date").isNull() | F.col("since").isNull() | (F.col("since") <= F.col("query_date")))
    same = paths.where(holds).groupBy("plan_id", "nodes", "types").agg(F.first("citable").alias("citable"))
    best = same.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_valid"), F.min(F.struct("nodes", "types", "citable")).alias("path"))
    out = judged.join(counted, "plan_id", "left").join(best, "plan_id", "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("n_valid", F.lit(0))
    lifted = F.element_at("steps", -1)["label"].isin(*LIFTED)
    reason = F.when(~F.col("_fine"), "INVALID_PLAN").when(n > budget, "PATH_BUDGET_EXCEEDED").when(n == 0, "NO_PATH").when(ok == 0, "TEMPORAL_REJECTED").when(ok > 1, "AMBIGUOUS_PATH").when(lifted & (F.size("path.citable") == 0), "EVIDENCE_UNLIFTABLE").otherwise("SATISFIED")
    told = out.withColumn("reason", reason)
    return told.select("plan_id", "reason", *[F.when(F.col("reason") == "SATISFIED", F.col(f"path.{c}")).alias(c) for c in ("nodes", "types", "citable")])


def gold_verdicts(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``plan_id, reason, exact, passed`` of gold cases ``plan_id, expected_nodes, expected_types, expected_reason``: an exact path where one is expected, else the expected failure."""
    j = cases.join(outcomes, "plan_id", "left")
    exact = F.coalesce((F.col("reason") == "SATISFIED") & (F.col("nodes") == F.col("expected_nodes")) & (F.col("types") == F.col("expected_types")), F.lit(False))
    wrong = (F.col("reason") == "SATISFIED") & ~exact
    return j.select("plan_id", F.when(wrong, "WRONG_DENOTATION").otherwise(F.col("reason")).alias("reason"), exact.alias("exact"), F.when(F.col("expected_reason") == "SATISFIED", exact).otherwise(F.coalesce(F.col("reason") == F.col("expected_reason"), F.lit(False))).alias("passed"))
