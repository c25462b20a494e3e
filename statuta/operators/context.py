"""What an answer may be given from: whether a retrieval suffices, the evidence that an intent requires, its packing under a budget, and a check of the pack.

Requests are ``query_id, intent, query_date, goal, anchors, overhead``; units ``query_id, id, rank, cost, document_id, family, effective_from, effective_to``; paths
``query_id, rank, nodes, types, heads, cost``.  A question has few units and paths (the limits of a retrieval), so its lists are folded in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators import rules

# Characters of a context, those kept free, relations that compare versions, and reasons.
MOST_CHARS, RESERVE = 24_000, 256
COMPARING = ("AMENDS", "REPLACES")
NO_BUNDLE, TOO_LARGE, LOST = "PROJECTED_EVIDENCE_INSUFFICIENT", "REQUIRED_EVIDENCE_EXCEEDS_CONTEXT_BUDGET", "PROJECTED_EVIDENCE_INSUFFICIENT"


def _valid(start: Column, end: Column) -> Column:
    return F.coalesce((start <= F.col("query_date")) & (end.isNull() | (end > F.col("query_date"))), F.lit(False))


def _with_nodes(paths: DataFrame, units: DataFrame) -> DataFrame:
    """``paths`` with ``citable``, their nodes each once, and ``n_here``, how many of them are among the question's units."""
    p = paths.withColumn("citable", F.array_distinct("nodes"))
    here = units.groupBy("query_id").agg(F.collect_set("id").alias("_ids"))
    return p.join(here, "query_id", "left").withColumn("n_here", F.size(F.array_intersect("citable", F.coalesce("_ids", F.array().cast(paths.schema["nodes"].dataType))))).drop("_ids")


def goal_edge(goal: Column, anchors: Column) -> Column:
    """Whether a path has an edge of the goal that leaves an anchor."""
    return F.exists(F.arrays_zip("types", "heads"), lambda e: (e["types"] == goal) & F.array_contains(anchors, e["heads"]))


def sufficiency(requests: DataFrame, units: DataFrame, paths: DataFrame) -> DataFrame:
    """``query_id, reason``: null for a retrieval that its intent can be answered from, else the first thing that is missing."""
    asked = requests.select("query_id", "intent", "query_date", "goal", "anchors")
    u = units.join(asked, "query_id")
    dated = F.array_contains("anchors", F.col("id")) & F.col("effective_from").isNotNull()
    documents = units.where("family is not null").groupBy("query_id", "family").agg(F.count_distinct("document_id").alias("_d")).groupBy("query_id").agg(F.max("_d").alias("versions"))
    by_unit = u.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(dated).alias("n_dated"), F.bool_or(_valid(F.col("effective_from"), F.col("effective_to"))).alias("holds"))
    p = _with_nodes(paths, units).join(asked, "query_id")
    by_path = p.groupBy("query_id").agg(
        F.bool_or(goal_edge(F.col("goal"), F.col("anchors"))).alias("to_goal"), F.bool_or(F.array_contains("types", "CONTAINS")).alias("contains"),
        F.bool_or((F.size("types") >= 2) & (F.col("n_here") == F.size("citable"))).alias("hops"), F.bool_or(F.arrays_overlap("types", F.array(*map(F.lit, COMPARING)))).alias("compares"),
    )
    j = asked.join(by_unit, "query_id", "left").join(by_path, "query_id", "left").join(documents, "query_id", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    intent, given = F.col("intent"), F.size(F.array_distinct("anchors"))
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "NO_RESULTS").when(F.col("goal").isNotNull() & no(F.col("to_goal")), "NO_REFERENCE_EDGE")
        .when((intent == "HIERARCHY") & no(F.col("contains")), "MISSING_HIERARCHY_PATH").when((intent == "MULTI_HOP") & no(F.col("hops")), "MISSING_MULTI_HOP_PATH")
        .when((intent == "VALIDITY") & F.col("query_date").isNull(), "MISSING_TEMPORAL_POINT").when((intent == "VALIDITY") & F.when(given > 0, F.col("n_dated") < given).otherwise(no(F.col("holds"))), "MISSING_TEMPORAL_EVIDENCE")
        .when((intent == "COMPARISON") & (F.coalesce("versions", F.lit(0)) < 2) & no(F.col("compares")), "COMPARISON_RELATION_UNVERIFIED")
        .when(~intent.isin("FACTUAL", "DEFINITION", "HIERARCHY", "MULTI_HOP", "VALIDITY", "COMPARISON"), "UNSUPPORTED_INTENT")
    )
    return j.select("query_id", reason.alias("reason"))


def alternatives(requests: DataFrame, units: DataFrame, paths: DataFrame) -> DataFrame:
    """``query_id, alternative, source_rank, units, path``: the sets of evidence of which one is required.

    A goal asks for one of its paths; facts and definitions for one unit; hierarchy and several hops for a path whose nodes are all there; validity for
    a unit with dates that hold (an anchor, if there are any); comparison for the best units of all documents of a family, or a path of changes.
    """
    asked = requests.select("query_id", "intent", "query_date", "goal", "anchors")
    u, p = units.join(asked, "query_id"), _with_nodes(paths, units).join(asked, "query_id").withColumnRenamed("rank", "path")
    ids = units.schema["id"].dataType.simpleString()
    none, no_path = F.array().cast(f"array<{ids}>"), F.lit(None).cast("long")
    free = F.col("goal").isNull()
    single = u.where(free & (F.col("intent").isin("FACTUAL", "DEFINITION") | ((F.col("intent") == "VALIDITY") & F.col("query_date").isNotNull() & _valid(F.col("effective_from"), F.col("effective_to")) & ((F.size("anchors") == 0) | F.array_contains("anchors", F.col("id"))))))
    of_units = single.select("query_id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("alternative"), F.col("rank").cast("long").alias("source_rank"), F.array("id").alias("units"), no_path.alias("path"))
    whole, many = F.col("n_here") == F.size("citable"), F.size("citable") >= 2
    fits = F.when(~free, goal_edge(F.col("goal"), F.col("anchors")) & whole & many).when(F.col("intent") == "HIERARCHY", F.array_contains("types", "CONTAINS") & whole & many).when(F.col("intent") == "MULTI_HOP", whole & many)
    fits = fits.when(F.col("intent") == "COMPARISON", F.arrays_overlap("types", F.array(*map(F.lit, COMPARING))) & (F.col("n_here") >= 2)).otherwise(False)
    taken = p.where(fits).select("query_id", "path", F.posexplode("citable").alias("_n", "id")).join(units.select("query_id", "id", "rank"), ["query_id", "id"])
    of_paths = taken.groupBy("query_id", "path").agg(F.min("rank").cast("long").alias("source_rank"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("units"))
    of_paths = of_paths.select("query_id", F.concat(F.lit("p"), F.lpad(F.col("path").cast("string"), 6, "0")).alias("alternative"), "source_rank", "units", F.col("path").cast("long").alias("path"))
    best = Window.partitionBy("query_id", "family", "document_id").orderBy("rank", "id")
    versions = u.where(free & (F.col("intent") == "COMPARISON") & F.col("family").isNotNull()).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    of_families = versions.groupBy("query_id", "family").agg(F.min("rank").cast("long").alias("source_rank"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("units")).where(F.size("units") >= 2)
    of_families = of_families.select("query_id", F.concat(F.lit("f"), F.col("family").cast("string")).alias("alternative"), "source_rank", F.coalesce("units", none).alias("units"), no_path.alias("path"))
    return of_units.unionByName(of_paths).unionByName(of_families)


def packed(requests: DataFrame, sets: DataFrame, units: DataFrame, paths: DataFrame, most: int = MOST_CHARS, reserve: int = RESERVE) -> DataFrame:
    """``query_id, reason, alternative, path, selected, used, omitted``: one required set whole, then further units in rank order, skipping those that no longer fit.

    Of the sets that fit the best ranked one is taken, then the cheapest, then the first by name.  The budget is ``most`` less ``reserve`` and the request's ``overhead``;
    an overhead that leaves nothing is an error.
    """
    budget = requests.select("query_id", (F.lit(most - reserve) - F.col("overhead")).cast("long").alias("_budget"))
    budget = budget.withColumn("_budget", F.when(F.col("_budget") > 0, F.col("_budget")).otherwise(F.raise_error(F.lit("the budget cannot hold the fixed parts of the prompt")).cast("long")))
    costs = units.select("query_id", "id", F.col("cost").cast("long").alias("_cost"))
    one = sets.select("query_id", "alternative", F.explode(F.array_distinct("units")).alias("id")).join(costs, ["query_id", "id"]).groupBy("query_id", "alternative").agg(F.sum("_cost").alias("_units"))
    road = paths.select("query_id", F.col("rank").cast("long").alias("path"), F.col("cost").cast("long").alias("_path"))
    priced = sets.join(one, ["query_id", "alternative"]).join(road, ["query_id", "path"], "left").join(budget, "query_id").withColumn("_set", F.col("_units") + F.coalesce("_path", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("source_rank", "_set", "alternative")
    chosen = priced.where("_set <= _budget").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "alternative", "path", "units", "_set")
    offered = sets.select("query_id").distinct().withColumn("_any", F.lit(True))
    listed = units.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("r"), F.col("id").alias("u"), F.col("cost").cast("long").alias("c")))).alias("_all"))
    j = budget.join(offered, "query_id", "left").join(chosen, "query_id", "left").join(listed, "query_id", "left")
    ids = units.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<{ids}>")
    start = F.struct(F.col("_set").alias("used"), F.array_distinct("units").alias("taken"), none.alias("left"))
    rest = F.filter("_all", lambda x: ~F.array_contains("units", x["u"]))
    fold = F.aggregate(rest, start, lambda s, x: F.when(s["used"] + x["c"] <= F.col("_budget"), F.struct((s["used"] + x["c"]).alias("used"), F.array_append(s["taken"], x["u"]).alias("taken"), s["left"].alias("left"))).otherwise(F.struct(s["used"].alias("used"), s["taken"].alias("taken"), F.array_append(s["left"], x["u"]).alias("left"))))
    reason = F.when(F.col("_any").isNull(), NO_BUNDLE).when(F.col("units").isNull(), TOO_LARGE)
    done = j.withColumns({"reason": reason, "_f": F.when(F.col("units").isNotNull(), fold)})
    return done.select("query_id", "reason", "alternative", "path", F.coalesce("_f.taken", none).alias("selected"), F.coalesce("_f.used", F.lit(0)).alias("used"), F.coalesce("_f.left", none).alias("omitted"))


def checked(requests: DataFrame, packs: DataFrame, sets: DataFrame, units: DataFrame, paths: DataFrame) -> DataFrame:
    """``query_id, fault`` of each pack: null if it still holds its required set and what its intent needs."""
    asked = requests.select("query_id", "intent", "query_date")
    want = sets.select("query_id", "alternative", F.col("units").alias("_need"), F.col("path").alias("_road"))
    p = packs.where("reason is null").join(asked, "query_id").join(want, ["query_id", "alternative"], "left")
    road = paths.select("query_id", F.col("rank").cast("long").alias("path"), "types")
    p = p.join(road, ["query_id", "path"], "left")
    held = p.select("query_id", F.explode("selected").alias("id")).join(units, ["query_id", "id"])
    needed = p.select("query_id", F.explode("_need").alias("id")).join(units, ["query_id", "id"])
    have = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    dates = needed.groupBy("query_id").agg(F.bool_and(F.col("effective_from").isNotNull()).alias("_dated"), F.count_distinct(F.struct("family", "document_id")).alias("_versions"))
    j = p.join(have, "query_id", "left").join(dates, "query_id", "left")
    lost = F.col("_need").isNull() | (F.size(F.array_except("_need", "selected")) > 0) | ~F.col("path").eqNullSafe(F.col("_road")) | (F.col("path").isNotNull() & F.col("types").isNull())
    types = F.coalesce("types", F.array().cast("array<string>"))
    fault = rules.projected_context(F.col("intent"), lost, F.coalesce("_n", F.lit(0)), types, F.when(F.col("_road").isNotNull(), 1).otherwise(0), F.col("query_date").isNotNull() & F.coalesce("_dated", F.lit(False)), F.coalesce("_versions", F.lit(0)))
    return j.select("query_id", fault.alias("fault"))


def hard_failures(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """``case_id, outcome, failures`` of evaluated answers.

    ``cases`` is ``case_id, groups`` (arrays of units of which an answer must cite one each), ``expects_dates, expects_gap`` (the capability that must be reported missing, or null); ``answers`` is
    ``case_id, cannot_answer, cited, dated, reported_gap``.  A capability that was reported counts first, then a refusal, then every group that isn't cited and missing dates.
    """
    j = cases.join(answers, "case_id", "left")
    gap, wanted = F.col("reported_gap"), F.col("expects_gap")
    cited = F.coalesce("cited", F.array().cast(cases.schema["groups"].dataType.elementType))
    missing = F.filter(F.transform("groups", lambda g, i: F.when(~F.arrays_overlap(cited, g), F.concat(F.lit("MISSING_CITATION_GROUP_"), (i + 1).cast("string")))), lambda x: x.isNotNull())
    dates = F.when(F.col("expects_dates") & ~F.coalesce("dated", F.lit(False)), F.array(F.lit("MISSING_TEMPORAL_DECISION"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    failures = (
        F.when(gap.isNotNull(), F.when(gap.eqNullSafe(wanted), none).otherwise(F.array(F.lit("UNEXPECTED_CAPABILITY_ERROR")))).when(wanted.isNotNull(), F.array(F.lit("EXPECTED_CAPABILITY_ERROR_NOT_RAISED")))
        .when(F.coalesce("cannot_answer", F.lit(True)), F.array(F.lit("UNEXPECTED_CANNOT_ANSWER"))).otherwise(F.concat(missing, dates))
    )
    outcome = F.when(gap.isNotNull(), "unsupported_capability").when(wanted.isNotNull(), "retrieval_supported").when(F.coalesce("cannot_answer", F.lit(True)), "cannot_answer").otherwise("answered")
    return j.select("case_id", outcome.alias("outcome"), failures.alias("failures"))


def gates(measured: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """``gate, value, passed`` of one row of figures: each against its bound, ``>=``, ``<=`` or ``==``, and ``all`` last; a figure that is missing doesn't pass."""
    tests = {">=": lambda c, b: c >= b, "<=": lambda c, b: c <= b, "==": lambda c, b: c == b}
    rows = [F.struct(F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"), F.coalesce(tests[how](F.col(name), F.lit(bound)), F.lit(False)).alias("passed")) for name, (how, bound) in bounds.items()]
    each = measured.select(F.array(*rows).alias("r"))
    whole = F.struct(F.lit("all").alias("gate"), F.lit(None).cast("double").alias("value"), F.forall("r", lambda x: x["passed"]).alias("passed"))
    return each.select(F.explode(F.concat("r", F.array(whole))).alias("g")).select("g.*")
