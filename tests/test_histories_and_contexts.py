"""State machines as tables and as streams, provider links on odd inputs, and packing against plain versions."""

from __future__ import annotations

import itertools
import random
from datetime import date as day

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statuta.operators import context, joins, provider, reconciliation, resolution
from statuta.plans import history_queries
from statuta.streaming.folds import Machine, fold

R = random.Random(11)


def as_stream(spark, rows, tmp_path, build, parts: int, order: str):
    """The outputs of a streamed machine whose input comes in so many batches."""
    folder, name = str(tmp_path / "in"), f"out_{R.randrange(1 << 30)}"
    cuts = [r[0] for r in rows.select(F.ntile(parts).over(Window.orderBy(order)).alias("n"), order).groupBy("n").agg(F.max(order).alias("m")).orderBy("n").select("m").collect()]
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/*")
    low = None
    for i, high in enumerate(cuts):
        part = rows.where(F.col(order) <= high) if low is None else rows.where((F.col(order) > low) & (F.col(order) <= high))
        part.coalesce(1).write.parquet(f"{folder}/{i:03}")
        low = high
    running = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination(180)
    return spark.table(name)


def test_reconciliation_is_the_same_in_batches_and_as_a_stream(spark, small, tmp_path):
    log = history_queries.run_log(spark, small).cache()
    whole = sorted(map(tuple, reconciliation.reconciled(log).collect()), key=str)
    assert {r[3] for r in whole} >= set(reconciliation.STATES) and {r[2] for r in whole} == {True, False}
    streamed = as_stream(spark, log, tmp_path, reconciliation.reconciled_stream, 3, "seq")
    assert sorted(map(tuple, streamed.collect()), key=str) == whole


def test_written_targets_never_change_silently(spark):
    def rows(*events):
        return [{"bundle_id": "b", "seq": i, "run": e.pop("run", i + 1), **e} for i, e in enumerate(events)]

    resolve = lambda *t, **k: {"kind": "resolve", "resolution": "RESOLVED", "external": True, "targets": list(t)} | k
    attempt = lambda outcome, error=None, valid=True, **k: {"kind": "attempt", "outcome": outcome, "error": error, "valid": valid} | k

    def states(*events):
        state, out = None, []
        for row in rows(*events):
            state, [told] = reconciliation.step(state, row)
            out.append((told[1], told[2], told[3]))
        return out

    assert states(resolve("x"), attempt("COMMITTED"), resolve("y"))[-1] == (True, "BLOCKED", reconciliation.CHANGED)
    assert states(resolve("x", "y"), attempt("COMMITTED"), resolve("y", "x"))[-1] == (True, "WRITTEN", None)
    assert states(resolve("x"), attempt("UNKNOWN", "lost"), attempt("COMMITTED"))[1:] == [(True, "FAILED", "lost"), (True, "WRITTEN", None)]
    assert states(resolve("x"), attempt("COMMITTED", run=1)) == [(True, "PENDING", None), (False, "PENDING", None)]  # a run that comes again
    assert states(attempt("COMMITTED"), resolve("x")) == [(False, None, None), (True, "PENDING", None)]
    assert states(resolve("x"), attempt("COMMITTED", valid=False))[-1] == (True, "FAILED", "external_reference_validation_failed")
    assert states(resolve("x"), attempt("NOT_COMMITTED", "partial_materialized_bundle_in_graph"), attempt("COMMITTED"))[-1] == (True, "BLOCKED", "partial_materialized_bundle_in_graph")
    assert states(resolve("x", resolution="UNRESOLVED"), attempt("COMMITTED"))[-1] == (True, "NOT_APPLICABLE", None)
    assert states(resolve("x", external=False))[0][1:] == ("NOT_APPLICABLE", "local_reference_not_external")


def test_folds_hold_one_key_at_a_time(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"))
    total = Machine(lambda s, r: ({"t": (s or {"t": 0})["t"] + r["n"]}, [(r["n"], (s or {"t": 0})["t"] + r["n"])]), "n long, total long")
    got = fold(rows, total, "k", "n").groupBy("k").agg(F.max("total")).collect()
    assert {r[0]: r[1] for r in got} == {str(k): sum(range(k, 5000, 7)) for k in range(7)}
    assert fold(rows.limit(0), total, "k", "n").count() == 0


UNITS = [("1", "Luật 1/2020/QH14", "Document", "1/2020/QH14", None), ("2", "Luật 2/2020/QH14", "Document", "2/2020/QH14", None), ("1_art1", "Điều 1 Luật 1/2020/QH14", "Article", "1/2020/QH14", "1"), ("2_art1", "Điều 1 Luật 2/2020/QH14", "Article", "2/2020/QH14", "1"), ("2_art2", "Điều 2 Luật 2/2020/QH14", "Article", "2/2020/QH14", "2")]
TALK = [
    ("điều này là gì", "CLARIFY_RESTATE", "REFERENT_NOT_FOUND", None), ("Điều 1 nói gì", "CLARIFY_SELECT", "SEVERAL_CANDIDATES", None), ("hm", "CLARIFY_SELECT", "SELECT_INPUT_INVALID", None), ("3", "CLARIFY_SELECT", "SELECT_INPUT_INVALID", None),
    (" điều 1  LUẬT 2/2020/QH14. ", "RESOLVED", "PENDING_CLARIFICATION", "2_art1"), ("điều đó?", "RESOLVED", "HISTORY_FOCUS", "2_art1"), ("Điều 2 Luật 2/2020/qh14", "RESOLVED", "CURRENT_MESSAGE", "2_art2"), ("điều này", "CLARIFY_SELECT", "SEVERAL_FOCUSES", None), ("HỦY!", "CANCEL", None, None), ("thôi", "STANDALONE", None, None),
    ("Luật 7/2020/QH14", "CLARIFY_RESTATE", "REFERENT_NOT_FOUND", None), ("Luật 1/2020/QH14", "RESOLVED", "CURRENT_MESSAGE", "1"), ("a", "STANDALONE", None, None), ("b", "STANDALONE", None, None), ("quy định này", "RESOLVED", "HISTORY_FOCUS", "1"), ("c", "STANDALONE", None, None), ("", "STANDALONE", None, None), ("c", "STANDALONE", None, None), ("c", "STANDALONE", None, None), ("d", "STANDALONE", None, None), ("luật này", "CLARIFY_RESTATE", "REFERENT_NOT_FOUND", None),
]


def test_conversation_turn_by_turn(spark, tmp_path):
    units = spark.createDataFrame(UNITS, "id string, label string, type string, number string, article string")
    talk = spark.createDataFrame([(5, 2 * i, t[0], "x") for i, t in enumerate(TALK)] + [(6, 0, None, "x"), (6, 2, "Luật 1/2020/QH14 và Luật 2/2020/QH14, Luật 1/2020/QH14", "x")], "conv_id long, turn long, text string, found string")
    got = {(r.conv_id, r.turn): (r.outcome, r.reason, r.unit) for r in resolution.resolved(talk, units).collect()}
    assert [got["5", 2 * i] for i in range(len(TALK))] == [t[1:] for t in TALK]
    assert got["6", 0][0] == "STANDALONE" and got["6", 2][:2] == ("CLARIFY_SELECT", "SEVERAL_CANDIDATES")
    read = resolution.read_messages(talk, units).where("conv_id = 5").cache()
    streamed = {r.turn: (r.outcome, r.reason, r.unit) for r in as_stream(spark, read, tmp_path, resolution.resolved_stream, 4, "turn").collect()}
    assert [streamed[2 * i] for i in range(len(TALK))] == [t[1:] for t in TALK]


def test_smallest_holding_span(spark):
    spans = [(k, f"{k}{i}", a, a + R.randint(0, 9000)) for k in "ab" for i, a in enumerate(R.randrange(20_000) for _ in range(60))]
    inner = [(k, i, a, a + R.randint(0, 300)) for i, (k, a) in enumerate((R.choice("abc"), R.randrange(25_000)) for _ in range(300))]
    got = joins.smallest_holding(spark.createDataFrame(inner, "k string, i long, s long, e long"), spark.createDataFrame(spans, "k string, id string, a long, b long"), "k", "s", "e", "a", "b", "i", F.col("id"))
    want = {}
    for k, i, s, e in inner:
        fits = [(b - a, n) for key, n, a, b in spans if key == k and a <= s and e <= b and a < b]
        if fits:
            want[i] = min(fits)[1]
    assert {r.i: r.unit for r in got.collect()} == want


def test_provider_links_on_odd_inputs(spark):
    text = "Điều 1. A\n1. theo [Luật số 2/2020/QH14] “x” và “y\n[Điều 1 Luật số 2/2020/QH14]”"
    place = lambda c: (text.index(f"[{c}]"), text.index(f"[{c}]") + len(c) + 2)
    one, two = "Luật số 2/2020/QH14", "Điều 1 Luật số 2/2020/QH14"
    links = spark.createDataFrame([("l1", 1, *place(one), one, "REFERENCE", "2", []), ("l2", 1, *place(two), two, "REFERENCE", "2", ["art1"]), ("l3", 1, 0, 5, one, "REFERENCE", "2", []), ("l4", 9, 0, 5, one, "REFERENCE", None, [])], "link_id string, doc_id long, start long, end long, citation string, link_type string, target_document string, items array<string>")
    registry = spark.createDataFrame([("1_art1", "Article", "1", "1_art1", "1", 0, len(text)), ("1", "Document", "1", None, "1/2020/QH14", None, None), ("2", "Document", "2", None, "2/2020/QH14", None, None), ("2_art1", "Article", "2", "2_art1", "1", 0, 9)], "id string, type string, document_id string, article_id string, number string, start long, end long")
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = provider.candidates(links, texts, registry).cache()
    got = {r.link_id: (r.ownership, r.source and r.source.id, r.status, r.reason) for r in found.collect()}
    assert got["l1"] == ("HOST", "1_art1", "RESOLVED", "provider_endpoints_resolved")
    assert got["l2"] == ("PROJECTED", None, "UNRESOLVED", "projected_source_owner_not_resolved")  # quoted, and nothing governs it
    assert got["l3"][2:] == got["l4"][2:] == ("UNRESOLVED", "provider_source_span_drift")
    b = {r.bundle_id: r for r in provider.bundles(found, registry).collect()}
    assert set(b) == {"l1"} and b["l1"].target_ids == ["2"] and b["l1"].scope == "EXTERNAL" and b["l1"].fault is None
    for broken, fault in ((registry.where("id <> '2'"), "target_not_once"), (registry.where("id <> '1_art1'"), "source_not_once"), (registry.withColumn("number", F.lit("3/2020/QH14")), "provider_text_target_conflict"), (registry.withColumn("article_id", F.lit(None).cast("string")), "source_without_article"), (registry.withColumn("type", F.when(F.col("id") == "1_art1", "Clause").otherwise(F.col("type"))), "source_type_drift")):
        r = provider.bundles(found, broken).first()
        assert (r.fault, r.target_ids, r.scope, r.is_self) == (fault, None, None, False)
    assert provider.candidates(links.limit(0), texts, registry).count() == 0


def plain_pack(budget, sets, units, paths):
    cost = dict((u[0], u[2]) for u in units)
    priced = sorted((rank, sum(cost[u] for u in set(ids)) + (paths[p] if p is not None else 0), name, ids, p) for name, rank, ids, p in sets)
    if not priced:
        return context.NO_BUNDLE, None, [], 0, []
    fit = [x for x in priced if x[1] <= budget]
    if not fit:
        return context.TOO_LARGE, None, [], 0, []
    _, used, name, ids, _ = fit[0]
    taken, left = list(dict.fromkeys(ids)), []
    for u, _, c in sorted(units, key=lambda x: (x[1], x[0])):
        if u not in taken:
            if used + c <= budget:
                taken, used = [*taken, u], used + c
            else:
                left.append(u)
    return None, name, taken, used, left


def test_packing_matches_plain_version(spark):
    requests, sets, units, paths, want = [], [], [], [], {}
    for q in range(150):
        mine = [(i, R.randint(1, 4), R.randint(1, 60)) for i in range(R.randint(0, 6))]
        roads = {p: R.randint(1, 30) for p in range(R.randint(0, 3))}
        own = []
        for n in range(R.randint(0, 4) if mine else 0):
            ids = [R.choice(mine)[0] for _ in range(R.randint(1, 3))]
            own.append((f"s{n}", min(m[1] for m in mine if m[0] in ids), ids, R.choice([None, *roads])))
        requests.append((q, 120))
        units += [(q, *u) for u in mine]
        paths += [(q, p, c) for p, c in roads.items()]
        sets += [(q, *s) for s in own]
        want[q] = plain_pack(200 - 10 - 120, own, mine, roads)
    frame = spark.createDataFrame
    got = context.packed(frame(requests, "query_id long, overhead long"), frame(sets, "query_id long, alternative string, source_rank long, units array<long>, path long"), frame(units, "query_id long, id long, rank long, cost long"), frame(paths, "query_id long, rank long, cost long"), 200, 10).collect()
    assert {r.query_id: (r.reason, r.alternative, list(r.selected), r.used, list(r.omitted)) for r in got} == want
    assert {w[0] for w in want.values()} == {None, context.NO_BUNDLE, context.TOO_LARGE}
    with pytest.raises(Exception, match="fixed parts"):
        context.packed(frame([(1, 500)], "query_id long, overhead long"), frame(sets, "query_id long, alternative string, source_rank long, units array<long>, path long"), frame(units, "query_id long, id long, rank long, cost long"), frame(paths, "query_id long, rank long, cost long"), 200, 10).collect()


def test_sufficiency_and_checks_by_intent(spark):
    frame = spark.createDataFrame
    intents = ["FACTUAL", "HIERARCHY", "MULTI_HOP", "VALIDITY", "COMPARISON", "DEFINITION", "GUESS"]
    requests = frame([(i, x, None if n else day(2020, 1, 1), None, []) for i, (x, n) in enumerate(itertools.product(intents, (False, True)))] + [(90, "FACTUAL", None, "REFERS_TO", [1]), (91, "FACTUAL", None, "REFERS_TO", [7]), (92, "VALIDITY", day(2020, 1, 1), None, [5]), (93, "FACTUAL", None, None, [])], "query_id long, intent string, query_date date, goal string, anchors array<long>")
    queries = [r.query_id for r in requests.collect() if r.query_id != 93]
    units = frame([(q, i, i, 10, 100 + i, 7, day(2019, 1, 1), None) for q in queries for i in (1, 2)], "query_id long, id long, rank long, cost long, document_id long, family long, effective_from date, effective_to date")
    paths = frame([(q, 1, [1, 2], ["REFERS_TO"], [1], 5) for q in queries] + [(q, 2, [1, 2, 1], ["CONTAINS", "AMENDS"], [1, 2], 5) for q in queries], "query_id long, rank long, nodes array<long>, types array<string>, heads array<long>, cost long")
    got = {r.query_id: r.reason for r in context.sufficiency(requests, units, paths).collect()}
    assert [got[i] for i in range(14)] == [None] * 7 + ["MISSING_TEMPORAL_POINT", None, None, None, None, "UNSUPPORTED_INTENT", "UNSUPPORTED_INTENT"]
    assert [got[i] for i in (90, 91, 92, 93)] == [None, "NO_REFERENCE_EDGE", "MISSING_TEMPORAL_EVIDENCE", "NO_RESULTS"]
    bare = {r.query_id: r.reason for r in context.sufficiency(requests, units.withColumn("family", F.lit(None).cast("long")), paths.limit(0)).collect()}
    assert [bare[i] for i in (0, 2, 4, 8)] == [None, "MISSING_HIERARCHY_PATH", "MISSING_MULTI_HOP_PATH", "COMPARISON_RELATION_UNVERIFIED"]
    sets = context.alternatives(requests, units, paths)
    names = {}
    for r in sets.collect():
        names.setdefault(r.query_id, set()).add(r.alternative)
    assert names[0] == {"u1", "u2"} and names[2] == {"p000002"} and names[4] == {"p000001", "p000002"} and names[6] == {"u1", "u2"} and 7 not in names and names[8] == {"f7", "p000002"} and names[90] == {"p000001"} and 92 not in names
    asked = requests.withColumn("overhead", F.lit(0))
    packs = context.packed(asked, sets, units, paths)
    assert {r.fault for r in context.checked(asked, packs, sets, units, paths).collect()} == {None}
    torn = {r.query_id: r.fault for r in context.checked(asked, packs.withColumn("selected", F.expr("slice(selected, 2, 9)")), sets, units, paths).collect()}
    assert set(torn.values()) == {"lost_required_evidence"}
    undated = {r.query_id: r.fault for r in context.checked(asked, packs, sets, units.withColumns({"effective_from": F.lit(None).cast("date"), "document_id": F.lit(1).cast("long")}), paths.withColumn("types", F.array(F.lit("GUIDES")))).collect()}
    assert undated[6] == "temporal_evidence" and undated[2] == "hierarchy_path" and undated[8] == "comparison_versions" and undated[0] is None


def test_expansion_ends_with_the_level_that_fills_it(spark):
    """A hub of many edges: the shortest paths fill the cut, and what lies behind the hub is never reached."""
    from statuta.operators import retrieval

    n = 20_000
    units = spark.range(3 * n).select("id", F.lit("Article").alias("label"), F.lit(0).alias("document_id"), F.lit("Law").alias("doc_type"), F.lit("EFFECTIVE").alias("document_status"), *[F.lit(None).cast("date").alias(c) for c in ("document_from", "document_to", "effective_from", "effective_to")])
    requests = spark.createDataFrame([(1, "HIERARCHY", None, [], [], [], None), (2, "HIERARCHY", None, [], [], [], None)], "query_id long, intent string, query_date date, document_ids array<long>, doc_types array<string>, legal_statuses array<string>, goal string")
    hub = spark.range(1, n).select(F.lit(0).cast("long").alias("head_id"), F.lit("CONTAINS").alias("type"), F.col("id").alias("tail_id"))
    behind = spark.range(1, n).select(F.col("id").alias("head_id"), F.lit("CONTAINS").alias("type"), (F.col("id") + n).alias("tail_id"))
    chain = spark.createDataFrame([(2 * n + i, "CONTAINS", 2 * n + i + 1) for i in range(5)], "head_id long, type string, tail_id long")
    edges = hub.unionByName(behind).unionByName(chain).withColumns({"relation_id": F.concat_ws(">", F.col("head_id").cast("string"), F.col("tail_id").cast("string")), "effective_from": F.lit(None).cast("date")})
    entries = spark.createDataFrame([(1, 0), (2, 2 * n)], "query_id long, id long")
    accepted, rejected = retrieval.expansion(requests, entries, edges, units)
    got = {}
    for r in accepted.collect():
        got.setdefault(r.query_id, []).append((r.rank, list(r.nodes)))
    assert [p for _, p in sorted(got[1])] == [[0, i] for i in range(1, 51)]
    assert [p for _, p in sorted(got[2])] == [[2 * n, 2 * n + 1], [2 * n, 2 * n + 1, 2 * n + 2], [2 * n, 2 * n + 1, 2 * n + 2, 2 * n + 3]]
    assert {r.rejected for r in rejected.collect()} == {0}
