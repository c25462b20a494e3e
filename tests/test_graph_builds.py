"""Plans, payloads and grouped nDCG against plain versions on random graphs."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from statuta.operators import payload, planning, ranking

R = random.Random(21)


def plain_plan(anchor, target, steps, day, edges, nodes, budget):
    if not (steps and 2 <= len(steps) <= 3) or anchor is None:
        return "INVALID_PLAN", None
    level = [((anchor,), (), None)]
    for kind, way, label in steps:
        further = []
        for path, types, since in level:
            for head, t, tail, s in edges:
                a, b = (head, tail) if way == "outgoing" else (tail, head)
                if t == kind and a == path[-1] and b not in path and nodes[b][0] == label:
                    further.append(((*path, b), (*types, t), max(filter(None, (since, s)), default=None)))
        level = further
    found = [x for x in level if target is None or x[0][-1] == target]
    if len(found) > budget:
        return "PATH_BUDGET_EXCEEDED", None
    if not found:
        return "NO_PATH", None

    def valid(n):
        label, _, start, end = nodes[n]
        return label not in planning.DATED or (start is not None and start <= day and (end is None or end > day))

    ok = sorted({(p, t) for p, t, s in found if day is None or ((s is None or s <= day) and all(map(valid, p)))})
    if not ok:
        return "TEMPORAL_REJECTED", None
    if len(ok) > 1:
        return "AMBIGUOUS_PATH", None
    citable = list(dict.fromkeys(nodes[n][1] for n in ok[0][0] if nodes[n][1]))
    if steps[-1][2] in planning.LIFTED and not citable:
        return "EVIDENCE_UNLIFTABLE", None
    return "SATISFIED", (list(ok[0][0]), list(ok[0][1]), citable)


def test_plans_match_plain_search(spark):
    labels = ["Document", "Article", "Clause", "LegalConcept"]
    day = lambda: R.choice([None, date(2020, R.randint(1, 12), 1)])
    nodes = {f"n{i}": (R.choice(labels), R.choice([None, f"c{i}"]), day(), R.choice([None, None, date(2021, 1, 1), date(2020, 6, 1)])) for i in range(30)}
    edges = [(f"n{R.randrange(30)}", R.choice("AB"), f"n{R.randrange(30)}", day()) for _ in range(220)]
    edges += edges[:10]  # parallel edges
    plans = []
    for i in range(300):
        steps = [(R.choice("AB"), R.choice(["outgoing", "incoming"]), R.choice(labels)) for _ in range(R.choice([1, 2, 2, 2, 3, 3, 4]))]
        plans.append((i, R.choice([None, *nodes, *nodes, *nodes]) if i % 20 == 0 else f"n{R.randrange(30)}", R.choice([None, f"n{R.randrange(30)}"]), steps, R.choice([None, date(2020, 5, 15), date(2020, 12, 15)])))
    plans += [(900, "n1", None, None, None), (901, "n1", None, [("A", "sideways", "Article"), ("A", "outgoing", "Article")], None)]
    frame = spark.createDataFrame
    got = planning.executed(frame(plans, "plan_id long, anchor string, target string, steps array<struct<relation:string,direction:string,label:string>>, query_date date"), frame(edges, "head_id string, type string, tail_id string, effective_from date"), frame([(k, *v) for k, v in nodes.items()], "id string, label string, citable string, effective_from date, effective_to date"), budget=2).collect()
    want = {p[0]: plain_plan(p[1], p[2], p[3], p[4], edges, nodes, 2) for p in plans[:-1]} | {901: ("INVALID_PLAN", None)}
    assert {r.plan_id: (r.reason, (r.nodes, r.types, r.citable) if r.reason == "SATISFIED" else None) for r in got} == want
    assert {w[0] for w in want.values()} >= {"INVALID_PLAN", "PATH_BUDGET_EXCEEDED", "NO_PATH", "TEMPORAL_REJECTED", "AMBIGUOUS_PATH", "SATISFIED"}
    with pytest.raises(ValueError, match="budget"):
        planning.executed(frame(plans, "plan_id long, anchor string, target string, steps array<struct<relation:string,direction:string,label:string>>, query_date date"), None, None, budget=0)


def test_unliftable_evidence_and_gold_verdicts(spark):
    frame = spark.createDataFrame
    nodes = frame([("a", "Subject", None), ("b", "Issuer", None), ("c", "LegalConcept", None)], "id string, label string, citable string").withColumns({c: F.lit(None).cast("date") for c in ("effective_from", "effective_to")})
    edges = frame([("a", "X", "b"), ("b", "Y", "c")], "head_id string, type string, tail_id string").withColumn("effective_from", F.lit(None).cast("date"))
    plan = frame([(1, "a", "c", [("X", "outgoing", "Issuer"), ("Y", "outgoing", "LegalConcept")])], "plan_id long, anchor string, target string, steps array<struct<relation:string,direction:string,label:string>>").withColumn("query_date", F.lit(None).cast("date"))
    assert planning.executed(plan, edges, nodes).first().reason == "EVIDENCE_UNLIFTABLE"
    done = planning.executed(plan, edges, nodes.withColumn("citable", F.when(F.col("id") == "b", "b1")))
    assert done.first().citable == ["b1"]
    cases = frame([(1, ["a", "b", "c"], ["X", "Y"], "SATISFIED"), (2, ["a"], [], "NO_PATH")], "plan_id long, expected_nodes array<string>, expected_types array<string>, expected_reason string")
    got = {r.plan_id: (r.reason, r.exact, r.passed) for r in planning.gold_verdicts(cases, done).collect()}
    assert got == {1: ("SATISFIED", True, True), 2: (None, False, False)}
    wrong = planning.gold_verdicts(cases.withColumn("expected_nodes", F.array(F.lit("z"))), done).where("plan_id = 1").first()
    assert (wrong.reason, wrong.exact, wrong.passed) == ("WRONG_DENOTATION", False, False)


def test_merged_nodes_match_plain_merge(spark):
    rows = [(f"n{R.randrange(25)}", R.choice(["A", "A", "A", "B"]), R.randrange(3), {k: R.choice("xyz") for k in R.sample("abc", R.randint(0, 3))}) for _ in range(150)]
    whole, conflicts = payload.merged_nodes(spark.createDataFrame(rows, "id string, type string, source int, properties map<string,string>"))
    want, clash = {}, set()
    for i in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == i]
        props = {}
        for key in {k for r in mine for k in r[3]}:
            best = min(r[2] for r in mine if key in r[3])
            values = {r[3][key] for r in mine if key in r[3] and r[2] == best}
            props[key] = min(values)
            if len(values) > 1:
                clash.add((i, key, "values_differ"))
        best = min(r[2] for r in mine)
        want[i] = (min(r[1] for r in mine if r[2] == best), props)
        if len({r[1] for r in mine}) > 1:
            clash.add((i, "type", "types_differ"))
    assert {r.id: (r.type, dict(r.properties)) for r in whole.collect()} == want
    assert {tuple(r) for r in conflicts.collect()} == clash


def test_edges_have_canonical_ends(spark):
    nodes = spark.createDataFrame([("a1", "Article"), ("c1", "Clause"), ("d", "Document"), ("e1", "LegalConcept"), ("e2", "LegalConcept")], "id string, type string")
    aliases = spark.createDataFrame([("Thuế  suất", "e1"), ("thuế suất", "e1"), ("giá", "e1"), ("giá", "e2")], "name string, id string")
    rows = [
        ("r1", "a1", "DEFINES", " THUẾ suất", {"confidence": "1"}, False), ("r2", "a1", "DEFINES", "e1", {"confidence": "2", "llm_model": "m"}, None), ("r3", "a1", "DEFINES", "giá", {}, False), ("r4", "zz", "DEFINES", "e1", {}, False),
        ("r5", "c1", "REFERS_TO", "d", {"citation_text": "x"}, False), ("r6", "c1", "REFERS_TO", "d", {"citation_text": "y"}, False), ("r7", "c1", "REFERS_TO", "d", {"citation_text": "x"}, True), ("r8", "c1", "REFERS_TO", "c1", {"citation_text": "s"}, False),
        ("r9", "d", "CONTAINS", "c1", {}, False), ("r10", "c1", "AMENDS", "c1", {"effective_from": "2020"}, False),
    ]
    edges, refused = payload.canonical_edges(spark.createDataFrame(rows, "record_id string, head string, type string, tail string, properties map<string,string>, deferred boolean"), nodes, aliases)
    sha = lambda *x: hashlib.sha1("|".join(x).encode()).hexdigest()
    got = {(r.head_id, r.type, r.tail_id, r.relation_id): (dict(r.properties), r.n_records) for r in edges.collect()}
    assert got == {
        ("a1", "DEFINES", "e1", sha("a1", "DEFINES", "e1", "")): ({"confidence": "1", "llm_model": "m"}, 2),
        ("c1", "REFERS_TO", "d", sha("c1", "REFERS_TO", "d", "x", "")): ({"citation_text": "x"}, 1), ("c1", "REFERS_TO", "d", sha("c1", "REFERS_TO", "d", "y", "")): ({"citation_text": "y"}, 1),
        ("c1", "REFERS_TO", "c1", sha("c1", "REFERS_TO", "c1", "s", "")): ({"citation_text": "s"}, 1),
    }
    assert {tuple(r) for r in refused.collect()} == {("r3", "unknown_tail"), ("r4", "unknown_head"), ("r7", "deferred"), ("r9", "pair"), ("r10", "self_loop")}


def test_grouped_ndcg_matches_plain_version(spark):
    ranked, ideal, want = [], [], {}
    for q in range(40):
        best = {g: R.randint(0, 3) for g in range(8)}
        ideal += [(q, g, r) for g, r in best.items()] if q % 10 else []
        got = [(n + 1, R.randrange(8)) for n in range(R.randint(1, 12))]
        rows = [(q, n, g, R.choice([None, *range(best[g] + 1)])) for n, g in got]
        ranked += rows
        order = list(dict.fromkeys(g for _, _, g, _ in rows))
        grade = {g: max((r or 0 for _, _, x, r in rows if x == g), default=0) for g in order}
        gain = lambda rs: sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(rs))
        top = gain(sorted(best.values(), reverse=True)[:4]) if q % 10 else 0
        want[q] = gain([grade[g] for g in order[:4]]) / top if top else 0.0
    found = ranking.grouped_ndcg(spark.createDataFrame(ranked, "query_id long, rank long, grp long, relevance int"), spark.createDataFrame(ideal, "query_id long, grp long, relevance int"), 4).collect()
    assert {r.query_id: pytest.approx(r.grouped_ndcg) for r in found} == want
