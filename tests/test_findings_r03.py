"""What the review of the third round found, each on rows that failed before."""

from __future__ import annotations

import math
import os
import re

import numpy as np
from pyspark.sql import functions as F

from statuta.operators import citations, consistency, fulltext, hierarchy, paths, payload, planning, provider, resolution
from statuta.plans import filter_queries, payload_queries, store_queries
from statuta.sources import files, stores


def test_keywords_end_at_letters_beyond_ascii(spark, tmp_path):
    rows = [(1, "théthe x"), (2, "éles"), (3, "other"), (4, "LİCENSE"), (5, "the"), (6, None), (7, "the_"), (8, "a | the")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(filter_queries.flt19_keyword_classifier(spark, str(tmp_path)).collect())
    assert got == {1: "keep", 2: "keep", 3: "partial", 4: "reject", 5: "keep", 6: "partial", 7: "partial", 8: "partial"}


def test_numbers_of_any_length_contradict_a_target(spark):
    rows = [("Luật số 12345/2020/QH14", "2345/2020/QH14"), ("Luật số 12345/2020/QH14", "12345/2020/QH14"), ("Luật số 1234567/2020/QH14", "9/2020/QH14")]
    d = spark.createDataFrame(rows, "citation string, number string")
    assert [r[0] for r in d.select(provider.number_conflicts(F.col("citation"), F.col("number"))).collect()] == [True, False, True]


def test_messages_name_documents_of_any_number(spark):
    units = spark.createDataFrame([("12345", "Luật", "Document", "12345/2020/QH14", None), ("2345", "Luật", "Document", "2345/2020/QH14", None)], "id string, label string, type string, number string, article string")
    messages = spark.createDataFrame([(1, 0, "Luật số 12345/2020/QH14?")], "conv_id long, turn long, text string")
    assert [u["id"] for u in resolution.named(messages, units, ["conv_id", "turn"]).first()["found"]] == ["12345"]


def test_vectors_meet_in_slices(spark):
    """Scores are made a slice at a time, with ties and more neighbours asked for than there are; a shard and a block bound what a worker holds."""
    v = np.random.default_rng(2).standard_normal((90, 4))
    v[40:80] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    asked = rows.where("id % 9 = 3").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    unit = v.astype("float32").astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for k in (5, 200):
        for own in (False, True):
            got = {}
            for r in fulltext.vector_candidates(rows, asked, k, own=own, shard_rows=50, block=4, cells=70).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            for q in range(3, 90, 9):
                ids = np.array([i for i in range(90) if own or i != q])
                assert got[q] == ids[np.lexsort((ids, -np.round(unit[ids] @ unit[q], 12)))[:k]].tolist()


def test_counts_of_neighbours_are_those_of_the_pairs(spark):
    """Loops, parallel and mutual edges, nodes of several documents, reached nodes with edges between them, documents that reach one, many or nothing."""
    r = np.random.default_rng(5)
    for n_nodes, n_edges in ((12, 14), (40, 45), (9, 30)):
        e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in r.integers(0, n_nodes, (n_edges, 2))], "head_id string, tail_id string")
        owners = spark.createDataFrame([(f"d{i % 7}", f"n{i}") for i in range(n_nodes)] + [("d0", "n1"), ("d5", "n1"), ("d9", "alone")], "document_id string, id string")
        near = {(x.document_id, x.distance): x["count"] for x in paths.neighbours(e, owners, 2).groupBy("document_id", "distance").count().collect()}
        got = {x.document_id: (x.one, x.two) for x in paths.neighbour_counts(e, owners).collect()}
        assert got == {f"d{i}": (near.get((f"d{i}", 1), 0), near.get((f"d{i}", 2), 0)) for i in (*range(7), 9)}


def test_two_hops_through_a_hub_make_no_pairs(spark):
    """20,000 documents that reach one hub have 400 million pairs at distance 2; their numbers need none."""
    ids = spark.range(20_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_id"))
    e, owners = ids.select(F.concat("document_id", F.lit("_art")).alias("head_id"), F.lit("hub").alias("tail_id")), ids.select("document_id", F.concat("document_id", F.lit("_art")).alias("id"))
    assert [tuple(x) for x in paths.neighbour_counts(e, owners).groupBy("one", "two").count().collect()] == [(1, 19_999, 20_000)]


def test_manifest_of_packed_folders(spark):
    packed = spark.createDataFrame([("raw/A/metadata.json", '{"title":"T","number":null}'), ("B/metadata.json", '{"number":"1/2020"}'), ("B/text.txt", "x"), ("metadata.json", "{}")], "file string, content string")
    assert sorted(map(tuple, files.packed_manifest(packed).where("code is not null").collect())) == [("A", "T", None, None), ("B", None, "1/2020", None)]


def test_manifest_writes_no_file_for_each_document(spark, small, monkeypatch):
    made = []
    new = stores.new_folder
    monkeypatch.setattr(stores, "new_folder", lambda *a: made.append(new(*a)) or made[-1])
    rows = store_queries.src6_folder_manifest(spark, small).count()
    assert rows > 100 and sum(len(f) for _, _, f in os.walk(made[0])) < 50


def test_plans_of_one_anchor_are_walked_once(spark):
    """Plans that share an anchor and their steps share a walk, whose rows follow the edges and not plans times edges; each meets the ends of its own target."""
    n = 400
    edges = [("d%d" % i, "CONTAINS", "a%d" % i, None) for i in range(n)] + [("a%d" % i, "AMENDS", "hub", None) for i in range(n)] + [("a7", "AMENDS", "hub", None)]
    e = spark.createDataFrame(edges, "head_id string, type string, tail_id string, effective_from date")
    nodes = spark.createDataFrame([("hub", "Document")] + [(f"{k}{i}", label) for i in range(n) for k, label in (("d", "Document"), ("a", "Article"))], "id string, label string")
    nodes = nodes.select("id", "label", F.when(F.col("label") == "Article", F.col("id")).alias("citable"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    up, three = [("AMENDS", "incoming", "Article"), ("CONTAINS", "incoming", "Document")], [("CONTAINS", "outgoing", "Article"), ("AMENDS", "outgoing", "Document"), ("AMENDS", "incoming", "Article")]
    plans = [(f"up{i}", "hub", f"d{i}", up, None) for i in range(n)] + [("all", "hub", None, up, None), ("other", "hub", "hub", up, None), ("none", None, "d1", up, None), ("three", "d1", "a3", three, None)]
    p = spark.createDataFrame(plans, "plan_id string, anchor string, target string, steps array<struct<relation:string,direction:string,label:string>>, query_date date")
    walks = planning._walks(p.where("plan_id like 'up%'").select("anchor", "steps").distinct(), e, nodes)
    assert walks.count() == n + 1
    got = {r.plan_id: (r.reason, r.nodes, r.citable) for r in planning.executed(p, e, nodes).collect()}
    assert got == {f"up{i}": ("SATISFIED", ["hub", f"a{i}", f"d{i}"], [f"a{i}"]) for i in range(n)} | {"all": ("PATH_BUDGET_EXCEEDED", None, None), "other": ("NO_PATH", None, None), "none": ("INVALID_PLAN", None, None), "three": ("SATISFIED", ["d1", "a1", "hub", "a3"], ["a1", "a3"])}


def test_scores_of_words_are_added_where_the_postings_lie(spark):
    """Pairs of questions and documents are never shuffled before the best of each question are taken; repeated ids are one document, and many terms give the same by shuffles."""
    docs = spark.createDataFrame([(i % 280, " ".join(f"w{j % 7}" for j in range(i % 11)) + f" x{i % 5}") for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(q, f"w{q % 7} W{(q + 2) % 7} x{q % 5} lost") for q in range(50)], "query_id long, text string")
    got = fulltext.bm25(docs, asked, 10)
    ranked = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in got.collect()}
    assert len(ranked) == 500
    assert ranked == {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in fulltext.bm25(docs, asked, 10, most_terms=0).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id#" in line and ", id#" in line.partition("hashpartitioning")[2].partition(")")[0]]


def test_checks_of_structure_read_their_input_once(spark, tmp_path):
    """Neither the checks of parsed documents nor those of containment read (and parse) their input again for each check."""
    text = "doc_id long, kind string, number string, part string, chapter string, section string, subsection string"
    spark.createDataFrame([(1, "Part", "1", None, None, None, None), (1, "Article", "1", "1", "I", None, None), (1, "Article", "1", "1", "I", None, None), (2, "Article", "4", "9", "I", None, None)], text).write.parquet(str(tmp_path / "units"))
    faults = consistency.problems(spark.read.parquet(str(tmp_path / "units")))
    assert sorted(map(tuple, faults.collect())) == [(1, "duplicate_article", "1", 1), (2, "article_missing_part", "4", 1)]
    spark.createDataFrame([("d", "Document", ""), ("a", "Article", "1"), ("c", "Clause", "1")], "id string, label string, number string").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([("d", "a"), ("d", "c")], "head_id string, tail_id string").write.parquet(str(tmp_path / "edges"))
    wrong = hierarchy.structure_problems(spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "edges")))
    assert sorted(map(tuple, wrong.collect())) == [("c", "invalid_pair"), ("c", "no_parent")]
    for rows in (faults, wrong):
        assert "FileScan" not in rows._jdf.queryExecution().executedPlan().toString()


def test_mentions_are_searched_where_they_can_begin_and_once(spark):
    """Patterns are tried at the few places where one of their words begins, and a mention's verdict doesn't search its text again."""
    text = "các khoản 1 và 2 ĐIỀU 3; xđiều 4 Äđ điểm a khoản 1 Điều 4 éô Luật 5/2020/QH14 các " + "con que " * 9
    plain = sorted((m.start(), name) for name, p in citations.PATTERNS for m in p.finditer(text))
    assert {at for at, _ in plain} <= set(citations.beginnings(text)) == {m.start() for m in citations.BEGINNING.finditer(text)}
    assert [x["kind"] for x in citations.found_in(text, [], None)] == ["local_clauses", "local_point", "external_document"]
    assert citations.found_in("Điều 3 và Điều 4", [(5, 6)], None)[0]["start"] == 10
    rows = spark.createDataFrame([(1, "d1", "d1_art1", "Điều 1")], "doc_id long, document_id string, unit_id string, text string")
    context = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("article", "clause", "article_id", "clause_id", "chapter_id", "part_id", "appendix_id")])
    units = spark.createDataFrame([("d1_art1", "Article", "d1", "1")], "id string, kind string, document_id string, article string")
    units = units.select("*", *[F.lit(None).cast("string").alias(c) for c in citations.COORDINATES[1:] if c != "article"])
    out = citations.resolved(citations.mentions(rows.withColumn("context", context), "text"), units, spark.createDataFrame([("1", "d1")], "number string, document_id string"), ["doc_id"])
    assert out.select("status", "targets", "is_self").collect() == [("RESOLVED", ["d1_art1"], True)]
    assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_units_end_without_shrinking_frames(spark):
    """A unit's end is looked for from the document's end, and units without contents don't read the texts again."""
    text = "1. early\na) early\nĐiều 1. a\n" + "\n".join(f"{i}. c\na) p" for i in range(1, 400)) + "\nChương II\nĐiều 2. b\na) text\n1. d\n\n"
    docs = spark.createDataFrame([(1, text), (2, None), (None, "Điều 1. a")], "doc_id long, text string")
    found = hierarchy.spans(docs)
    rows = {r["unit_id"]: r for r in found.collect()}
    assert len(rows) == 1 + 399 * 2 + 3 and {r["doc_id"] for r in rows.values()} == {1}
    shown = lambda unit: text[rows[unit]["start_char"] : rows[unit]["end_char"]]
    assert shown("1_art1_cl7") == "7. c\na) p" and shown("1_art1_cl399_pa") == "a) p" and shown("1_art2") == "Điều 2. b\na) text\n1. d" and shown("1_art1").endswith("399. c\na) p")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan and "Join" not in plan
    assert {(r["unit_id"], r["content"]) for r in hierarchy.parse(docs).collect()} == {(u, shown(u)) for u in rows}


def test_nodes_are_merged_in_one_pass(spark, small, monkeypatch):
    """Nodes and their conflicts come from one aggregation, and the nodes' query makes no candidates of links."""
    rows = [("n", "A", 1, {"k": "x", "m": "1"}), ("n", "B", 0, {"k": "z"}), ("n", "B", 0, {"k": "y", "o": None}), ("n", "A", 1, {"m": "1"}), ("e", "C", 2, {})]
    got = payload.merged(spark.createDataFrame(rows, "id string, type string, source int, properties map<string,string>"))
    found = {r["id"]: (r["type"], r["properties"], sorted(map(tuple, r["conflicts"]))) for r in got.collect()}
    assert found == {"n": ("B", {"k": "y", "m": "1", "o": None}, [("k", "values_differ"), ("type", "types_differ")]), "e": ("C", {}, [])}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()

    def unwanted(*_):
        raise AssertionError("candidates are no nodes")

    monkeypatch.setattr(provider, "candidates", unwanted)
    assert payload_queries.grf16_payload_nodes(spark, small).where("type = 'Document'").count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_scores_of_words_meet_no_table_of_counts(spark):
    """The corpus' counts are two numbers, made once, with the words cut as for the postings, not joined to every pair of question and document."""
    texts = {1: "Apple pie, apple!", 2: "a pie", 3: None, 4: "", 5: "théâtre apple", 6: "a b c d e f g pie"}
    words = {i: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w] for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(7, "Apple PIE apple"), (8, "théâtre"), (9, None)], "query_id long, text string")
    mean, want = sum(map(len, words.values())) / 6, set()
    for q, terms in ((7, ("apple", "pie")), (8, ("théâtre",))):
        for i, w in words.items():
            if set(terms) & set(w):
                df = {t: sum(t in x for x in words.values()) for t in terms}
                want.add((q, i, round(sum(math.log(1 + (6 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms), 9)))
    got = fulltext.bm25(docs, asked, 10)
    assert {(r["query_id"], r["id"], round(r["score"], 9)) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "join cross" not in plan and "regexp" not in plan
    assert fulltext.bm25(docs.limit(0), asked, 10).count() == 0
