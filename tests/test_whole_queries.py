"""Queries that cover their whole tables, on tables made for them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from statuta import catalog
from statuta.operators import conversation, fulltext, hierarchy


def test_trails_start_from_every_document(spark, small):
    li, o, c = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    ends = {r[0] for r in li.join(o, li.l_orderkey == o.o_orderkey).where("l_returnflag = 'R'").select("l_suppkey").collect()}
    ends |= {r[0] * 7 % 97 + 1 for r in o.where("o_orderpriority like '1%'").select("o_custkey").collect()}
    want = {f"d{r[0]}" for r in c.select("c_custkey").collect() if r[0] in ends}
    got = {r.nodes.split(">")[0] for r in catalog.queries()["grf1_all_trails"](spark, small).collect()}
    assert len(want) > 2 and got == want


def test_forms_and_lines_reach_past_prefixes(spark, tmp_path):
    texts = {1: "Đ " * 60 + "End\n" + "x" * 300 + "\nlast\tLINE", 2: "", 3: "ab", 4: " \n "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in catalog.queries()["str_normalised_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: ("d_" * 60 + "end_" + "x" * 300 + "_last_line", "Đ " * 60 + "End " + "x" * 300 + " last LINE", "Đ" * 60 + "END" + "X" * 300 + "LASTLINE"), 2: ("", "", None), 3: ("ab", "ab", "AB"), 4: ("", "", None)}
    lines = {r.doc_id: (r.place, r.line) for r in catalog.queries()["str33_line_at_any_offset"](spark, str(tmp_path)).collect()}
    assert lines[2] == (0, "") and lines[3] == (7919 * 3 % 2, "ab") and len(lines) == 4
    for k, t in texts.items():
        at = lines[k][0]
        assert lines[k][1] == t[t.rfind("\n", 0, at) + 1 :].split("\n")[0]


def test_quote_states_run_to_the_end(spark):
    df = spark.createDataFrame([(1, "a" * 45 + "“" + "b" * 40 + "”"), (2, ""), (3, "“x"), (4, None)], "id int, t string")
    got = {r.id: r.s and [tuple(x) for x in r.s] for r in df.select("id", conversation.quote_states(F.col("t"), 40).alias("s")).collect()}
    assert got == {1: [(40, False), (80, True), (87, False)], 2: [(0, False)], 3: [(2, True)], 4: None}


def test_short_pages_have_spans(spark, tmp_path):
    spark.createDataFrame([(1, "abcdefgh"), (2, "aa"), (3, ""), (4, None), (5, "<p>" * 9)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.start, r.status) for r in catalog.queries()["src12_all_spans"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, "unique"), 2: (0, "unique"), 3: (None, "missing"), 4: (None, "missing"), 5: (None, "repeated")}


def test_parts_of_small_quantities_are_collected(spark, tmp_path):
    lines = [(1, "A", 7, 1.0), (1, "A", 7, 50.0), (1, "A", 3, 10.0), (1, "B", 123456789, 45.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_returnflag string, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.l_suppkey, r.l_returnflag): r.parts for r in catalog.queries()["agg13_all_parts"](spark, str(tmp_path)).collect()}
    assert got == {(1, "A"): "00000003,00000007", (1, "B"): "123456789"}


def test_type_conflicts_of_small_parts_count(spark, tmp_path):
    parts = [(1, "x", "t", 1), (2, "x", "u", 2), (3, "y", "t", 3), (4, "y", "t", 50), (5, None, "t", 1), (6, None, "u", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.decision for r in catalog.queries()["val15_all_type_conflicts"](spark, str(tmp_path)).collect()}
    assert got == {1: "review", 2: "review", 3: "accepted", 4: "accepted", 5: "accepted", 6: "accepted"}


def test_quotes_of_any_item_are_found(spark):
    items = spark.createDataFrame([(7, "the rare  Word stands"), (150, "the rare word stands"), (151, "are"), (152, "c d"), (153, " "), (154, None), (155, "no such word here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xthe RARE\nword standsy and more"), (2, "rare word"), (3, "abc de"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(map(tuple, fulltext.grounded_quotes(docs, items).collect())) == [(1, 7), (1, 150), (1, 151), (2, 151), (3, 152)]


KINDS = {"d": "Document", "h": "Chapter", "s": "Section", "u": "Subsection", "a": "Article", "c": "Clause"}


@pytest.mark.parametrize(("edges", "problems"), [
    ("d>a1 a1>c1", ""), ("d>a1 d>a1", "a1:several_parents"), ("d>h1 h1>a1 h1>s1 s1>a2", ""), ("d>h1 h1>a9 h1>s1 s1>u1 u1>a10", ""), ("d>h1 h1>a3 h1>s1 s1>u1 u1>a2", "h1:order"), ("d>h1 h1>a1 h1>s1", "h1:order_unknown"),
    ("d>s1 s1>a1 s1>u1 u1>a2", "s1:mixed_children"), ("d>s1 s1>a1 s1>a2", ""), ("a1>c1 d>s1", "a1:no_parent"),
    ("c1>c2 c2>c3 c3>c1 c3>c4 d>a1", " ".join(f"c{i}:{x}" for i in (1, 2, 3, 4) for x in ("cycle", "invalid_pair", "no_parent"))),
])
def test_structure_problems(spark, edges, problems):
    pairs = [tuple(x.split(">")) for x in edges.split()]
    nodes = [(i, KINDS[i[0]], i[1:]) for i in sorted({x for p in pairs for x in p})]
    got = hierarchy.structure_problems(spark.createDataFrame(nodes, "id string, label string, number string"), spark.createDataFrame(pairs, "head_id string, tail_id string")).collect()
    assert sorted(f"{r.id}:{r.problem}" for r in got) == sorted(problems.split())
