"""Path shapes, neighbourhoods, paged searches, hard checks, gates, the parser's passes and parts, consistency of parsed documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from statuta.functions import legal
from statuta.operators import consistency, context, outline_parser, paths
from statuta.sources import files

R = random.Random(17)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_path_shapes(spark):
    def error(nodes, edges, text="d"):
        e = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("id", "type", "head", "tail"), x, strict=True)]) for x in edges]) if edges else F.array().cast("array<struct<id:string,type:string,head:string,tail:string>>")
        return one(spark, paths.shape_error(F.array(*map(F.lit, nodes)), e, F.lit(text), ["T"]))

    good = [("r1", "T", "a", "b"), ("r2", "T", "c", "b")]
    assert error(["a", "b", "c"], good) is None
    assert error(["a", "b"], good) == "cardinality" and error(["a"], []) == "no_edge" and error(["a", "B", "c"], good) == "node_id"
    assert error(["a", "b", "c"], [("r1", "X", "a", "b"), good[1]]) == "relation_type" and error(["a", "b", "c"], [("", "T", "a", "b"), good[1]]) == "relation_id"
    assert error(["a", "b", "c"], [good[0], ("r2", "T", "a", "b")]) == "not_adjacent" and error(["a", "b", "c"], [good[0], ("r2", "T", "C", "b")]) == "edge_end"
    assert error(["a", "b", "c"], [good[0], ("r1", "T", "b", "c")]) == "repeated_edge" and error(["a", "b", "c"], good, " ") == "blank_description"
    assert error(["a", "b", "a"], [good[0], ("r2", "T", "a", "b")]) is None


def test_neighbourhoods_match_plain_search(spark):
    pairs = [(f"n{R.randrange(60)}", f"n{R.randrange(60)}") for _ in range(80)]
    owners = [(f"d{i % 7}", f"n{i}") for i in range(60) if i % 3]
    got = {(r.document_id, r.id): r.distance for r in paths.neighbours(spark.createDataFrame(pairs, "head_id string, tail_id string"), spark.createDataFrame(owners, "document_id string, id string")).collect()}
    want = {}
    for d in {d for d, _ in owners}:
        seen = {n for x, n in owners if x == d}
        level = set(seen)
        for distance in (1, 2):
            level = ({b for a, b in pairs if a in level} | {a for a, b in pairs if b in level}) - seen
            seen |= level
            want |= {(d, n): distance for n in level}
    assert got == want
    with pytest.raises(ValueError, match="1 or 2"):
        paths.neighbours(spark.createDataFrame(pairs, "head_id string, tail_id string"), spark.createDataFrame(owners, "document_id string, id string"), 3)


def walk(pages, most_pages, most_documents):
    out, seen, index = [], set(), 1
    while most_pages is None or index <= most_pages:
        rows, fresh = [p for p in pages if p[0] == index], 0
        for p in sorted(rows, key=lambda p: p[1]):
            new = p[2] not in seen
            seen.add(p[2])
            fresh += new
            out.append((p[0], p[1], not new))
            if most_documents is not None and len(seen) >= most_documents:
                return out
        if not rows or not fresh:
            return out
        index += 1
    return out


@pytest.mark.parametrize(("most_pages", "most_documents"), [(None, None), (2, None), (None, 4), (3, 6), (1, 1)])
def test_searches_go_as_far_as_a_plain_walk(spark, most_pages, most_documents):
    rows = []
    for s in range(60):
        urls = R.choice([3, 6, 30])
        rows += [(s, i, p, f"u{R.randrange(urls)}") for i in range(1, R.randint(1, 6)) if R.random() > 0.1 for p in range(R.randint(1, 4))]
    got = {}
    for r in files.discovered(spark.createDataFrame(rows, "search long, page_index long, pos long, url string"), ["search"], most_pages, most_documents).collect():
        got.setdefault(r.search, []).append((r.page_index, r.pos, r.duplicate))
    for s in range(60):
        assert sorted(got.get(s, [])) == sorted(walk([x[1:] for x in rows if x[0] == s], most_pages, most_documents)), s
    with pytest.raises(ValueError, match="at least 1"):
        files.discovered(spark.createDataFrame(rows, "search long, page_index long, pos long, url string"), ["search"], 0)


def test_hard_checks_and_gates(spark):
    cases = spark.createDataFrame([(1, [[1, 2], [3]], True, None), (2, [[1]], False, "V"), (3, [[1]], False, None), (4, [[1]], False, None), (5, [[1]], False, "V"), (6, [], False, None), (7, [[1]], True, "V")], "case_id long, groups array<array<long>>, expects_dates boolean, expects_gap string")
    answers = spark.createDataFrame([(1, False, [2], False, None), (2, False, [1], True, "V"), (3, True, [], False, None), (4, False, [1], False, "V"), (5, False, [1], False, None), (6, False, None, None, None)], "case_id long, cannot_answer boolean, cited array<long>, dated boolean, reported_gap string")
    got = {r.case_id: (r.outcome, list(r.failures)) for r in context.hard_failures(cases, answers).collect()}
    assert got == {
        1: ("answered", ["MISSING_CITATION_GROUP_2", "MISSING_TEMPORAL_DECISION"]), 2: ("unsupported_capability", []), 3: ("cannot_answer", ["UNEXPECTED_CANNOT_ANSWER"]), 4: ("unsupported_capability", ["UNEXPECTED_CAPABILITY_ERROR"]),
        5: ("retrieval_supported", ["EXPECTED_CAPABILITY_ERROR_NOT_RAISED"]), 6: ("answered", []), 7: ("retrieval_supported", ["EXPECTED_CAPABILITY_ERROR_NOT_RAISED"]),
    }
    figures = spark.createDataFrame([(0.5, 3, None)], "a double, b long, c double")
    assert [tuple(r)[::2] for r in context.gates(figures, {"a": (">=", 0.5), "b": ("<=", 2.0), "c": ("==", 0.0)}).collect()] == [("a", True), ("b", False), ("c", False), ("all", False)]
    assert context.gates(figures, {"a": (">=", 0.5)}).where("gate = 'all'").first().passed


def test_second_pass_only_where_the_first_found_nothing(spark):
    texts = [(1, "- Điều 1. A\nx", None), (2, "Điều 1. A\n- Điều 2. B", None), (3, "nothing", None), (4, None, None), (5, "", None), (6, "Chương I\nTên chương\nĐiều 1. A", [1, 1, 99]), (7, "- Điều 1. A\nx", None)]
    found = outline_parser.parsed(spark.createDataFrame(texts, "doc_id long, text string, bold array<long>"), bold_col="bold")
    got = {}
    for r in found.where("role = 'heading'").orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.title, r["pass"]))
    assert got == {1: [("Article", "A", "loose")], 2: [("Article", "A", "strict")], 6: [("Chapter", "Tên chương", "strict"), ("Article", "A", "strict")], 7: [("Article", "A", "loose")]}
    assert {r.doc_id for r in found.where("pass = 'strict'").select("doc_id").distinct().collect()} == {2, 3, 6}
    kind = lambda t: one(spark, legal.instrument_kind(F.lit(t)))
    assert [kind(x) for x in ("QUY CHẾ", "QUY CHẾ  MẪU", "Quy chế", "QUY CHẾN", "ĐIỀU LỆ CÔNG TY", "", None)] == ["REGULATION", "REGULATION", None, None, "CHARTER", None, None]


def test_lines_belong_to_one_part(spark):
    texts = [(1, "a\n\n\nQUY CHẾ\n\n\n\n\nkèm theo Luật này"), (2, "QUY CHẾ\na\nb\nc\nkèm theo Luật này"), (3, "Điều 1. A\nMục lục"), (4, "Mục lục\nĐiều 1. A"), (5, "PHỤ LỤC\nPhụ lục II\nx"), (6, None)]
    got = {}
    for r in outline_parser.owned_lines(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((r.owner, r.scope, r.kind))
    assert got[1] == [("main", 0, None)] * 3 + [("instrument", 1, "REGULATION")] * 6
    assert got[2] == [("main", 0, None)] * 5 and got[4] == [("main", 0, None)] * 2
    assert got[3] == [("main", 0, None), ("contents", 0, None)] and got[5] == [("appendix", 1, None), ("appendix", 2, None), ("appendix", 2, None)]


def test_documents_that_hang_together(spark):
    schema = "doc_id long, kind string, number string, part string, chapter string, section string, subsection string"
    sound = [("Part", "1", None, None, None, None), ("Section", "1", "1", "I", None, None), ("Section", "2", "1", "I", None, None), ("Subsection", "1", "1", "I", "1", None), ("Article", "1", "1", "I", "1", "1"), ("Article", "2", "1", "I", None, None), ("Article", "3", None, None, None, None)]
    faults = {
        2: ([("Article", "1", "1", "II", None, None)], {("duplicate_article", "1")}), 3: ([("Part", "1", None, None, None, None)], {("duplicate_part", "1")}), 4: ([("Section", "5", "9", "I", None, None)], {("section_missing_part", "5")}),
        5: ([("Article", "7", "4", None, "1", None)], {("article_missing_part", "7"), ("article_missing_section", "7")}), 6: ([("Article", "8", None, None, None, "2")], {("subsection_without_section", "8")}), 7: ([("Article", "9", "1", "I", "2", "2")], {("article_missing_subsection", "9")}),
        8: ([("Subsection", "1", "1", "I", "1", None)] * 2, {("duplicate_subsection", "1")}), 9: ([("Subsection", "3", None, "I", "1", None)], {("subsection_missing_section", "3")}),
    }
    rows = [(d, *r) for d in range(1, 10) for r in [*sound, *faults.get(d, ([], set()))[0]]]
    units = spark.createDataFrame(rows, schema)
    got: dict[int, set] = {}
    for r in consistency.problems(units).collect():
        got.setdefault(r.doc_id, set()).add((r.problem, r.number))
    assert got == {d: f for d, (_, f) in faults.items()}
    kept = {(r.doc_id, r.kind, r.number) for r in consistency.without_orphans(units).where("kind in ('Section', 'Subsection') and doc_id in (1, 9)").collect()}
    assert kept == {(d, k, "1") for d in (1, 9) for k in ("Section", "Subsection")}
