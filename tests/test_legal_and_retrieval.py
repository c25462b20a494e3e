"""Legal-text functions, parser, citations and hybrid retrieval: odd inputs, errors, and plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.functions import legal
from statuta.operators import citations, fulltext, outline_parser, retrieval, rules
from statuta.sources import files, stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_limits_and_filter_values():
    with pytest.raises(ValueError):
        retrieval.Limits(candidates=5, final=6)
    with pytest.raises(ValueError):
        retrieval.Limits(candidates=300)
    assert retrieval.filter_values([" a", "b "]) == ["a", "b"]
    for bad in (["a", "a "], [" "]):
        with pytest.raises(ValueError):
            retrieval.filter_values(bad)


def test_unknown_wordings_are_errors_where_strict(spark):
    for column in (legal.legal_status(F.lit("whatever"), True), legal.type_of_document(F.lit("x"), F.lit("1"), True)):
        with pytest.raises(Exception, match="Unknown|Unsupported"):
            one(spark, column)
    assert one(spark, legal.legal_status(F.lit(None).cast("string"))) == "ACTIVE"
    assert one(spark, legal.nfc(F.lit("é"))) == "é" and one(spark, legal.spacing_repaired(F.lit(None).cast("string"))) is None


def test_vectors_against_numpy(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((300, 8))
    v[7] = v[9]
    rows = spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "id long, v array<double>, label string")
    asked = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for group, parts in ((None, {"": np.arange(300)}), ("label", {"a": np.arange(0, 300, 2), "b": np.arange(1, 300, 2)})):
        got = {}
        for x in fulltext.vector_candidates(rows, asked, 6, group, shard_rows=70, block=2).orderBy("query_id", "kind", "rank").collect():
            got.setdefault((x.query_id, x.kind), []).append(x.id)
        for q in range(5):
            for kind, ids in parts.items():
                ids = ids[ids != q]
                s = np.round(unit[ids] @ unit[q], 12)
                assert got[q, kind] == ids[np.lexsort((ids, -s))[:6]].tolist()
    assert fulltext.vector_candidates(rows.limit(0), asked, 3).count() == 0 and fulltext.vector_candidates(rows, asked.limit(0), 3).count() == 0


def test_bm25_of_no_questions_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, None), (3, ""), (4, "c a")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "B zzz"), (2, None)], "query_id long, text string")
    assert [(r.query_id, r.id) for r in fulltext.bm25(docs, asked, 5).collect()] == [(1, 1)]
    assert fulltext.bm25(docs, asked.limit(0), 5).count() == 0 and fulltext.bm25(docs.limit(0), asked, 5).count() == 0


def test_parser_takes_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "Điều 1"), (5, "Điều 1. A\r\n1. x\r\n1. y\r\nĐiều 2. B\r\n1. z"), (6, "a) b")], "doc_id long, text string")
    found = outline_parser.roles(docs)
    assert {r.doc_id: r.status for r in outline_parser.diagnostics(found).collect()} == {4: "SOURCE_PRESERVED", 5: "PARSED", 6: "SOURCE_PRESERVED"}
    units = [(r.kind, r.number, r.content) for r in outline_parser.units(found.where("doc_id = 5")).orderBy("line_no").collect()]
    assert units == [("Article", "1", ""), ("Clause", "1", "x 1. y"), ("Article", "2", ""), ("Clause", "1", "z")]
    assert outline_parser.units(outline_parser.roles(docs.limit(0))).count() == 0


def test_mentions_do_not_overlap():
    found = citations.found_in("Điều 1. Theo khoản 2 Điều 3 và điểm a khoản 1 Điều 4 Luật 5/2020/QH14", [], 0)
    assert [(m["kind"], m["raw"]) for m in found] == [("local_clauses", "khoản 2 Điều 3"), ("external_point", "điểm a khoản 1 Điều 4 Luật 5/2020/QH14")]
    assert citations.found_in("theo Điều 3 và Điều 4", [(5, 11)], None)[0]["article"] == "4" and citations.found_in("", [], None) == []


def test_deep_chains_and_cycles(spark):
    units = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [("a", "b"), ("b", "a")], "id string, parent_id string")
    got = {r.id: r.chain for r in rules.ancestor_chains(units).collect()}
    assert len(got) == 40 and got["n39"] == ">".join(f"n{i}" for i in range(40))


def test_texts_of_several_lines_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n")
    assert files.whole_texts(spark, str(tmp_path)).first().text == "one\ntwo\n"
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "x.json").write_text('{\n "a": {"v": 1},\n "b": {"v": 2}\n}')
    assert {r.key for r in files.keyed_json(spark, str(tmp_path / "k"), "struct<v:int>").collect()} == {"a", "b"}


def test_builds_by_content(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    first = stores.publish_by_content(rows, str(tmp_path / "r"))
    assert first == stores.publish_by_content(rows.orderBy(F.desc("id")), str(tmp_path / "r")) != stores.publish_by_content(rows.limit(1), str(tmp_path / "r"))
    assert stores.load_build(spark, str(tmp_path / "r"), first).count() == 2


def test_document_numbers_and_citations(spark):
    number = lambda t, strict=False: one(spark, legal.document_number(F.lit(t).cast("string"), strict))
    assert number(" 59 /2020/ Qh14") == "59/2020/QH14" and number("1/ND-CP\u00a0") == "1/ND-CP" and number("e\u0302\u0323") == "Ệ"
    assert number("") is None and number(" \t") is None and number(None) is None
    with pytest.raises(Exception, match="blank document number"):
        number(" ", True)
    assert one(spark, legal.citation_text(F.lit("  theo  Đie\u0302\u0300u\n5 "))) == "theo Điều 5" and one(spark, legal.citation_text(F.lit(None).cast("string"))) is None
