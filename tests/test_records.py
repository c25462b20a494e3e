"""Edge cases of record, path and conversation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.operators import conversation, paths, records, routing


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_reasons_skip_null_checks(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "id int, v int")
    found = df.select("id", records.reasons([("none", F.col("v").isNull()), ("low", F.col("v") < 0)]).alias("r"))
    assert rows(found, "id") == [(1, "none"), (2, ""), (3, "low")]


def test_exactly_one_with_null_keys_and_repeats(spark):
    c = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    assert rows(records.exactly_one(c, a, "k"), "k") == [(None, "NONE"), (1, "MATCHED"), (2, "SEVERAL"), (3, "NONE")]


def test_ledger_keeps_jobs_without_success_last(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job string")
    ledger = spark.createDataFrame([("a", 1, "FAILED"), ("a", 2, "SUCCESS"), ("b", 1, "SUCCESS"), ("b", 2, "FAILED")], "job string, n int, s string")
    assert rows(records.ledger_remainder(jobs, ledger, "job", "s", ["n"]), "job") == [("b",), ("c",)]


def test_reference_records_drop_self_and_unresolved(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 3), (2, 4), (3, None)], "source int, target int")
    assert rows(records.reference_records(m, "source", "target"), "source", "target") == [(1, 2, "DIRECT"), (2, 3, "RANGE"), (2, 4, "RANGE")]


def test_named_versions_need_the_whole_name(spark):
    names = spark.createDataFrame([("Law 1",), ("Law 10",)], "name string")
    titles = spark.createDataFrame([("Law 1",), ("Law 1 (2020)",), ("Law 10 (2021)",), ("Law 1 and more",), (None,)], "title string")
    assert rows(records.named_versions(names, titles, "name", "title"), "title") == [("Law 1", "Law 1", True), ("Law 1", "Law 1 (2020)", False), ("Law 10", "Law 10 (2021)", False)]


def test_anaphora_and_first_replacement(spark):
    df = spark.createDataFrame([(1, "Khoản này, khoản này"), (2, "none"), (3, None)], "id int, t string")
    phrase = conversation.anaphora(F.col("t"))
    got = df.select("id", phrase.alias("p"), conversation.replace_first(F.col("t"), phrase, F.lit("Unit 7")).alias("r"))
    assert rows(got, "id") == [(1, "khoản này", "Unit 7, khoản này"), (2, None, "none"), (3, None, None)]


def test_open_quote(spark):
    df = spark.createDataFrame([(1, "a “b"), (2, "“a” b"), (3, "“a” “b"), (4, "")], "id int, t string")
    assert rows(df.select("id", conversation.open_quote(F.col("t")).alias("o")), "id") == [(1, True), (2, False), (3, True), (4, False)]


def test_explicit_references_stop_at_five(spark):
    got = spark.range(1).select(conversation.explicit_references(F.array(F.lit("A"), F.lit("B"), F.lit("A")), F.array(*map(F.lit, "123"))).alias("x")).first()["x"]
    assert [tuple(p) for p in got] == [("A", "1"), ("A", "2"), ("A", "3"), ("B", "1"), ("B", "2")]


def test_endpoint_status_by_score_and_margin(spark):
    c = spark.createDataFrame([("m", "a", 0.9), ("m", "b", 0.2), ("n", "a", 0.9), ("n", "b", 0.9), ("o", "a", 0.1)], "mention string, id string, score double")
    assert rows(paths.endpoint_status(c, "mention", "score", 0.5, 0.3), "mention") == [("m", "BOUND", "a"), ("n", "AMBIGUOUS", None), ("o", "UNBOUND", None)]


def test_expansion_is_cut_before_validity(spark):
    t = spark.createDataFrame([("s", ["s", "b"], ["2"]), ("s", ["s", "a"], ["1"]), ("s", ["s", "a", "c"], ["1", "3"])], "seed_id string, nodes array<string>, edge_ids array<string>")
    assert [r["nodes"] for r in paths.ranked_expansion(t, 2).orderBy("rank").collect()] == [["s", "a"], ["s", "b"]]


def test_conformance_needs_every_step(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["A"]), (3, ["A", None]), (4, ["A", "B", "B"])], "id int, t array<string>")
    assert rows(df.select("id", paths.conforms(F.col("t"), ["A", "B"]).alias("c")), "id") == [(1, True), (2, False), (3, False), (4, False)]


def test_legacy_edges_stay_without_a_chain(spark):
    legacy = spark.createDataFrame([("d", "c1"), ("d", "c2")], "head_id string, tail_id string")
    chain = spark.createDataFrame([("d", "a"), ("a", "c1"), ("b", "c2")], "head_id string, tail_id string")
    assert rows(paths.unproven_legacy(legacy, chain), "tail_id") == [("d", "c2")]


def test_sub_queries_number_their_parts(spark):
    df = spark.createDataFrame([(1, "one? two"), (2, "  "), (3, None)], "id int, t string")
    assert rows(routing.sub_queries(df, "t", r"\? ").select("id", "pos", "question", "depends_on"), "id", "pos") == [(1, 0, "one", None), (1, 1, "two", 0)]
