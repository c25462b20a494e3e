"""Files, sinks, streams and graph components on small fixtures."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from statuta.functions import dates, strings
from statuta.operators import graph, ranking, routing, sets, validity
from statuta.operators.components import connected_components
from statuta.sources import files, lines, upsert
from statuta.streaming import traces


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.json_lines(spark, str(tmp_path / "b.jsonl"), "id long").collect()
    (tmp_path / "c.json").write_text(json.dumps({"k": {"v": 1}, "l": {"v": 2}}))
    assert {(r.key, r.value.v) for r in files.keyed_json(spark, str(tmp_path / "c.json"), "struct<v:int>").collect()} == {("k", 1), ("l", 2)}
    (tmp_path / "m" / "doc1").mkdir(parents=True)
    (tmp_path / "m" / "doc1" / "metadata.json").write_text(json.dumps({"title": "T", "number": "1"}))
    assert files.manifest(spark, str(tmp_path / "m")).first().code == "doc1"


def test_line_spans(spark):
    text = "ab\r\nc\n\nđx"
    got = lines.source_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()
    flat = text.replace("\r\n", "\n")
    assert [(flat[r.start_char : r.end_char], r.line) for r in got] == [(x, x) for x in ("ab", "c", "", "đx")]


def test_publish_and_merge(spark, tmp_path):
    rows = spark.createDataFrame([(1, "accepted")], "id long, decision string")
    upsert.publish(rows, str(tmp_path / "v"), "r1")
    upsert.publish(rows.withColumn("id", F.lit(5)), str(tmp_path / "v"), "r2")
    assert upsert.current_version(spark, str(tmp_path / "v")).first().id == 5
    upsert.write_decisions(rows, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().decision == "accepted"
    new = spark.createDataFrame([(1, None), (2, "x")], "id long, decision string")
    assert sorted(map(tuple, upsert.merged(rows, new, "id").collect())) == [(1, "accepted"), (2, "x")]


def test_components_against_union_find(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(50)] + [(7, 7)]
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    assert {x.node: x.component for x in connected_components(df).collect()} == {n: root(n) for n in parent}
    assert connected_components(df.limit(0)).count() == 0


def test_streams_match_batches(spark, tmp_path):
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = sorted((start + timedelta(minutes=r.randrange(3000)), u, r.choice(["error", "click"])) for u in range(5) for _ in range(30))
    rows = [(i, t, u, e, float(i), "{}") for i, (t, u, e) in enumerate(rows)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for k in range(3):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(999, start + timedelta(days=30), 9, "click", 0.0, "{}")], schema)
    batch = spark.read.parquet(str(tmp_path / "in"))
    for n, f in enumerate((traces.session_status, traces.hourly_counts)):
        folder = str(tmp_path / f"s{n}")
        batch.coalesce(1).write.parquet(folder)
        stream = f(traces.event_stream(spark, folder)).writeStream.outputMode("append").format("memory").queryName(f"out{n}").option("checkpointLocation", str(tmp_path / f"c{n}")).start()
        stream.processAllAvailable()
        end.coalesce(1).write.mode("append").parquet(folder)
        stream.processAllAvailable()
        stream.stop()
        assert sorted(map(tuple, spark.table(f"out{n}").collect()), key=str) == sorted(map(tuple, f(batch).collect()), key=str)


def test_half_open_validity(spark):
    rows = spark.createDataFrame([(1, date(2020, 1, 1), date(2021, 1, 1)), (2, None, None), (3, date(2020, 1, 1), None)], "id int, effective_from date, effective_to date")
    assert {r.id for r in rows.where(validity.valid_on(date(2021, 1, 1))).collect()} == {3}
    assert {r.id for r in rows.where(validity.overlaps(date(2020, 12, 31), date(2022, 1, 1))).collect()} == {1, 3}


def test_text_functions(spark):
    assert one(spark, strings.slug(F.lit(" Điều 5: Nghị định! "))) == "dieu_5_nghi_dinh"
    assert [one(spark, strings.heading_kind(F.lit(t))) for t in ("Điều 5. X", "chương IV", "1. a", "đ) b", "x")] == ["Article", "Chapter", "Clause", "Point", None]
    assert one(spark, strings.is_uppercase_title(F.lit("QUY ĐỊNH"))) and not one(spark, strings.is_uppercase_title(F.lit("123")))
    assert one(spark, strings.point_label(F.lit("đ"))) == "dd"
    assert one(spark, strings.escape_markdown(F.lit("a*b_c"))) == r"a\*b\_c"
    assert one(spark, strings.count_suffix_stripped(F.lit("Amended by (12)"))) == "Amended by"
    assert one(spark, strings.size_chunks(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert not one(spark, strings.contains_quote(F.lit("a b"), F.lit(" ")))
    assert one(spark, dates.explicit_day(F.lit("on 5-2-2021"))) == date(2021, 2, 5)
    assert one(spark, sets.subtract_intervals(F.lit(0), F.lit(10), F.array(F.struct(F.lit(2).alias("s"), F.lit(4).alias("e"))))) == [(0, 2), (4, 10)]
    assert one(spark, routing.intent(F.lit(None).cast("string"), F.lit("REFERS_TO"), F.lit("LISTING"), F.lit(True), F.lit("X"))) == "MULTI_HOP"
    assert one(spark, graph.describe_path(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("T"), F.lit("U")), F.array(F.lit(True), F.lit(False)))) == "a -[T]-> b <-[U]- c"


def test_budget_skips_or_stops(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 9), (1, 3, "c", 4)], "q int, rank int, u string, cost int")
    assert ranking.greedy_pack(rows, ["q"], "rank", "u", "cost", 10).first().taken == ["a", "c"]
    assert [r.u for r in ranking.running_budget(rows, ["q"], ["rank"], F.col("cost"), 10).collect()] == ["a"]
