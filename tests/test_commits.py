"""Writes that break in the middle, builds by content, guarded bundles, chains and cycles, closures, short quotes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import fulltext, graph, rules
from statuta.sources import stores, upsert

R = random.Random(3)


def broken(rows):
    """The rows, with one that fails when it is written."""
    return rows.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken off")).cast("long")).otherwise(F.col("id")))


def test_a_broken_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.range(100)
    with pytest.raises(FileNotFoundError):
        stores.replace(rows, root)
        stores.delete(spark, stores.current(spark, root) + "/_SUCCESS")
        stores.current(spark, root)
    root = str(tmp_path / "u")
    first = stores.replace(rows.where("id < 10"), root)
    with pytest.raises(Exception, match="broken off"):
        stores.replace(broken(rows), root)
    assert stores.current(spark, root).endswith(first) and spark.read.parquet(stores.current(spark, root)).count() == 10
    left = stores.clean_up(spark, root)
    assert all(x.startswith("versions/") for x in left) and spark.read.parquet(stores.current(spark, root)).count() == 10
    second = stores.replace(rows, root)
    assert second != first and spark.read.parquet(stores.current(spark, root)).count() == 100
    stores.replace_text(spark, str(tmp_path / "x"), "one\ntwo")
    stores.replace_text(spark, str(tmp_path / "x"), "đổi\n\n")
    assert stores.read_text(spark, str(tmp_path / "x")).first().value == "đổi\n\n"


def test_half_written_builds_are_written_again(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    name = stores.row_digest(rows)
    rows.limit(5).write.parquet(f"{root}/build_id={name}")
    stores.delete(spark, f"{root}/build_id={name}/_SUCCESS")  # what a job left that broke off before its commit
    with pytest.raises(FileNotFoundError):
        stores.load_build(spark, root, name)
    assert stores.publish_by_content(rows, root) == name and stores.load_build(spark, root, name).count() == 1000
    assert stores.publish_by_content(rows.orderBy(F.desc("id")).repartition(7), root) == name
    assert not [c for c in stores._children(spark, root) if c.startswith("_aside")]


def test_digests_tell_rows_apart(spark):
    rows = [(i, R.choice("abc")) for i in range(300)]
    d = lambda x: stores.row_digest(spark.createDataFrame(x, "id long, v string"))
    assert d(rows) == d(rows[::-1]) and len({d(rows), d(rows[1:]), d([*rows, rows[0]]), d([*rows[1:], (0, None)]), d([*rows[1:], (0, "")]), d(rows[:0])}) == 6


def test_bundles_are_all_or_none(spark, tmp_path):
    def edges(*rows):
        return spark.createDataFrame([(b, "h", "REFERS_TO", t, f"{b if own else 'x'}>{t}", n) for b, t, n, own in rows], "bundle_id string, head_id string, type string, tail_id string, relation_id string, expected long")

    nodes = spark.createDataFrame([(x,) for x in ("h", "a", "b", "c")], "id string")
    write = lambda e: {r.bundle_id: r.status for r in upsert.write_bundles(e, str(tmp_path / "w"), nodes).collect()}
    stored = lambda: sorted((r.bundle_id, r.tail_id) for r in spark.read.parquet(stores.current(spark, str(tmp_path / "w"))).collect())
    assert write(edges(("p", "a", 2, 1), ("p", "b", 2, 1), ("q", "a", 2, 1), ("r", "zz", 1, 1), ("s", "c", 1, 0))) == {"p": "WRITTEN", "q": "INCOMPLETE", "r": "MISSING_END", "s": "WRITTEN"}
    assert stored() == [("p", "a"), ("p", "b"), ("s", "c")]
    assert write(edges(("p", "a", 2, 1), ("p", "b", 2, 1), ("s", "a", 1, 0), ("t", "c", 1, 0), ("u", "c", 1, 1))) == {"p": "UNCHANGED", "s": "TARGET_CHANGED", "t": "CONFLICT", "u": "WRITTEN"}
    assert write(edges(("p", "a", 3, 1), ("p", "b", 3, 1), ("p", "c", 3, 1))) == {"p": "PARTLY_STORED"} and stored() == [("p", "a"), ("p", "b"), ("s", "c"), ("u", "c")]


def test_chains_of_any_depth_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (1004, 1003), (2000, 2000), (3000, 9999)]
    units = spark.createDataFrame(rows, "id long, parent_id long")
    got = {r.id: r.chain.split(">") for r in rules.ancestor_chains(units).collect()}
    assert {i: len(c) for i, c in got.items()} == {i: i + 1 for i in range(300)} | {3000: 1}
    assert got[299] == [str(i) for i in range(300)]
    assert {r.id for r in rules.cycles(units).collect()} == {1000, 1001, 1002, 1003, 1004, 2000}


@pytest.mark.parametrize("more", [[(0, 5)], []])  # with and without a unit of two parents
def test_closure_goes_to_the_end(spark, more):
    pairs = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (31, 40), (40, 41), *more]
    edges = spark.createDataFrame([(str(a), "CONTAINS", str(b)) for a, b in pairs], "head_id string, type string, tail_id string")
    want: dict[tuple, int] = {}
    for start in {a for a, _ in pairs}:
        seen, level, depth = {start}, {start}, 0
        while level:
            depth += 1
            level = {b for a, b in pairs if a in level} - seen
            seen |= level
            want |= {(str(start), str(b)): depth for b in level}
    assert {(r.ancestor_id, r.unit_id): r.depth for r in graph.closure(edges).collect()} == want
    assert {(r.ancestor_id, r.unit_id): r.depth for r in graph.closure(edges, 2).collect()} == {k: d for k, d in want.items() if d <= 2}


def test_short_quotes_in_blocks(spark):
    words = ["ab", "b", "xab y", "ab c", "q", "an  AB"]
    docs = spark.createDataFrame([(i, " ".join(R.choice(["xab", "y", "abc", "an", "ab", "c"]) for _ in range(R.randint(0, 6)))) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, " "), (98, None)], "item_id long, text string")
    got = {tuple(r) for r in fulltext.grounded_quotes(docs, items, block=2).collect()}
    plain = lambda t: " ".join(t.lower().split())
    assert got == {(d.doc_id, i) for d in docs.collect() for i, w in enumerate(words) if plain(w) in plain(d.text)}
