"""Tokenizers, licenses, HTML and benchmark passages against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from statuta.llm import decontaminate, html_text, licenses, token_counts, token_files
from statuta.llm.text import words

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [" ", "  ", "a", "b", "é", "漢", "\n", "the", "\t", "😀", ".", "▁", "\x00", "'s", "'", "'ll", "É", "ß", "×", "Σ", "<|endoftext|>", "<|", "1", "½", "²", "é", "́", "\xa0", "\x1c", "\x85", "“", "İ", "!", ",", "...", "_", "dog", "\r", "'T", "ﬁ"]


def odd_texts(n: int, most: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The MIT License, the Apache license!"), (2, None), (3, ""), (4, "mit license mit license"), (4, "mit license mit license"), (None, "GNU General Public  License"), (6, "x " * 3000 + "general public license"), (7, "\t\n"), *[(100 + i, t) for i, t in enumerate(odd_texts(60, 60, 3))]]
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, n_words string, h int")


def test_word_encoder_matches_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    texts = odd_texts(1500, 30, 1)
    assert own.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_word_encoder_leaves_other_tokenizers_to_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.WordEncoder(path)
    texts = odd_texts(300, 30, 7)
    assert not own.by_words and own.encode([*texts, None]) == [*(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts), b""]
    want = Counter(zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect())
    assert Counter(r.ids_crc32 for r in token_files.encoded_digests(docs, path).collect()) == want


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    own = token_files.WordEncoder(WORDS)
    want = [own.encode([t])[0] for t in ("ab cd", "cd ab ef", "x")]
    monkeypatch.setattr(token_files.WordTable, "hashes", lambda self, text, start, end: (end - start).astype(np.uint64))
    own.table.clear()
    assert [own.encode([t])[0] for t in ("ab cd", "cd ab ef", "x")] == want and own.encode(["ab cd", "cd ab ef", "x"]) == want


def test_word_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_KEPT", 3)
    own = token_files.WordEncoder(WORDS)
    a = own.encode(["one two three", "two six seven eight nine ten"])
    assert a == own.encode(["one two three", "two six seven eight nine ten"]) and own.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, tmp_path, encoding):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    path = str(tmp_path / "ids")
    got = token_files.encoded_digests(docs, WORDS, path, encoding=encoding).collect()
    start, want = 0, []
    for doc_id, text in sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_files.read_metadata(spark, path).count() == len(want)
    one = token_files.read_tokens(spark, path, [1]).collect()
    assert len(one) == 1 and one[0].ids[-1] == 1
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, WORDS, path, encoding="none")


def test_token_files_of_no_rows(docs):
    assert token_files.encoded_digests(docs.limit(0), WORDS).count() == 0


def test_token_counts(docs):
    model, stable = token_counts.opened(PIECES)
    assert stable
    for chunk, overlap in ((16, 4), (64, 8)):
        got = token_counts.token_counts(docs, PIECES, 5, chunk, overlap).collect()
        want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 5) for r in docs.collect()]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_counts_refuse_other_files(docs):
    with pytest.raises(ValueError, match="model"):
        token_counts.token_counts(docs, WORDS)
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0


def test_token_counts_widen_overlaps():
    model, _ = token_counts.opened(PIECES)
    for text in (" " * 500, "a" * 500, "漢" * 300, "ab " * 300, "a" + " " * 400 + "b", "▁ x▁▁ y " * 90, "b▁ " * 200, *odd_texts(300, 200, 5)):
        assert token_counts.count_tokens(model, text, True, 16, 4) == len(model.encode(text))


def test_licenses_match_sql(docs):
    texts = docs.select("doc_id", F.regexp_replace("text", "\x00", "").alias("text")).where("doc_id is not null").dropDuplicates()
    extra = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files", "This program is free software: you can redistribute it and/or modify it under terms", "general public general public license"]
    texts = texts.unionByName(texts.sparkSession.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", texts.toPandas())
    want = con.sql(licenses.oracle()).fetchall()
    got = [tuple(r) for r in licenses.scan_licenses(texts).collect()]
    assert sorted(got) == sorted(want)
    by = {r[0]: r for r in got}
    assert by[1][1:8] == (6, 2, 1, 4, "apache,mit", "apache,mit", 1.0)
    assert by[900][6] == "mit" and by[900][2] == 0 and by[902][3] == 2


def test_licenses_repeats_nulls_and_no_rows(docs):
    kelvin = licenses.scan_licenses(docs.sparkSession.createDataFrame([(1, "This wor\u212a is licensed under a creative commons")], "doc_id long, text string")).first()
    assert kelvin.n_words == 8 and kelvin.score == 5 / 8
    got = licenses.scan_licenses(docs)
    assert got.count() == docs.count() and licenses.scan_licenses(docs.limit(0)).count() == 0
    assert [r.n_base for r in got.where("doc_id = 4").collect()] == [2, 2]
    assert got.where("doc_id is null").first().base_labels == "gpl"
    assert tuple(got.where("doc_id = 2").first())[1:8] == (0, 0, None, None, "", "", 0.0)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "c d e f g h i j k l m n"), (3, "x y z"), (4, "y z"), (5, None), (6, "..."), (3, "x y z"), (7, "a b a b a b a b a b a b a")]


def brute(text: str | None, items, window: int):
    w = words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        v = words((t or "").encode())
        for part in [v[i : i + window] for i in range(len(v) - window + 1)] if len(v) >= window else [v] * bool(v):
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("window", "block"), [(10, 1 << 20), (4, 1 << 20), (4, 150)])
def test_decontamination_against_brute_force(spark, window, block):
    r = random.Random(2)
    texts = [" ".join(r.choice("a b c d e f g h i j k l m n x y z".split()) if r.random() < 0.3 else "abcdefghijklmnxyz"[(i + s) % 17] for i in range(r.randint(0, 60))) for s in range(80)]
    texts += ["A b, c d e f G h i j k", "a b a b a b a b a b a b", "", None, "X  y\nz!"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in decontaminate.report(docs, bench, window, block_bytes=block).collect()}
    assert got == {i: brute(t, ITEMS, window) for i, t in enumerate(texts)}
    assert decontaminate.report(docs, bench.limit(0), window).where("n_hit > 0 or n_items > 0").count() == 0
    assert decontaminate.report(docs.limit(0), bench, window).count() == 0


def test_many_blocks_of_items(spark):
    """Each block is a scan of its own; the result has one Python stage for the scan's merge, however many blocks there are."""
    r = random.Random(5)
    items = [(i, " ".join(r.choice("a b c d e f g h".split()) + str(r.randint(0, 9)) for _ in range(r.choice([3, 6, 12, 300])))) for i in range(60)]
    items += [(7, items[7][1])] * 40 + [(None, items[8][1])]
    texts = [" ".join(f"z{r.randint(0, 9)}" for _ in range(r.randint(0, 9))) + " " + (t if (k := r.random()) < 0.4 else " ".join(t.split()[3:40]) if k < 0.8 else "") + " tail" for _, t in items] + [None, "", items[3][1] * 2]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(docs, bench, 5, block_bytes=1000)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    got = sorted(tuple(x) for x in found.collect())
    named = [x for x in items if x[0] is not None]
    assert got == sorted((i, *brute(t, named, 5)) for i, t in [*enumerate(texts), (0, texts[0])])


def test_long_items_are_cut_at_whole_windows():
    w = [f"w{i}".encode() for i in range(200)]
    for most in (1, 30, 100, 5000):
        parts = [words(p) for p in decontaminate.pieces(b" ".join(w), 10, most)]
        assert {tuple(p[i : i + 10]) for p in parts for i in range(len(p) - 9)} == {tuple(w[i : i + 10]) for i in range(191)} and all(len(p) >= 10 for p in parts)


def test_very_long_texts(spark):
    long = "word and more " * 200_000
    docs = spark.createDataFrame([(1, long + "a b c d e f g h i j k"), (2, "short")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (600_011, 11), 2: (1, 0)}
    page = "<p>" + "<b>x</b> y " * 300_000 + "</p>" + "<div><ul><li>" * 1000 + "deep"
    shown = html_text.extract_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert shown.n_items == 1000 and shown.text.startswith("x y x y") and shown.text.endswith("deep") and shown.text.count("x y") == 300_000


def test_decontaminate_cuts_and_drops(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b c d E f g h i j, and that " + "w " * 20, 7), (2, "a b c d e f g h i j k", 7), (3, None, 7), (4, "clean", None)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    got = {r.doc_id: (r.text, r.spans) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: ("Keep this. , and that " + "w " * 20, 7), 3: (None, 7), 4: ("clean", None)}


PAGE = """<!doctype html><html><head><title>no</title><style>.ad{display:none} #x, p.y {visibility:hidden}</style><script>var t="</p>";</script></head>
<body><nav><ul><li>A<li>B<ul><li>b1</ul></ul></nav><div class="ad big">no</div><div hidden>no</div><p style="color:red; display: none">no</p><p class=y>no</p>
<h1>Head &amp; tail&nbsp;x</h1><p>one <b>two</b>
 three<br>four<p>five<!-- no --><table><caption>Cap</caption><thead><tr><th>Name<th>Qty</thead><tr><td>apple<td>3<tr><td colspan=2>all of it<tr><td>longer name<td>12</table>
<pre>
 a
   b
</pre><ol start=3><li>x<p>y</p><li>z</ol><details><summary>S</summary>no</details><input type=hidden value=no><input type=submit value=Go>end</body></html>"""
SHOWN = "- A\n- B\n  - b1\n\nHead & tail x\n\none two three\nfour\n\nfive\n\nCap\nName         Qty\napple        3\nall of it\nlonger name  12\n\n a\n   b\n\n3. x\n\n   y\n4. z\n\nS\nGo end"


def test_html_layout():
    assert html_text.render(PAGE) == (SHOWN, 5, 1)


@pytest.mark.parametrize(("html", "text"), [("", ""), ("plain < text", "plain < text"), ("<p>a<p>b", "a\n\nb"), ("a<script>x", "a"), ("<div>" * 500 + "deep" + "</div>" * 500 + "z", "deep\nz"), ("<table><tr><td>a<table><tr><td>b</table><td>c</table>", "a  c\n\nb"), ("<td>x</td>y", "x y"), ("<a href='<p>'>q</a>", "q"), ("<b", "<b"), ("&lt;p&gt;", "<p>"), ("<textarea><b>x</textarea>", "<b>x"), ("<ul><li><ul><li>z</ul></ul>", "-\n  - z")])
def test_html_cases(html, text):
    assert html_text.render(html)[0] == text


def test_wide_cells_align_and_deep_pages_keep_their_layout():
    lines = html_text.render("<table><tr><td>" + "a" * 200 + "<td>x<tr><td>b<td>y</table>")[0].split("\n")
    assert [x.index(c) for x, c in zip(lines, "xy", strict=True)] == [202, 202]
    assert html_text.render("<div>" * 1000 + "<p>a<p>b" + "</div>" * 1000 + "z")[0] == "a\n\nb\n\nz"
    deep = html_text.render("<ul><li>" * 1000 + "x")[0].split("\n")
    assert len(deep) == 1000 and deep[500] == " " * 1000 + "-" and deep[-1] == " " * 1998 + "- x"
    assert html_text.render("<table><tr><td>" * 1000 + "x")[0] == "x"


def test_padding_is_bounded(monkeypatch):
    monkeypatch.setattr(html_text, "MOST_PADDING", 100)
    rows = "<tr><td>" + "a" * 50 + "<td>b<td>c" + "<tr><td>a<td>bb<td>c" * 4
    assert html_text.render(f"<table>{rows}</table>")[0].split("\n")[1:] == ["a  bb  c"] * 4


@pytest.mark.parametrize(("rule", "shown"), [
    (".a .b", "2 3 4"), (".a > .b", "1 2 3 4"), ("i > .b", "2 3 4"), ("div.a.x i", "3 4"), ("div i *", "2 3 4"), ("#q[role=x]", "1 2 3"), ("[role]", "1 2 3"), ("i:hover", "1 2 3 4"), (".b + u", "1 2 3 4"), ("u, .none", "1 2 4"), ("div.a.y i", "1 2 3 4"),
])
def test_html_selectors(rule, shown):
    page = "<div class='a x'><i><b class=b>1</b> 2</i></div> <u class=b>3</u> <s id=q role=x>4</s>"
    assert html_text.render(f"<style>{rule}{{display:none}}</style>{page}")[0].split() == shown.split()


@pytest.mark.parametrize(("css", "shown"), [
    ("@media print{.ad,nav{display:none}}", "a b"), ("@media (max-width:9px){.ad{display:none}} nav{color:red}", "a b"), ("@media screen{.ad{display:none}}", "b"),
    ("@media print{p{x:y} .ad{display:none}} nav{display:none}", "a"), ("@media not print{.ad{display:none}}", "b"), ("@media print,all{nav{display:none}}", "a"), ("@import url(x);.ad{display:none}", "b"),
    ("@media screen and (color){nav{display:none}}", "a b"), ("@supports (x:y){nav{display:none}}", "a b"), (".x::after{content:'}{'} .ad{display:none}", "b"), (".x{color:red;nav{display:none}}", "a b"), ("@layer q{@media print{nav{display:none}}.ad{display:none", "b"),
])
def test_html_style_rules_for_other_media_hide_nothing(css, shown):
    assert html_text.render(f"<style>{css}</style><span class=ad>a</span> <nav style='x:y'>b</nav>")[0].split() == shown.split()
    assert html_text.render("<style media=print>i{display:none}</style><i>a</i>")[0] == "a"


@pytest.mark.parametrize(("css", "page", "shown"), [
    (".menu{display:none} .menu.open{display:block}", "<p class='menu open'>a</p><p class=menu>b</p>", "a"),
    (".menu.open{display:block} .menu{display:none}", "<p class='menu open'>a</p>", "a"),
    (".x{display:block} .x{display:none}", "<p class=x>a</p>b", "b"), (".x{display:none} .x{display:block}", "<p class=x>a</p>b", "a b"),
    (".a{display:none}", "<p class=a style='display:block'>a</p>", "a"), (".a{display:none!important}", "<p class=a style='display:block'>a</p>b", "b"),
    (".a{display:none !important}", "<p class=a style='display:block ! important'>a</p>", "a"), ("#i{display:block} .a.b.c p, p{display:none}", "<p id=i class='a b c'>a</p>", "a"),
    (".h{visibility:hidden} .v{visibility:visible}", "<div class=h>a<p class=v>b</p>c<p>d</p></div>e", "b e"), (".h{visibility:hidden}", "<div class=h>a<p style='visibility:visible'>b<i style='visibility:collapse'>c</i></p></div>", "b"),
    (".h{display:none} .v{display:block;visibility:visible}", "<div class=h>a<p class=v>b</p></div>c", "c"), ("[hidden]{display:block}", "<p hidden>a</p>", "a"), ("p{color:red}", "<p hidden>a</p>b", "b"), ("dialog{display:flex}", "<dialog>a</dialog>", "a"),
    ("p{display:nonsense} p{display:none} p{display:grid gird}", "<p>a</p>b", "b"), ("p{display:none;display:block}", "<p>a</p>", "a"), ("p{display:none/* x */;color:red}", "<p>a</p>b", "b"),
    ("@layer l{p{display:none}} p{display:block}", "<p>a</p>", "a"), ("p{display:block} @layer l{p.x{display:none}}", "<p class=x>a</p>", "a"), ("p{display:block!important} @layer l{p{display:none!important}}", "<p>a</p>b", "b"),
    ("ul > li.t > a{display:none} li a{display:inline}", "<ul><li class=t><a>a</a><ol><li><a>b</a></ol></ul>", "- 1. b"), ("div > p span{display:none}", "<div><b><p><span>a</span></b></div><div><p><i><span>b</span></i></div>", "a"),
])
def test_html_cascade(css, page, shown):
    assert html_text.render(f"<style>{css}</style>{page}")[0].split() == shown.split()


def test_html_selectors_take_linear_time():
    page = "<style>.nope div div div div p{display:none} div div div > div p{color:red;display:block}</style>" + "<div>" * 45 + "<p>x" * 300 + "</div>" * 45
    began = time.perf_counter()
    assert html_text.render(page)[0].split() == ["x"] * 300
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize(("html", "shown"), [("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"), ("<ol><li>a<li value=7>b<li>c<li value=x>d</ol>", "1. a\n7. b\n8. c\n9. d"), ("<ol start=-1><li>a<li>b</ol>", "-1. a\n0. b")])
def test_html_list_numbers(html, shown):
    assert html_text.render(html)[0] == shown


@pytest.mark.parametrize(("html", "shown"), [
    ("a<svg><title>no</title><defs><text>no</text></defs><g><path d='x'/><text x=1>b<tspan dy=1>c</tspan></text><text display=none>no</text><text><![CDATA[d>e]]></text></g></svg>f", "a b c d>e f"),
    ("<svg>" + "<path/>" * 300 + "</svg><p>a</p>b", "a\n\nb"), ("<svg><p>a", "a"), ("<svg><foreignObject><p>a</p></foreignObject></svg>b", "a\n\nb"),
    ("a <math><semantics><mrow><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation></semantics></math> b", "a x=1 2 b"),
    ("a<select><option>no<option selected>yes<option>no</select>b", "a yes b"), ("<select><option disabled>no<optgroup label=no><option label=yes>no</select>", "yes"), ("<select multiple><optgroup label=g><option>a<option>b</select>", "g\na\nb"), ("a<select></select>b", "ab"),
])
def test_html_shows_svg_math_and_select(html, shown):
    assert html_text.render(html)[0] == shown


def test_html_keeps_visible_words(spark, small):
    """Against a flat reading by the standard library's parser."""
    from html.parser import HTMLParser

    class Flat(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        flat = Flat()
        flat.feed(r.html)
        flat.close()
        assert [w for w in got[r.page_id].split() if w != "-"] == [w for w in "".join(flat.out).split() if w != "-"]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (None, "<p>x", "c")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract_text(pages).collect()), key=str) == [(1, "", 0, 0, 0, 0), (1, "", 0, 0, 0, 0), (None, "x", 1, 1, 0, 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0
