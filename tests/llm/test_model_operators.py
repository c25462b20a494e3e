"""Sampling, search, classifiers, near-duplicates and the pipeline against plain versions of themselves."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from statuta.llm import language, nearest, quality, segmentations, simhash
from statuta.llm.queries import PASS, held_out, queries
from statuta.llm.text import words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LARGER = "/root/testdata/sf0.01"


def ways(model, text: str) -> dict[tuple, float]:
    s, out = segmentations.SPACE + text.replace(" ", segmentations.SPACE), {}

    def go(i, ids, lp):
        if i == len(s):
            out[tuple(ids)] = lp
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in model.weight:
                go(j, [*ids, model.weight[s[i:j]][0]], lp + model.weight[s[i:j]][1])

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


def test_samples_follow_the_lattice():
    model, n = segmentations.lattice(PIECES), 4000
    every = ways(model, "the cats")
    found = model.samples(["the cats"] * n, np.arange(n), 3)
    for sample in found[:300]:
        assert len({tuple(x[0].tolist()) for x in sample}) == 3
        assert [x[2] for x in sample] == sorted((x[2] for x in sample), reverse=True)
        for ids, lp, _, q in sample:
            assert abs(lp - every[tuple(ids.tolist())]) < 1e-9 and 0 < q <= 1
            assert model.decode(ids.tolist()) == "the cats"
    second = Counter((tuple(a[0].tolist()), tuple(b[0].tolist())) for a, b, _ in found)
    top = sorted(every, key=every.get)[-3:]
    p = {k: math.exp(v) for k, v in every.items()}
    for a in top:
        for b in top:
            if a != b:
                assert abs(second[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.04
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in s) for s in found]) - 1) < 0.02


def test_all_segmentations_come_if_there_are_few():
    model = segmentations.lattice(PIECES)
    every = ways(model, "cat")
    found = model.samples(["cat"], np.array([5]), 100)[0]
    assert {tuple(x[0].tolist()) for x in found} == set(every) and all(x[3] == 1.0 for x in found)


def test_samples_do_not_depend_on_the_batch():
    model = segmentations.lattice(PIECES)
    texts = ["one two three", None, "", "x" * 50, "a\n漢▁b  c"]
    together = model.samples(texts, np.arange(5), 4)
    for i, t in enumerate(texts):
        alone = model.samples([t], np.array([i]), 4)[0]
        assert [(x[0].tolist(), round(x[2], 6), round(x[3], 6)) for x in alone] == [(x[0].tolist(), round(x[2], 6), round(x[3], 6)) for x in together[i]]


def test_pieces_weigh_by_the_models_scores():
    assert segmentations.piece_weights([-2.5, -3.25, -3.5, -9.0]) == [-2.5, -3.25, -3.5, -9.0]
    ranked = segmentations.piece_weights([0.0, -1.0, -2.0, -3.0], 1.0)
    assert np.allclose(np.exp(ranked).sum(), 1.0) and np.allclose(ranked[0] - ranked[2], np.log(2.0))
    dealt = segmentations.lattice(PIECES).weight
    assert np.allclose(np.exp([w for _, w in dealt.values()]).sum(), 1.0) and [i for i, _ in sorted(dealt.values(), key=lambda x: -x[1])] == sorted(i for i, _ in dealt.values())


def test_prefix_tables_of_any_size_and_with_equal_hashes(monkeypatch):
    pieces = [(a + b + c, i, -float(i)) for i, (a, b, c) in enumerate(itertools.product("abcdefghij", repeat=3))]
    text = np.frombuffer("abcjihgab".encode("utf-32-le"), "<u4")
    find = lambda t: [(at.tolist(), n, ids.tolist()) for at, n, ids, _ in t.matches(text, np.full(len(text), len(text)))]
    whole = find(segmentations.PrefixTable(pieces))
    assert find(segmentations.PrefixTable(pieces, bits=2)) == whole  # a table that is too small grows
    plain = segmentations.PrefixTable._hashes
    calls = []

    def equal_at_first(self, by_length, begin):
        calls.append(begin)
        return plain(self, by_length, begin) if begin else np.zeros(sum(map(len, by_length.values())), np.uint64)

    monkeypatch.setattr(segmentations.PrefixTable, "_hashes", equal_at_first)
    assert find(segmentations.PrefixTable(pieces)) == whole and calls == [0, 1]


def test_decoding_is_the_librarys():
    from sentencepiece import SentencePieceProcessor

    library, model = SentencePieceProcessor(model_file=PIECES), segmentations.lattice(PIECES)
    for n, text in enumerate(["the cats sat", " two  spaces", "a\n漢 é 😀", "x" * 40, "don't, stop.", "tab\tend "]):
        for ids, *_ in model.samples([text], np.array([n]), 5)[0]:
            assert model.decode(ids.tolist()) == library.decode(ids.tolist()) == text
            assert model.spellings(ids, np.array([len(ids)]))[0].decode() == " " + text


def test_sampling_rows(spark):
    docs = spark.createDataFrame([(1, "hello there", 1), (1, "hello there", 1), (2, None, 1), (None, "", 1), (3, "long " * 5000, 1)], "doc_id long, text string, ids int")
    got = segmentations.sample_segmentations(docs, PIECES, 2)
    assert got.count() == 8 and got.where("not round_trip").count() == 0
    assert got.where("doc_id = 1").select("ids", "perturbed").distinct().count() == 2
    assert segmentations.sample_segmentations(docs.limit(0), PIECES, 2).count() == 0


def exact(ids, v, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = (v * v[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest_recall(spark):
    vectors = spark.read.parquet(f"{LARGER}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in vectors.collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = exact(ids, v, 20)
    got: dict[int, list] = {}
    for r in nearest.search(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all(len(x) == 20 for x in got.values()) and set(got) == set(want)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_nearest_recall_where_a_share_is_verified(spark):
    """Shards of over a thousand rows, of which a share is verified."""
    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 64))
    v = centres[r.integers(0, 40, 18_000)] + 0.6 * r.standard_normal((18_000, 64))
    ids = np.arange(1, 18_001)
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": v.tolist()}))
    asked = ids[ids % 600 == 0]
    got: dict[int, set] = {}
    for x in nearest.search(vectors, vectors.where(F.col("vec_id") % 600 == 0)).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = []
    for q in asked.tolist():
        s = v @ v[q - 1]
        s[q - 1] = -np.inf
        hits.append(len(got[q] & set((np.argsort(-s)[:20] + 1).tolist())) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("shards", [1, 2, 3, 16])
def test_nearest_recall_and_work_in_shards_of_any_size(spark, shards):
    """The given vectors, which have no structure: at least 0.9 of the neighbours, for less than a scan's work in larger shards."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in vectors.collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want, dealt, found = exact(ids, v, 20), np.random.default_rng(3).permutation(len(ids)) % shards, {}
    asked = np.flatnonzero(ids % 20 == 0)
    increments = verified = 0
    for s in range(shards):
        index = nearest.CollisionIndex(ids[dealt == s], v[dealt == s])
        for q, at, score in zip(*index.search(ids[asked], v[asked], 20), strict=True):
            found.setdefault(int(q), []).append((-score, int(index.ids[at])))
        increments, verified = increments + index.increments, verified + index.verified
    recall = np.mean([len({i for _, i in sorted(found[q])[:20]} & {i for i, _ in want[q]}) / 20 for q in want])
    pairs = len(ids) * len(asked)
    assert recall >= 0.93 and increments / pairs < v.shape[1] / 3
    if shards <= 3:
        assert increments / pairs + v.shape[1] * verified / pairs < 0.65 * v.shape[1]


def test_needed_collisions_hold_for_any_data():
    """A vector of known similarity reaches the count as often as promised, wherever the data lies."""
    r, dim, short = np.random.default_rng(8), 40, 0
    for trial in range(300):
        q, t = r.standard_normal((2, dim)) * ([1.0] * 3 + [0.05] * (dim - 3))  # in a narrow subspace
        q /= np.linalg.norm(q)
        t -= (t @ q) * q
        o = 0.6 * q + 0.8 * t / np.linalg.norm(t)
        axes = nearest.directions(dim, 512, seed=trial)
        centres = axes @ q
        used = np.argsort(-np.abs(centres))[:32]
        count = (np.abs(axes[used] @ o - centres[used]) <= 0.2).sum()
        short += count < nearest.needed_collisions(centres[used], 0.2, float(o @ q), dim, 0.1)
    assert short / 300 <= 0.14


def test_many_equal_vectors(spark):
    same = [float(x) for x in range(1, 9)]
    rows = [(i, same) for i in range(3000)] + [(5000 + i, [float((i * j) % 7 - 3) for j in range(1, 9)]) for i in range(1, 50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(vectors, vectors.where("vec_id = 1000"), 20, least_shards=1).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20)) and all(r.score == 204.0 for r in got)


def test_nearest_edges(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(0, same), (5, same), (3, same), (3, same), (20, [0.5, 0.0, 9.0]), (7, None), (8, [0.0, 0.0, 0.0]), (9, [1.0, float("nan"), 1.0]), (10, [1.0, None, 1.0]), (11, [float("inf"), 1.0, 1.0]), (40, [1.0, 1.0]), (None, same), (60, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in nearest.search(vectors, vectors.where("vec_id % 20 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 5.0), (0, 2, 5, 5.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert nearest.search(vectors.limit(0), vectors, 2).count() == 0 and nearest.search(vectors, vectors.limit(0), 2).count() == 0


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit_quality(docs.where(~held_out()), labels.where(~held_out()))
    judged = quality.rate(docs, model, ["doc_id"]).join(labels, "doc_id").where(held_out()).collect()
    right = [(r.score >= PASS) == (r.quality == 1) for r in judged]
    assert len(right) > 50 and np.mean(right) >= 0.9
    # every judged text scores as the model scores its own features
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in judged[:20]:
        assert abs(r.score - model.score(quality.features(text[r.doc_id].encode()))) < 1e-9


def test_repeated_rows_and_lost_labels_leave_the_sample_alone(spark):
    """Rows that repeat an id, and labels without a document, take no place of others, whatever the bounds."""
    r = np.random.default_rng(2)
    good, bad = "a quiet evening by the river with old friends and bread", "buy now $$$ click here !!! free win"
    base = [(i, " ".join(r.permutation((good if i % 2 else bad).split()))) for i in range(120)]
    docs = spark.createDataFrame(base, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    want = quality.fit_quality(docs, labels, most_rows=40, most_indicators=4000)
    noisy = docs.unionByName(spark.createDataFrame([(i, t + " zzz") for i, t in base for _ in range(20)] + [(i, None) for i, _ in base], "doc_id long, text string"))
    lost = labels.unionByName(spark.createDataFrame([(10_000 + i, 1) for i in range(500)], "doc_id long, quality int"))
    got = quality.fit_quality(noisy, lost, most_rows=40, most_indicators=4000)
    assert np.array_equal(got.weight, want.weight) and (got.bias, got.slope, got.offset) == (want.bias, want.slope, want.offset)


def plain_features(text: bytes, bits: int) -> set[int]:
    m32, mult, out = (1 << 32) - 1, int(quality._mult), set()

    def single(h: int) -> None:
        out.add((h * mult & m32) >> (32 - bits))

    for n in (3, 4):
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h * 0x01000193 & m32) ^ c
            single(h)
    hashes = []
    for w in text.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" "):
        if w:
            total = 0
            for k, c in enumerate(w):
                x = (c + 1) * (2 * k + 1) * mult & m32
                total = (total + (x ^ (x >> 15))) & m32
            hashes.append(total)
    for h in hashes:
        single(h ^ 0x5BD1E995)
    for a, b in zip(hashes, hashes[1:]):
        single((a * 31 + b) & m32)
    same = [int(a == b) for a, b in zip(hashes, hashes[1:])]
    for n in (1, 2, 3):
        for i in range(len(same) - n + 1):
            h = 77 + n
            for x in same[i : i + n]:
                h = (h * 2 + x) & m32
            single(h * mult & m32)
    return out


def test_quality_against_a_plain_version(spark):
    """Features as sets, ratios as dict counts, and the hinge loss by projected gradient over all dual variables at once."""
    r, bits = np.random.default_rng(2), 12
    good = [" ".join(r.choice("the cat sat on a mat and saw it".split(), 12)) for _ in range(20)]
    bad = [" ".join(np.repeat(r.choice("buy now!! CLICK $$$ the".split(), 5), 2)) for _ in range(20)]
    texts, label = [*good, *bad], np.array([1] * 20 + [0] * 20)
    index = [quality.features(t.encode(), bits) for t in texts]
    assert [set(i.tolist()) for i in index] == [plain_features(t.encode(), bits) for t in texts]
    counts = [Counter(), Counter()]
    for i, y in zip(index, label, strict=True):
        counts[y].update(i.tolist())
    total = [sum(c.values()) + (1 << bits) for c in counts]
    model = quality.fit(index, label, bits)
    for b in range(1 << bits):
        assert abs(model.ratio[b] - (math.log((counts[1][b] + 1) / total[1]) - math.log((counts[0][b] + 1) / total[0]))) < 1e-9
    x = np.zeros((40, (1 << bits) + 1))
    for n, i in enumerate(index):
        x[n, i] = model.ratio[i] / np.linalg.norm(model.ratio[i])
    x[:, -1] = 1
    sign = np.where(label > 0, 1.0, -1.0)
    q = (x @ x.T) * np.outer(sign, sign)
    alpha = np.zeros(40)
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, 1)
    want = x.T @ (alpha * sign)
    got = quality.dual_coordinate_descent(index, [x[n, i] for n, i in enumerate(index)], sign, 1 << bits, epochs=3000)
    loss = [0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum() for w in (want, got)]
    assert abs(loss[0] - loss[1]) < 1e-2 * loss[0]
    margins = [model.margin(i) for i in index]
    assert min(margins[:20]) > max(margins[20:])


def test_quality_of_very_long_texts_and_bounded_fits(spark):
    docs = spark.createDataFrame([(i, ("good calm prose " if i % 2 else "BAD!! ") * (60_000 if i < 2 else 40)) for i in range(24)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    few = quality.fit_quality(docs, labels, most_indicators=200)
    assert few.weight.any()
    for model in (quality.fit_quality(docs, labels), few):
        score = {r.doc_id: r.score for r in quality.rate(docs, model).collect()}
        assert min(score[i] for i in range(1, 24, 2)) > max(score[i] for i in range(0, 24, 2))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "text", "c"), (3, "good text", "c"), (4, "BAD!! BAD!!", "c"), (4, "BAD!! BAD!!", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (9, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.rate(docs, model, ["doc_id"]).collect()}
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got.values()) and got[3].score > got[4].score and got[1].score == got[2].score
    blank = quality.fit_quality(docs.limit(0), labels)
    assert {r.score for r in quality.rate(docs, blank, ["doc_id"]).collect()} == {0.5}
    assert quality.rate(docs.limit(0), model).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = language.fit_language(docs.where(~held_out()))
    got = language.identify(docs, model, ["doc_id", "lang"]).where(held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97


def plain_language(rows: list[tuple[str, str]], text: str, buckets: int = 1 << 15) -> tuple[str, float]:
    """Multinomial naive Bayes in dicts."""

    def grams(t: str) -> list[int]:
        out, c = [], [ord(x) for x in t.lower()]
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = n
                for x in c[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
                out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
        return out

    counts: dict[str, Counter] = {}
    for t, lang in rows:
        counts.setdefault(lang, Counter()).update(grams(t))
    total = {}
    for lang, c in counts.items():
        n = sum(c.values()) + 0.1 * buckets
        total[lang] = math.log(sum(x == lang for _, x in rows) / len(rows)) + sum(math.log((c[g] + 0.1) / n) for g in grams(text))
    best = min(total, key=lambda k: (-total[k], k))
    return best, 1 / sum(math.exp(x - total[best]) for x in total.values())


def test_language_against_a_plain_version(spark):
    rows = [("the cat sat", "en"), ("a dog and the fox", "en"), ("le chat est là", "fr"), ("un chien", "fr"), ("der Hund läuft", "de")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit_language(docs)
    texts = ["the dog", "LE CHIEN", "Hund", "x", "là là", "fox " * 3]
    for t, name, score in zip(texts, *model.score(texts), strict=True):
        want = plain_language(rows, t)
        assert name == want[0] and abs(score - want[1]) < 1e-3


def test_hundreds_of_languages_and_very_long_texts(spark):
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x6E00 + i)} " * 3, f"l{i:03}") for i in range(600)], "doc_id long, text string, lang string")
    model = language.fit_language(docs)
    assert len(model.languages) == 600 and {r.doc_id for r in language.identify(docs, model).where("lang <> lang_pred").collect()} == set()
    long = spark.createDataFrame([(1, docs.first().text * 100_000)], "doc_id long, text string")
    assert language.identify(long, model).first().lang_pred == docs.first().lang


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "abc abc", "xx", 1), (2, "ñandú ñu", "yy", 1), (3, None, "xx", 1), (4, "123 !?", None, 1), (5, "", "yy", 1), (None, "abc", None, 1)], "doc_id long, text string, lang string, score int")
    model = language.fit_language(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "xx", 2: "yy", 3: "und", 4: "und", 5: "und", None: "xx"} and got[3][1] == 0
    nothing = language.fit_language(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def brute_components(rows: list[tuple[int, int]], most: int = 3) -> dict[int, int]:
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: low[root(i)] for i, (d, _) in enumerate(rows)}


def test_golay_keys_find_every_near_pair():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 4000, dtype=np.int64)
    flips = np.zeros(4000, np.int64)
    for _ in range(3):
        flips |= np.int64(1) << r.integers(0, 63, 4000)
    at, key, role = simhash.golay_keys(a)
    at_b, key_b, role_b = simhash.golay_keys(a ^ flips)
    stored = {(int(i), int(k)) for i, k, x in zip(at_b, key_b, role_b, strict=True) if x == 0}
    found = {int(i) for i, k, x in zip(at, key, role, strict=True) if x == 1 and (int(i), int(k)) in stored}
    assert len(found) == 4000


@pytest.mark.parametrize("block", [2048, 3])
def test_links_against_brute_force(spark, block):
    r = np.random.default_rng(3)
    base = r.integers(-(2**63), 2**63, 40, dtype=np.int64)
    fps = {int(x) for x in base}
    for x in base[:10]:
        y = x
        for _ in range(25):
            y = np.int64(y) ^ (np.int64(1) << np.int64(r.integers(0, 63)))
            fps.add(int(y))
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    from statuta.operators.components import connected_components

    got = {x.node: x.component for x in connected_components(simhash.golay_links(nodes, block=block)).collect()}
    want = brute_components([(i, x & (2**64 - 1)) for i, x in rows])
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_near_duplicates_against_brute_force(spark):
    texts = ["the quick brown fox jumps over the lazy dog again and again " * 5, "THE quick brown fox jumps over the lazy dog again and again " * 5, "the quick brown fox jumps over the lazy dog again and again " * 5 + "x", None, "", " \t", "one", "one two", "One\x0btwo", "é À", "a b c d"]
    docs = spark.createDataFrame([(50 - i, t, "c") for i, t in enumerate(texts)] + [(50, texts[0], "c"), (None, "one", "c"), (None, "nothing else", "c")], "doc_id long, text string, fp string")

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    want = brute_components([r for r in rows if r[0] is not None])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, f"{x:016x}") for d, x in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.component_id for r in got if r.doc_id is None} == {want[44], None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    long = "many words in a row make a long text " * 60_000
    pair = spark.createDataFrame([(1, long), (2, long + "end"), (3, "else")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(pair).collect()} == {1: 1, 2: 1, 3: 3}


def test_pipeline_stages_against_plain_versions(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontaminate", "encode"]
    items = [(r.item_id, words((r.text or "").encode())) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, w in items for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(x) for x in windows}
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, small)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r.text for r in before.collect()}
        if name == "encode":
            model = segmentations.lattice(PIECES)
            for d, text in rows.items():
                want = model.samples([text], np.array([d]), 2)[0]
                got = after.where(F.col("doc_id") == d).orderBy("sample").collect() if d % 10 == 0 else []
                assert not got or [(r.ids, round(r.perturbed, 6)) for r in got] == [(x[0].tolist(), round(x[2], 6)) for x in want]
            assert after.select("doc_id").distinct().count() == len(rows) and after.where("not round_trip").count() == 0
            break
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "quality":
            assert set(kept) == {r.doc_id for r in queries()["op4_quality"](spark, small).where("predicted = 1").collect()}
        elif name == "language":
            assert set(kept) == {d for d, t in rows.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert set(kept) == {r.doc_id for r in simhash.near_duplicates(before).where("doc_id = component_id").collect()}
        else:
            for d, text in rows.items():
                w, hit = words((text or "").encode()), set()
                for i in range(len(w)):
                    for n in sizes:
                        if tuple(w[i : i + n]) in windows:
                            hit.update(range(i, i + n))
                if 2 * len(hit) > len(w):
                    assert d not in kept
                else:
                    assert words((kept[d] or "").encode()) == [x for i, x in enumerate(w) if i not in hit]
            assert any(kept.get(d) != t for d, t in rows.items())
        before = after


def test_pipeline_takes_odd_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30).withColumn("_score", F.lit("c"))
    odd = spark.createDataFrame([(None, None, None, None, None, "c"), (1, "", "en", "s", 0, "c"), (1, "", "en", "s", 0, "c"), (2, "a very long text of many words " * 50_000, "en", "s", 0, "c")], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.unionByName(odd), small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
