"""Secrets, repair of conversations and periodic runs against plain versions of themselves."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from statuta.llm import conversation_repair, periodic_runs, queries, secrets

R = random.Random(7)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PROSE = "the quick brown fox jumps over the lazy dog while responsibilities and misunderstandings accumulate in every neighbourhood. "


def key(n: int) -> str:
    return "".join(R.choice(ALPHABET) for _ in range(n))


# secrets


def plain_base(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns straight from their wording, over characters."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", *m.span()) for m in re.finditer(assign, text, re.ASCII | re.IGNORECASE) if len(m.group(2)) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def odd_secrets(n: int) -> list[str]:
    parts = ["token", "TOKEN", "Api_Key", "apikey", "paſſword", "password", "secret", " = ", ": ", "=", '"', "'", " ", "\n", "é", "漢", "AKIA", "0123456789abcdef", "DEADBEEF", "abcdef", "AAAAAAAAAAAAAA", "x", "+/_.=-", "ÀÖ", "\x00", "K", "s"]
    return ["".join(R.choice(parts) for _ in range(R.randint(0, 40))) for _ in range(n)]


def test_secret_patterns_match_plain_reading():
    novelty = secrets.Novelty()
    for text in [*odd_secrets(3000), "", "password=" + "a" * 11, "password=" + "a" * 12, "AKIA" + "A" * 13, "AKIA" + "A" * 14, "token = token = abcdefghijklmnop"]:
        assert [s[:3] for s in secrets.spans(text.encode(), novelty) if s[0] != "novel"] == plain_base(text)


def test_new_strings_are_told_from_names():
    novelty = secrets.Novelty()
    new = lambda text: [text[a:b] for kind, a, b, _ in secrets.spans(text.encode(), novelty) if kind == "novel"]
    for n, wrap in itertools.product((24, 32, 40, 64), ("Authorization: Bearer {}", "the access key\nis {} é", "secret -> {}", "export CLIENT_KEY {}; " + PROSE, PROSE + "passphrase {}")):
        for _ in range(5):
            it = key(n)
            assert new(PROSE * 3 + wrap.format(it) + " " + PROSE * 3) == [it]
            assert new(PROSE * 3 + wrap.format(it) + " token " + it + " ") == [it, it]  # repeated nearby it's no less new
            assert new(PROSE * 3 + f"the parcel number was {it}. " + PROSE) == []  # not in a sensitive place
    for name in ("responsibilities", "misunderstandings", "your_api_key_here", "session_validate_request_handler", "com.example.user.account.Manager", "aaaaaaaaaaaaaaaaaaaaaaaa", "xxxxxxxx-xxxx-xxxx-xxxx"):
        assert new(PROSE * 3 + f"the token is {name} and " + PROSE) == []
    blob = key(50_000)
    assert new("secret " + blob + " end") == [blob]


def test_secrets_over_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é token = 'abcdefabcdefabcdef0123'"), (3, "é token = 'abcdefabcdefabcdef0123'"), (None, "AKIA" + "Z" * 16), (4, "x" * 3_000_000 + " password: hunter2hunter2"), *[(100 + i, t) for i, t in enumerate(odd_secrets(80))]]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, found string, n_hex int")
    got = sorted(map(tuple, secrets.digest(secrets.find_secrets(docs)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        found = plain_base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.append((doc_id, *(sum(k == kind for k, _, _ in found) for kind in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()))
    assert [(*g[:4], g[5]) for g in got] == sorted(want, key=str)
    for g in got:  # spans are in order and hold the base ones
        spans = [(int(a), ("assign", "access", "hex", "novel").index(k)) for k, a, _ in (s.split(":") for s in g[6].split(",") if s)]
        assert spans == sorted(spans) and len(spans) == g[1] + g[2] + g[3] + g[4]
    assert secrets.digest(secrets.find_secrets(docs.limit(0))).count() == 0


# conversations


def plain_repairs(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """The least (cost, audit) by trying all edits, with one insertion more than the grammar could need between rows."""
    legal = re.compile("(s?(ua)+)?")
    best = None

    def go(i: int, roles: str, audit: str, cost: int, inserted: int) -> None:
        nonlocal best
        if best and cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if i == len(rows):
            if legal.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
        else:
            role, fault = rows[i]
            more = int(fault == 3)
            if fault not in (1, 2):
                go(i + 1, roles + role[:1] if role else "?", audit + "K", cost + more, 0)
                for r in "ua":
                    go(i + 1, roles + r, audit + "R", cost + 2 + more, 0)
            go(i + 1, roles, audit + "D", cost + 3, 0)
        if inserted < 4:
            for r in "ua":
                go(i, roles + r, audit + "I", cost + 2, inserted + 1)

    go(0, "", "", 0, 0)
    return best


def test_cheapest_edits_match_enumeration():
    machine = conversation_repair.Composition()
    for _ in range(400):
        rows = [(R.choice(["user", "assistant", "system", "tool", "", "u", " "]), R.choice([0, 0, 0, 1, 2, 3])) for _ in range(R.randint(0, 5))]
        cost, steps = machine.repair([conversation_repair.symbol(r[:1], f) for r, f in rows])
        assert (cost, "".join(s.labels for s in steps)) == plain_repairs(rows), rows


def test_other_grammars_and_costs():
    pairs = conversation_repair.Acceptor(({"q": 1}, {"r": 0}), frozenset({0}), ("query", "reply"))
    cheap = conversation_repair.Composition(pairs, conversation_repair.Costs(rerole=9, delete=1, insert=1))
    symbols = [conversation_repair.symbol(c, 0) for c in "qqr"]
    assert cheap.repair(symbols) == (1, cheap.repair(symbols)[1]) and "".join(s.labels for s in cheap.repair(symbols)[1]) == "DKK"
    closed = conversation_repair.Composition(conversation_repair.Acceptor(({},), frozenset(), ()))
    with pytest.raises(ValueError, match="no repair"):
        closed.repair([])


@pytest.fixture(scope="module")
def odd_conversations(tmp_path_factory) -> str:
    roles = ["user", "assistant", "system", "tool", None, "", "u", "Assistant", "user", "assistant"]
    texts = ["Hi.", "Hello there", "", None, " ", "\t\n", "ok?", "x!  ", "x!\n\n", "y. z", " ", "same.", "same.", "Ünï.", "."]
    rows = [(c, R.choice([None, 0, 1, 2, 3, 4, 5, 7, 9]), R.choice(roles), R.choice(texts)) for c in [None, *range(-3, 150)] for _ in range(R.randint(1, 9))]
    rows += [(5000, t, R.choice(roles[:3]), f"{t}." if t % 2 else "a") for t in range(2000)]
    path = f"{tmp_path_factory.mktemp('conv')}/conversations.parquet"
    pq.write_table(pa.table([pa.array([x[i] for x in rows]) for i in range(4)], ["conv_id", "turn", "role", "text"]).append_column("cost", pa.array(["clash"] * len(rows))), path)
    return path


def test_repair_matches_sql_on_odd_rows(spark, odd_conversations, small):
    for path in (odd_conversations, f"{small}/conversations.parquet"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        want = con.sql(conversation_repair.ORACLE)
        got = conversation_repair.report(conversation_repair.damaged(spark.read.parquet(path)), present_col="present")
        assert got.columns == want.columns and set(map(tuple, got.collect())) == set(want.fetchall())


def test_repaired_rows_and_report_agree(spark, odd_conversations, monkeypatch):
    monkeypatch.setattr(conversation_repair.Texts.__init__, "__defaults__", (64,))  # texts wait in files
    rows = conversation_repair.damaged(spark.read.parquet(odd_conversations))
    told = {r.conv_id: r for r in conversation_repair.report(rows, present_col="present").collect()}
    found: dict = {}
    for r in conversation_repair.repaired(rows, present_col="present").orderBy("turn").collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv_id, r in told.items():
        mine = found.get(conv_id, [])
        assert [m.turn for m in mine] == list(range(len(mine))) and "".join(m.edit for m in mine) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in mine).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[:1] for m in mine))
    assert conversation_repair.report(rows.limit(0)).count() == 0 and conversation_repair.repaired(rows.limit(0)).count() == 0


def test_long_texts_wait_in_a_file():
    texts = conversation_repair.Texts(100)
    pairs = [("rolé", "x" * R.randint(0, 90) + "é") for _ in range(50)]
    for p in pairs:
        texts.add(*p)
    assert texts.file and list(texts) == pairs == list(texts)
    texts.close()


# periodic runs


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            if j > i and end - start >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(start, end - r)) for r in range(1, q)):
                out.append((start, end - start, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(most: int) -> list[int]:
    w: list[int] = []
    n = R.randint(0, most)
    while len(w) < n:
        unit = [R.randint(0, R.choice([1, 2, 5, 50])) for _ in range(R.randint(1, R.choice([3, 10, 40])))]
        w += (unit * 8)[: R.randint(1, len(unit) * R.choice([1, 8]))]
    return w


def test_runs_match_plain_search():
    for _ in range(3000):
        w = odd_words(150)
        assert periodic_runs.find_runs(np.array(w, np.int32)) == plain_runs(w)
    for w in (odd_words(1500) for _ in range(10)):
        assert periodic_runs.find_runs(np.array(w, np.int32)) == plain_runs(w)


def test_other_limits_of_runs():
    for _ in range(300):
        w = odd_words(100)
        want = [r for r in plain_runs(w) if r[1] >= max(9, 5 * r[2])]
        assert periodic_runs.find_runs(np.array(w, np.int32), 5, 9) == want
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.find_runs(np.zeros(9, np.int32), 2)


def plain_digest(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = s, length, q
    hashed = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *hashed)


def test_run_digests_match_plain_version(spark):
    rows = [(i, " ".join(f"w{x}" for x in odd_words(80))) for i in range(-20, 250)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a a b"), (7, "É x  É x\tÉ x É x\x0bÉ x É x"), (7, "a " * 50), (9, "x y " * 30_000), (41, "one")]
    docs = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, runs string, h int")
    run = lambda d: periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(d)))
    long = [r for r in rows if len(r[1] or "") < 10_000]
    got = sorted(map(tuple, run(docs).collect()), key=str)
    assert [g for g in got if g[0] != 9 or g[1] != 1 or g[3] < 10_000] == sorted((plain_digest(*r) for r in long), key=str)
    assert [g[1:6] for g in got if g[0] == 9 and g[3] and g[3] > 10_000] == [(1, 0, 60_000, 2, 30_000_000)]
    assert run(docs.limit(0)).count() == 0


def test_registered_queries_of_structure(spark, small):
    found = queries.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    short = {i for i, t in docs.items() if len((t or "").split()) < 400}
    got = {r.doc_id: tuple(r) for r in found["op13_periodic_runs"](spark, small).collect()}
    assert set(got) == set(docs) and all(got[i] == plain_digest(i, docs[i]) for i in short)
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in found["op11_secrets"](spark, small).collect()} == {i: tuple(sum(k == kind for k, _, _ in plain_base(t or "")) for kind in ("assign", "access", "hex")) for i, t in docs.items()}
