"""Repair of conversations' structure by weighted finite-state composition.

Three machines are composed.  The input acceptor is the chain of a conversation's rows; the edit transducer keeps, reroles or
deletes a row and inserts turns, each for a cost; the grammar acceptor reads initials of roles.  A state of the
composition is (row, turns inserted since the last row, grammar state).  Arcs are made when a row of their kind is first met.  More
insertions in a row than the grammar has states would pass one of its states twice and could be
cut out, so their number is bounded by that; rows and insertions only grow along an arc and the composition has a topological order.

Weights are pairs (cost, label string), compared in that order.  Distances are taken from the end, since putting a label before
two strings keeps their order (putting it behind them does not, where one is the start of the other).  A string is held as its first label and
the rank of the rest among the strings of the states it leads to; arcs of the same label lead to the same layer, so ranks compare.
A layer depends only on the kind of its row and on the layer behind it, up to a common cost, so layers are made
once and shared by all conversations.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm.text import text_rows

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Text of one conversation that a task holds; beyond it texts wait in a file of the task.
HELD_BYTES = 16 << 20


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Acceptor(NamedTuple):
    """A deterministic acceptor of initials: arcs by state, final states, and the roles that edits may write."""

    arcs: tuple[dict[str, int], ...]
    final: frozenset[int]
    roles: tuple[str, ...]


#: ``(s?(ua)+)?``: perhaps a system turn, then pairs of user and assistant.
CHAT = Acceptor(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), frozenset({0, 3}), ("user", "assistant"))
FOLLOWS = frozenset({"su", "ua", "au"})


class Symbol(NamedTuple):
    """What the edit transducer reads of a row."""

    initial: str
    must_go: bool
    truncated: bool


@lru_cache(1 << 16)
def symbol(initial: str, fault: int) -> Symbol:
    """One object for each kind of row, so that a long conversation holds references."""
    return Symbol(initial, fault in (BLANK, DUPLICATE), fault == TRUNCATED)


class Arc(NamedTuple):
    label: str
    role: str | None  # what a rerole or an insertion writes
    cost: int
    state: int


class Step(NamedTuple):
    """The best edits from a layer's state up to and with its row: labels, roles written, the grammar state after them."""

    labels: str
    roles: tuple[str | None, ...]
    state: int


class Layer(NamedTuple):
    """Distances to the end from the grammar states before a row, less ``base``; their strings' ranks; the edits that reach them."""

    costs: tuple[float, ...]
    ranks: tuple[int, ...]
    steps: tuple[Step, ...]
    base: int


@dataclass
class Composition:
    """The edit transducer composed with the grammar, to be composed with one chain of rows after another."""

    grammar: Acceptor = CHAT
    costs: Costs = field(default_factory=Costs)
    _arcs: dict = field(default_factory=dict)
    _layers: dict = field(default_factory=dict)

    def consuming(self, symbol: Symbol, state: int) -> list[Arc]:
        """The arcs that read a row in a grammar state."""
        if (symbol, state) not in self._arcs:
            out, more = [Arc(DELETE, None, self.costs.delete, state)], self.costs.truncated * symbol.truncated
            if not symbol.must_go:
                legal = self.grammar.arcs[state]
                if symbol.initial in legal:
                    out.append(Arc(KEEP, None, more, legal[symbol.initial]))
                out += [Arc(REROLE, r, self.costs.rerole + more, legal[r[0]]) for r in self.grammar.roles if r[0] in legal]
            self._arcs[symbol, state] = out
        return self._arcs[symbol, state]

    @cached_property
    def inserting(self) -> list[list[Arc]]:
        return [[Arc(INSERT, r, self.costs.insert, legal[r[0]]) for r in self.grammar.roles if r[0] in legal] for legal in self.grammar.arcs]

    @cached_property
    def end(self) -> Layer:
        """The layer behind the last row: insertions up to a final state."""
        return self._layer(None, None)

    def before(self, symbol: Symbol, after: Layer) -> Layer:
        key = symbol, after.costs, after.ranks
        if key not in self._layers:
            self._layers[key] = self._layer(symbol, after)
        return self._layers[key]

    def _layer(self, symbol: Symbol | None, after: Layer | None) -> Layer:
        states, infinite = range(len(self.grammar.arcs)), float("inf")
        inserted = None  # (cost, rank, step) by grammar state after one insertion more
        for _ in range(len(states) + 1):
            best = []
            for g in states:
                found = []  # (cost, first label, rank of the rest, step)
                if symbol is None:
                    if g in self.grammar.final:
                        found.append((0, "", 0, Step("", (), g)))
                else:
                    found += [(a.cost + after.costs[a.state], a.label, after.ranks[a.state], Step(a.label, (a.role,), a.state)) for a in self.consuming(symbol, g)]
                if inserted is not None:
                    for a in self.inserting[g]:
                        cost, rank, rest = inserted[a.state]
                        if rest is not None:
                            found.append((a.cost + cost, a.label, rank, Step(a.label + rest.labels, (a.role, *rest.roles), rest.state)))
                best.append(min(found, key=lambda x: x[:3], default=(infinite, "", 0, None)))
            order = sorted({x[1:3] for x in best})
            inserted = [(x[0], order.index(x[1:3]), x[3]) for x in best]
        base = min(x[0] for x in inserted)
        if base == infinite:
            raise ValueError("the grammar accepts no repair")
        return Layer(tuple(x[0] - base for x in inserted), tuple(x[1] for x in inserted), tuple(x[2] for x in inserted), base)

    def repair(self, symbols: list[Symbol]) -> tuple[int, list[Step]]:
        """The least cost, and of the edits that have it those of the least label string: a step a row, and one for the end."""
        layers, cost = [self.end], self.end.base
        for s in reversed(symbols):
            layers.append(self.before(s, layers[-1]))
            cost += layers[-1].base
        state, steps, cost = 0, [], cost + layers[-1].costs[0]
        if cost == float("inf"):
            raise ValueError("the grammar accepts no repair")
        for layer in reversed(layers):
            steps.append(layer.steps[state])
            state = steps[-1].state
        return int(cost), steps


class Texts:
    """Roles and texts in the order they came; beyond ``HELD_BYTES`` in a file that goes with the object."""

    def __init__(self, most: int = HELD_BYTES):
        self.held, self.size, self.most, self.file = [], 0, most, None

    def add(self, role: str, text: str) -> None:
        self.held.append((role, text))
        self.size += len(role) + len(text)
        if self.size > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            for pair in self.held:
                for x in pair:
                    raw = x.encode()
                    self.file.write(len(raw).to_bytes(8, "little") + raw)
            self.held, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            self.file.seek(0)
            read = lambda: self.file.read(int.from_bytes(head, "little")).decode()
            while head := self.file.read(8):
                role = read()
                head = self.file.read(8)
                yield role, read()
        yield from self.held

    def close(self) -> None:
        if self.file:
            self.file.close()


class Conversation:
    """One conversation as its rows come by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.texts = conv_id, [], Texts()
        self.turns, self.first, self.last = 0, None, None
        self.faults, self.illegal, self.initial = [0, 0, 0, 0], 0, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in FOLLOWS
        self.initial = role[:1]
        self.symbols.append(symbol(role[:1], fault))
        self.texts.add(role, text)

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns

    def edits(self, steps: list[Step]) -> Iterator[tuple[str, str, str]]:
        """(label, role, text) of each edit in order; of a deletion the role and text that go."""
        for step, row in zip(steps, self._padded(), strict=True):
            for label, role in zip(step.labels, step.roles, strict=True):
                if label == INSERT:
                    yield label, role, ""
                else:
                    yield label, role or row[0], row[1]

    def _padded(self) -> Iterator[tuple[str, str] | None]:
        yield from self.texts
        yield None


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """The conversations of a partition whose rows are sorted."""
    open_: Conversation | None = None
    for batch in batches:
        for conv_id, present, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "role", "text", "fault")), strict=True):
            if open_ is None or open_.conv_id != conv_id:
                if open_:
                    yield open_
                open_ = Conversation(conv_id)
            if present:
                open_.add(turn, role, text, fault)
    if open_:
        yield open_


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults put in by crc32 of ``conv_id:turn`` modulo 20: 0 takes a row out, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes its role user.  Nulls of any column are read as one space (``turn`` itself stays null).

    A row that is taken out stays as a row that isn't ``present``, so that its conversation is known.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    return rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"), (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    """The rows with their faults, one conversation after another in the order of its turns."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present: Column = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    kept = text_rows(rows, F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), present.alias("present"))
    again = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    text = F.col("text")
    fault = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    dealt = kept.repartition("conv_id").withColumn("nth", F.row_number().over(again)).withColumn("fault", fault)
    return dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth")


def report(rows: DataFrame, grammar: Acceptor = CHAT, costs: Costs | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """Per conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The rows of a conversation are taken by turn, nulls first, then by role and text.  A row's first fault counts: blank, duplicate (role
    and text of an earlier row), truncated (its last character that is no space is not one of ``.!?``).  ``audit`` has an initial for each edit
    of the cheapest repair whose role initials the grammar accepts, of several the least in ASCII order; ``repaired_sha256`` is of the repaired
    ``role:text``, joined by newlines.

    Null roles and texts are read as one space; a null id is a conversation of its own; rows that repeat are duplicates; a conversation none of
    whose rows is present gives zeros, an empty audit and the hash of the empty string; other columns are not read; no rows give no rows.

    One shuffle, by conversation.  Rows stream through a task sorted, so of a conversation it holds one symbol a row and 16 MB of text at most: the
    rest waits in a file.  A hash of texts in their order is sequential, so one conversation is one task's work however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out = Composition(grammar, costs or Costs()), []
        for c in _conversations(batches):
            cost, steps = machine.repair(c.symbols)
            digest, first = hashlib.sha256(), True
            for label, role, text in c.edits(steps):
                if label != DELETE:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            c.texts.close()
            out.append((c.conv_id, len(c.symbols), c.gaps, *c.faults[1:], c.illegal, cost, "".join(s.labels for s in steps), digest.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, REPORT)
                out = []
        if out:
            yield _batch(out, REPORT)

    return _ordered(rows, id_col, turn_col, role_col, text_col, present_col).mapInArrow(run, _ddl(REPORT))


def repaired(rows: DataFrame, grammar: Acceptor = CHAT, costs: Costs | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, turn (numbered from 0), role, text, edit (K, R or I), by the edits that ``report`` tells.

    Handles odd rows as ``report`` does; a conversation of which nothing is left gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out, size = Composition(grammar, costs or Costs()), [], 0
        for c in _conversations(batches):
            kept = (e for e in c.edits(machine.repair(c.symbols)[1]) if e[0] != DELETE)
            for turn, (label, role, text) in enumerate(kept):
                out.append((c.conv_id, turn, role, text, label))
                size += len(text)
                if len(out) == 1000 or size > 4 << 20:
                    yield _batch(out, REPAIRED)
                    out, size = [], 0
            c.texts.close()
        if out:
            yield _batch(out, REPAIRED)

    return _ordered(rows, id_col, turn_col, role_col, text_col, present_col).mapInArrow(run, _ddl(REPAIRED))


REPORT = [("conv_id", "long"), *[(c, "long") for c in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", "string"), ("repaired_sha256", "string")]
REPAIRED = [("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"), ("edit", "string")]


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def _batch(rows: list[tuple], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


#: ``report(damaged(conversations))`` in DuckDB SQL: the same least weights by recursion over rows, with whole strings.
ORACLE = """WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)) AS key
  FROM conversations),
hashed AS (SELECT s.*, xor(list_reduce(key, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS damage FROM source s, crc),
rows_ AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM rows_),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS n,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM met),
judged AS (
  SELECT conv_id, turn, role, text, n, substr(role, 1, 1) AS r,
    CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM placed),
convs AS (
  SELECT c.conv_id, count(j.n) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id GROUP BY 1),
-- costs and audits to the end from: the start, behind s, behind u, behind a
ways(conv_id, n, w) AS (
  SELECT conv_id, n_rows, [{'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] FROM convs
  UNION ALL
  SELECT conv_id, n, list_transform([1, 2, 3, 4], lambda g: list_min([y[g], {'c': 2 + y[[3, 3, 4, 3][g]].c, 'a': 'I' || y[[3, 3, 4, 3][g]].a},
      {'c': 4 + y[[4, 4, 3, 4][g]].c, 'a': 'II' || y[[4, 4, 3, 4][g]].a}, {'c': 6 + y[[3, 3, 4, 3][g]].c, 'a': 'III' || y[[3, 3, 4, 3][g]].a}]))
  FROM (
    SELECT v.conv_id, v.n - 1 AS n, list_transform([1, 2, 3, 4], lambda g: list_min(list_filter([
        {'c': 3 + w[g].c, 'a': 'D' || w[g].a},
        {'c': CASE WHEN fault IN ('b', 'd') THEN 99999999 ELSE 2 + (fault = 't')::INT + w[[3, 3, 4, 3][g]].c END, 'a': 'R' || w[[3, 3, 4, 3][g]].a},
        {'c': CASE WHEN fault IN ('b', 'd') OR r <> ['u', 'u', 'a', 'u'][g] THEN 99999999 ELSE (fault = 't')::INT + w[[3, 3, 4, 3][g]].c END, 'a': 'K' || w[[3, 3, 4, 3][g]].a},
        {'c': CASE WHEN fault IN ('b', 'd') OR r <> 's' OR g > 1 THEN 99999999 ELSE (fault = 't')::INT + w[2].c END, 'a': 'K' || w[2].a}], lambda x: x.c < 99999999))) AS y
    FROM ways v JOIN judged j ON v.conv_id IS NOT DISTINCT FROM j.conv_id AND v.n = j.n)),
best AS (SELECT conv_id, w[1].c AS cost, w[1].a AS audit FROM ways WHERE n = 0),
edits AS (
  SELECT conv_id, audit, place, e, sum((e <> 'I')::INT) OVER seen AS n, sum((e <> 'D')::INT) OVER seen AS out
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS place, unnest(string_split(audit, '')) AS e FROM best WHERE audit <> '')
  WINDOW seen AS (PARTITION BY conv_id ORDER BY place)),
written AS (
  SELECT e.conv_id, place, e, out, j.role, CASE e WHEN 'I' THEN '' ELSE j.text END AS text, max((e = 'K' AND out = 1 AND r = 's')::INT) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN judged j ON e.conv_id IS NOT DISTINCT FROM j.conv_id AND e.n = j.n AND e.e <> 'I' WHERE e <> 'D'),
told AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (out - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS whole FROM written GROUP BY 1)
SELECT c.conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM convs c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN told t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
