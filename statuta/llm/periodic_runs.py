"""Runs of words that repeat with a period, found by matching aligned blocks.

A run of period q that is at least four periods long holds, for the largest power of two B with B <= q, a block of B words that starts
at a multiple of B and occurs again q words later.  So for every B the aligned blocks of a document are searched
across the document by an Aho-Corasick automaton over word numbers; occurrences at distances d with B <= d < 2B are
seeds, and a seed is extended to both sides word by word as long as words d apart are equal.

Exact pruning: within such a run each word of the block recurs within less than 2B words, so blocks with a word that doesn't are not searched;
nor are blocks whose surroundings of 3B words lie in a run already known of a period of at most B, where any seed would
repeat that run with a multiple of its period.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import as_bytes, id_and_text, slices

#: Fewest periods (four at least, which the block argument needs) and fewest words of a run.
PERIODS, WORDS = 4, 6


class Run(NamedTuple):
    start: int
    length: int
    period: int


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def recurrence(w: np.ndarray) -> np.ndarray:
    """For each place how many words later its word comes again; the length of the text if it doesn't."""
    order = np.argsort(w, kind="stable")
    after = np.full(len(w), len(w), np.int32)
    same = w[order[1:]] == w[order[:-1]]
    after[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return after


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two sequences agree."""
    n, at, width = min(len(a), len(b)), 0, 32
    while at < n:
        differ = np.flatnonzero(a[at : min(at + width, n)] != b[at : min(at + width, n)])
        if len(differ):
            return at + int(differ[0])
        at, width = at + width, width * 4
    return n


def extended(w: np.ndarray, j: int, d: int) -> tuple[int, int]:
    """The longest stretch around places j and j + d in which words d apart are equal: start and end (exclusive)."""
    end = j + _agree(w[j : len(w) - d], w[j + d :]) + d
    return j - _agree(w[:j][::-1], w[d : j + d][::-1]), end


def primitive(unit: np.ndarray) -> bool:
    """Whether a unit isn't a shorter one several times over."""
    d, rest, factor = len(unit), len(unit), 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = d // factor
            if np.array_equal(unit[part:], unit[:-part]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _searched(w: np.ndarray, after: np.ndarray, size: int, known: list[Run]) -> np.ndarray:
    """The places of the aligned blocks of this size that can begin a new run."""
    blocks = len(w) // size
    near = np.maximum.reduceat(after[: blocks * size], np.arange(0, blocks * size, size)) < 2 * size
    for r in known:
        if r.period <= size and r.length >= 3 * size:
            near[-(-r.start // size) : max(0, (r.start + r.length - 3 * size) // size + 1)] = False
    return np.flatnonzero(near) * size


def find_runs(w: np.ndarray, periods: int = PERIODS, least: int = WORDS) -> list[Run]:
    """All maximal runs of at least ``periods`` smallest periods and ``least`` words, by start, then period."""
    if periods < 4:
        raise ValueError("runs have four periods at least")
    found: set[Run] = set()
    if len(w) < max(periods, least):
        return []
    after, text, size = recurrence(w), None, 1
    while size * periods <= len(w):
        at = _searched(w, after, size, list(found))
        if len(at):
            text = tuple(w.tolist()) if text is None else text
            automaton, key_of = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
            for j in at.tolist():
                block = text[j : j + size]
                key_of[j] = key = automaton.get(block, j)
                if key == j:
                    automaton.add_word(block, j)
            automaton.make_automaton()
            done: dict[int, int] = {}  # by distance: up to where seeds have been extended
            for last, key in automaton.iter(text):
                here = last - size + 1
                j = (here - size) // size * size
                if key_of.get(j) != key:
                    continue
                d = here - j
                if j < done.get(d, 0):
                    continue
                start, end = extended(w, j, d)
                done[d] = end - d
                if end - start >= max(least, periods * d) and primitive(w[start : start + d]):
                    found.add(Run(start, end - start, d))
        size *= 2
    return sorted(found, key=lambda r: (r.start, r.period))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period."""
    edge = np.zeros(n + 1, np.int32)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, periods: int = PERIODS, least: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period in words, by start, then period), collapsed.

    Words are what stands between ASCII white space; ``period`` is the smallest of the run, and no neighbouring word continues it.  ``collapsed``
    is the text's words joined by single spaces without those that a run repeats: each run keeps its first period.

    Null and empty texts have no words, no runs and an empty collapsed text; a null id is kept; texts are read whole, at any length; repeated
    rows each give their row; other columns are not read; no rows give no rows.  One scan, no shuffle; a task holds some 4 MB of text at a time, or one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, all_runs, collapsed = [], [], []
            for text in as_bytes(batch.column("text")):
                words = text.split() if text else []
                runs = find_runs(numbered(words), periods, least)
                counts.append(len(words))
                all_runs.append([r._asdict() for r in runs])
                collapsed.append(b" ".join(words if not runs else [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]))
            runs = pa.array(all_runs, pa.list_(pa.struct([(f, pa.int64()) for f in Run._fields])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of each row; where crc32 of the id, h, ends in 0, the words from place a = h/10 mod n on repeat the p words from a.

    p = 1 + (n - a) / (3 + h/10 mod 8), without remainders, n being the number of words.  A null id plants nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = rows.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    start = words.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("if(n > 0, (h div 10) % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    repeated = "array_join(concat(slice(w, 1, cast(a as int)), flatten(array_repeat(slice(w, cast(a as int) + 1, cast(p as int)), cast((n - a) div p as int))), slice(w, cast(a as int) + 1, cast((n - a) % p as int))), ' ')"
    return start.select("doc_id", F.when(F.col("n") > 0, F.expr(repeated)).otherwise(F.col("text")).alias("text"))


def best_run(runs: str = "runs") -> Column:
    """The run with most periods, compared exactly; of several the one that starts first, then the shortest period; null without runs."""
    better = "(x, y) -> case when x.period is null or y.length * x.period > x.length * y.period then y else x end"
    return F.expr(f"aggregate({runs}, cast(null as struct<start: long, length: long, period: long>), {better})")


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: doc_id, n_runs, start, length, period and exponent_milli of the run with most periods, runs_sha256, collapsed_sha256."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best_run().alias("best"), hashed(lines).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
