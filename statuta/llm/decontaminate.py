"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton accepts every word sequence that occurs inside an item.  A training text is
streamed through it once, keeping the longest match that ends at each word.  A match of at
least ``window`` words ends an occurrence of a window; a shorter item is one window as a whole.

The items are broadcast only up to ``block_bytes`` of text; more are dealt into blocks of that size, whose
automata scan the texts one job after another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import WORD, as_bytes, id_and_text, slices, text_rows, words
from statuta.runtime import checkpointed, shared_dir

WINDOW = 10
BLOCK_BYTES = 1 << 20
Span = tuple[int, int]


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(item, w) for item, text in items if (w := words(text))]
        for _, w in texts:
            last = 0
            for word in w:
                last = self._extend(last, word)
        n = len(self.link)
        #: For states as long as a window: the state of the match's last ``window`` words.
        self.top = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.top[s] = s if self.length[up] < window else self.top[up]
        self.owners: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, set]]] = {}
        for item, w in texts:
            s = 0
            for i, word in enumerate(w):
                s = self.step[s][word]
                if i + 1 >= window:
                    self.owners.setdefault(self.top[s], set()).add(item)
            if len(w) < window:
                known = self.short.setdefault(s, [])
                for size, who in known:
                    if size == len(w):
                        who.add(item)
                        break
                else:
                    known.append((len(w), {item}))
        self.least = min([window, *(size for known in self.short.values() for size, _ in known)])
        #: The nearest state, this one included, on the way to the root at which short items end.
        self.ends = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            self.ends[s] = s if s in self.short else (self.ends[self.link[s]] if s else -1)

    def _new(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state for p's longest sequence and ``word``, cut off from longer ones if need be."""
        q = self.step[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def scan(self, text_words: list[bytes]) -> tuple[list[Span], set]:
        """The merged word spans [start, end) that windows cover, and the items that own them."""
        step, link, length, least, window = self.step, self.link, self.length, self.least, self.window
        spans: list[Span] = []
        items: set = set()
        s = size = 0
        for i, word in enumerate(text_words):
            t = step[s].get(word)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = step[s].get(word)
                if t is None:
                    size = 0
                    continue
                size = length[s]
            s, size = t, size + 1
            if size >= least:
                if size >= window:
                    spans.append((i + 1 - window, i + 1))
                    # the match may be shorter than its state: its last words belong to the window's state all the same
                    items |= self.owners.get(self.top[s], set())
                e = self.ends[s]
                while e >= 0:
                    for n, who in self.short[e]:
                        if n <= size:
                            spans.append((i + 1 - n, i + 1))
                            items |= who
                    e = self.ends[link[e]] if e else -1
        return merged(spans), items


def merged(spans: list[Span]) -> list[Span]:
    """Overlapping and touching spans joined."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[Span], least_words: int) -> bytes:
    """The text without those word spans that have ``least_words`` words or more."""
    drop = [x for x in spans if x[1] - x[0] >= least_words]
    if not drop:
        return text
    at = [m.span() for m in WORD.finditer(text.lower())]
    kept, last = [], 0
    for a, b in drop:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


FOUND = "array<struct<a:int,b:int>>"


def pieces(text: bytes, window: int, most_bytes: int) -> list[bytes]:
    """A long item's words in pieces that overlap so that each window lies in one of them whole; others as they are."""
    if len(text) <= most_bytes:
        return [text]
    w = words(text)
    if len(w) <= window:
        return [b" ".join(w)]
    out, start, size, last = [], 0, 0, 0
    for i, word in enumerate(w):
        size += len(word) + 1
        if size > most_bytes and i + 1 - start >= window and i >= last:
            out.append(b" ".join(w[start : i + 1]))
            last = i + 1
            start = last - (window - 1)
            size = sum(len(x) + 1 for x in w[start:last])
    if last < len(w):
        out.append(b" ".join(w[start:]))
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The distinct items in blocks of at most about ``block_bytes``, one at a time on the driver.

    Long items are cut into pieces, pieces are dealt by hash to buckets of about an eighth of a block, and buckets are packed
    into blocks by their counted sizes.  More than one block are kept in the shared folder, a folder each.
    """
    spark = benchmark.sparkSession
    most = max(1, block_bytes // 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = pieces(text, window, most)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["item", "text"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    weight = F.octet_length("text") + 64
    total = rows.agg(F.sum(weight)).first()[0] or 0
    if total <= block_bytes:
        yield [(r["item"], bytes(r["text"])) for r in rows.collect()]
        return
    cut_up = rows.distinct().mapInArrow(cut, "item string, text binary")
    kept = checkpointed(cut_up.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(8 * -(-total // block_bytes))).cast("int")))
    block, size, place = 0, 0, []
    for r in kept.groupBy("bucket").agg(F.sum(weight).alias("n")).orderBy("bucket").collect():
        if size and size + r["n"] > block_bytes:
            block, size = block + 1, 0
        size += r["n"]
        place.append((r["bucket"], block))
    folder = f"{shared_dir(spark)}/benchmark-blocks-{uuid.uuid4().hex}"
    kept.join(F.broadcast(spark.createDataFrame(place, "bucket int, block int")), "bucket").select("block", "item", "text").repartition("block").write.partitionBy("block").parquet(folder)
    stored = spark.read.parquet(folder)
    for k in range(block + 1):
        yield [(r["item"], bytes(r["text"])) for r in stored.where(F.col("block") == k).collect()]


def _marked(docs: DataFrame, automaton: Broadcast) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` and ``items`` of one automaton."""
    schema = docs.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.array().cast(FOUND), "items": F.array().cast("array<string>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for batch in slices(batches):
            counts, spans, items = [], [], []
            for text in as_bytes(batch.column("text")):
                w = words(text)
                found, owners = a.scan(w)
                counts.append(len(w))
                spans.append([{"a": x, "b": y} for x, y in found])
                items.append(sorted(x for x in owners if x is not None))
            new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return docs.mapInArrow(run, schema)


def _joined(docs: DataFrame) -> DataFrame:
    """``docs`` with the words counted and the spans of all blocks merged."""
    schema = docs.withColumn("n_words", F.lit(None).cast("long")).schema
    at = docs.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            spans = [[{"a": x, "b": y} for x, y in merged([(x["a"], x["b"]) for x in s or []])] for s in columns[at].to_pylist()]
            columns[at] = pa.array(spans, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(words(t)) for t in as_bytes(batch.column("text"))], pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words long``, ``spans`` (word spans) and ``items array<string>`` (sorted) added.

    ``docs`` needs a ``text`` column; its other columns pass through.  Null and empty texts have no
    words.  An empty benchmark marks nothing; items without an id mark words but aren't named.

    Items of up to ``block_bytes`` take one scan.  More take a scan for each block, one job after another with one automaton
    broadcast at a time; a scan writes only the texts' digests and what it found in them, which is joined to the texts at the end.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, window, block_bytes, item_col, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _marked(docs, spark.sparkContext.broadcast(ItemAutomaton(first, window)))
    keyed = docs.withColumn("text_key", F.md5(F.col("text").cast("binary")))
    folder = f"{shared_dir(spark)}/benchmark-hits-{uuid.uuid4().hex}"
    for block in chain([first, second], blocks):
        automaton = spark.sparkContext.broadcast(ItemAutomaton(block, window))
        _marked(keyed.select("text_key", "text"), automaton).where(F.size("spans") > 0).select("text_key", "spans", "items").dropDuplicates(["text_key"]).write.mode("append").parquet(folder)
        automaton.destroy()
    hits = spark.read.parquet(folder).groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<string>")
    found = _joined(keyed.join(hits, "text_key", "left").withColumn("items", F.coalesce("items", none)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = WINDOW, most_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """``docs`` without the benchmark's passages, same columns.

    Spans of ``least_words`` words or more are cut from the text; a document of whose words spans cover more
    than ``most_coverage`` goes as a whole.  Null and empty texts stay as they are, very long ones are scanned whole, repeated
    rows fare alike, columns may have any name, and no rows give no rows.
    """
    names = docs.columns
    packed = text_rows(docs, F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("rest"), F.col(text_col).cast("string").alias("text"))
    first = list(islice(_blocks(benchmark, window, block_bytes, "item_id", "text"), 2))
    if len(first) == 1:  # one automaton: texts go through Python once
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(first[0], window))

        def scan_and_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                kept, texts = [], []
                for i, text in enumerate(as_bytes(batch.column("text"))):
                    w = words(text)
                    spans, _ = shared.value.scan(w)
                    if sum(b - a for a, b in spans) <= most_coverage * len(w):
                        kept.append(i)
                        texts.append(without_spans(text, spans, least_words) if spans else text)
                yield pa.RecordBatch.from_arrays([batch.column("rest").take(pa.array(kept, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())], ["rest", "text"])

        return _unpacked(packed.mapInArrow(scan_and_cut, packed.schema), names, text_col)
    found = scanned(packed, benchmark, window, block_bytes)
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"])
    kept = found.where(covered <= most_coverage * F.col("n_words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            if pa.compute.any(pa.compute.greater(pa.compute.list_value_length(batch.column("spans")), 0)).as_py():
                each = zip(as_bytes(texts), batch.column("spans").to_pylist(), strict=True)
                texts = pa.array([without_spans(t, [(x["a"], x["b"]) for x in s], least_words) if s else t for t, s in each], pa.binary()).cast(texts.type)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), texts], ["rest", "text"])

    return _unpacked(kept.mapInArrow(cut, packed.schema), names, text_col)


def _unpacked(packed: DataFrame, names: list[str], text_col: str) -> DataFrame:
    return packed.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in names])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits, very long ones are scanned whole, repeated rows each give their row,
    other columns are not read, and no rows give no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    found = scanned(rows, benchmark, window, block_bytes)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"]).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
