"""Token-ID files: Parquet with a list column of ids beside small metadata columns.

Rows are dealt by ranges of ``doc_id`` and sorted, so file k holds the ids that follow those of file
k-1.  Row groups and pages have a set size and Spark's Parquet writer adds page indexes, so a read
of a few documents or of the metadata alone touches little.  Ids are dictionary coded (a vocabulary
fits a dictionary page), or delta coded if asked for.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.llm.text import id_and_text, slices
from statuta.runtime import shared_dir

#: Texts of these characters only are cut into pre-tokens here: normalisation leaves them alone but for case.
PLAIN = re.compile(r"[\t\n\r -~À-ÿ]*")
#: The tokenizer's own pre-token pattern, on lower-cased text of those characters (what starts alike keeps its order).
PRE_TOKEN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+".encode("latin-1"))
#: Bytes of Latin-1 lower-cased, white space as a space; and their kinds: letter or digit, space, point or comma, other symbol, not plain.
LOWER = b"".join((" " if c in "\t\n\r" else c.lower() if PLAIN.fullmatch(c) else c).encode("latin-1") for c in map(chr, range(256)))
KIND = bytes(ord("?" if not PLAIN.fullmatch(c) else " " if c.isspace() else "." if c in ".," else "a" if re.fullmatch("[a-zß-öø-ÿ0-9]", c.lower()) else "!") for c in map(chr, range(256)))
WORD_END = "</w>"
# The parts of a tokenizer file that all this holds for; texts of any other file go to the library whole.
NORMAL_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
#: Words kept before the table starts anew, and its slots.
MOST_KEPT, SLOTS = 500_000, 1 << 20
_open: dict[str, WordEncoder] = {}


def words_apart(path: str) -> bool:
    """Whether a tokenizer file cuts and encodes pre-tokens as this module takes for granted."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    cut = [{k: v for k, v in p.items() if k != "trim_offsets"} for p in (file.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return (
        (file.get("normalizer") or {}).get("normalizers") == NORMAL_FORM
        and cut == [SPLIT, BYTES]
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == WORD_END
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        and not file.get("truncation")
        and not file.get("padding")
    )


class WordTable:
    """Ids by 64-bit word hash: an open-address table, the words' bytes and ids, asked for all words of a batch at once.

    A word's hash sums a random number for each byte times a power for its place, so words of a batch are hashed by
    one running sum, divided by the power of their start.
    """

    def __init__(self) -> None:
        r = np.random.default_rng(20240229)
        self.random = r.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.random[32] = 0
        self.power = 0x9E3779B97F4A7C15
        self.up = self.down = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.key, self.at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.n, self.n_ids = 0, 0
        self.first, self.count, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.at_byte, self.size, self.bytes, self.n_bytes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 19, np.uint8), 0

    def hashes(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(text):
            n = len(text) + (len(text) >> 1)
            self.up, self.down = (np.full(n + 1, x, np.uint64) for x in (self.power, pow(self.power, -1, 1 << 64)))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        run = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.random[text] * self.up[: len(text)], out=run[1:])
        h = (run[end] - run[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(29)
        return np.maximum(h, np.uint64(1))

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Each hash's slot, or the empty slot where it belongs."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        found = self.key[slot]
        wrong = np.flatnonzero((found != h) & (found != 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (SLOTS - 1)
            found = self.key[slot[wrong]]
            wrong = wrong[(found != h[wrong]) & (found != 0)]
        return slot

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those not kept."""
        slot = self._slots(h)
        return np.where(self.key[slot] == h, self.at[slot], -1)

    def same(self, number: np.ndarray, size: np.ndarray, text: np.ndarray) -> bool:
        """Whether the words kept under these numbers are those that stand one after another in ``text``."""
        if (self.size[number] != size).any():
            return False
        ends = np.cumsum(size)
        place = np.repeat((self.at_byte[number] - (ends - size)).astype(np.int32), size)
        place += np.arange(len(text), dtype=np.int32)
        return bool((self.bytes[place] == text).all())

    def put(self, h: np.ndarray, words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        """Keeps new words (distinct hashes) with their bytes and ids one after another."""
        numbers = np.arange(self.n, self.n + len(h))
        sizes, text = np.array([len(w) for w in words], np.int64), np.frombuffer(b"".join(words), np.uint8)
        for name, at, values in (
            ("first", self.n, self.n_ids + np.cumsum(counts) - counts), ("count", self.n, counts), ("ids", self.n_ids, ids),
            ("at_byte", self.n, self.n_bytes + np.cumsum(sizes) - sizes), ("size", self.n, sizes), ("bytes", self.n_bytes, text),
        ):
            array = getattr(self, name)
            if at + len(values) > len(array):
                setattr(self, name, array := np.concatenate([array, np.zeros(max(len(array), len(values)), array.dtype)]))
            array[at : at + len(values)] = values
        left = np.arange(len(h))
        while len(left):  # of words that want the same empty slot the last one gets it, the others look again
            slot = self._slots(h[left])
            self.key[slot], self.at[slot] = h[left], numbers[left]
            left = left[self.key[slot] != h[left]]
        self.n, self.n_ids, self.n_bytes = self.n + len(h), self.n_ids + len(ids), self.n_bytes + len(text)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each pre-token that recurs.

    Where ``words_apart`` finds that the tokenizer drops white space and never merges across pre-tokens, a text's ids are those
    of its pre-tokens in turn.  Text outside PLAIN, special strings, and all texts of other tokenizers go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.by_words = words_apart(path)
        if not self.by_words:
            return
        # the same model for ready pre-tokens, which need no normalising and stand apart by spaces
        self.by_space = Tokenizer.from_file(path)
        self.by_space.normalizer = normalizers.Sequence([])
        self.by_space.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(WORD_END)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table = WordTable()

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The counts and ids of words; a word may be several pre-tokens."""
        cut = [PRE_TOKEN.findall(w) for w in words]
        found = self.by_space.encode_batch_fast([b" ".join(chain.from_iterable(cut[i : i + 4096])).decode("latin-1") for i in range(0, len(cut), 4096)], add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.uint32)
        ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        last = np.cumsum([0, *map(len, cut)])
        if len(ends) != last[-1] + 1:
            each = [np.frombuffer(self._whole(w.decode("latin-1")), "<u4") for w in words]
            return np.array([len(x) for x in each]), np.concatenate(each).astype(np.uint32)
        return np.diff(ends[last]), ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        plain = [self._words(t or "") for t in texts]
        out = self._encode_words([x if x is not None else b"" for x in plain])
        for n, x in enumerate(plain):
            if x is None:
                out[n] = b"".join(self._chunks(texts[n]))
        return out

    def _encode_words(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts whose words are set apart by spaces."""
        data = b" ".join([b"", *texts, b""])
        text = np.frombuffer(data, np.uint8)
        gap = text == 32
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        table = self.table
        if table.n > MOST_KEPT:
            table.clear()
        h = table.hashes(text, start, end)
        number = table.find(h)
        if len(lost := np.flatnonzero(number < 0)):
            new, first = np.unique(h[lost], return_index=True)
            at = lost[first]
            words = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            table.put(new, words, *self._learn(words))
            number[lost] = table.find(h[lost])
        if not table.same(number, end - start, text[~gap]):  # two words share a hash
            return [self._whole(t.decode("latin-1")) for t in texts]
        count = table.count[number]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = table.ids[np.repeat(table.first[number] - total[:-1], count) + np.arange(total[-1])].astype("<u4", copy=False).tobytes()
        bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
        cuts = (4 * total[np.searchsorted(start, bounds)]).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _words(self, text: str) -> bytes | None:
        """A plain text lower-cased, with spaces between its words; null if it isn't plain or has a special string.

        Points and commas are set apart, but if one of these stands beside another symbol, which makes one
        pre-token of both, all pre-tokens are.
        """
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        kinds = data.translate(KIND)
        if b"?" in kinds or any(s in text for s in self.special):
            return None
        data = data.translate(LOWER)
        if b".." in kinds or b".!" in kinds or b"!." in kinds:
            return b" ".join(PRE_TOKEN.findall(data))
        return data.replace(b".", b" . ").replace(b",", b" , ")

    def _chunks(self, text: str) -> list[bytes]:
        """The ids of what stands between spaces, plain or not."""
        parts = text.split(" ")
        odd = [not PLAIN.fullmatch(x) or any(s in x for s in self.special) for x in parts]
        ready = iter(self._encode_words([b"" if o else b" ".join(PRE_TOKEN.findall(x.encode("latin-1").translate(LOWER))) for x, o in zip(parts, odd, strict=True)]))
        return [self._whole(x) if o else r for x, o, r in zip(parts, odd, ready, strict=True)]


def encoder(path: str) -> WordEncoder:
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 1, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts (null: empty) and writes ``doc_id, part, local_start, n_tokens, ids`` in ascending doc_id order.

    ``part`` numbers the ranges in order and ``local_start`` counts the ids before a document in its part.
    Rows that share a doc_id follow each other in order of text; a null doc_id comes first.  Very long texts are encoded
    whole, other columns are not read, and no rows give files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 2 << 20):
            ids = [x + tail for x in code.encode(batch.column("text").to_pylist())]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(at + offsets[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            at += int(offsets[-1])

    rows = id_and_text(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids array<int>").write
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "compression": "zstd"}
    if encoding == "delta":
        options["parquet.writer.version"] = "v2"
    writer.options(**options).mode("errorifexists").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` from the metadata columns alone; ``start`` counts all ids before the document."""
    rows = spark.read.parquet(path)
    return _placed(rows, rows).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, ids``; with ``doc_ids`` only those, found by row-group statistics and page indexes."""
    rows = spark.read.parquet(path).select("doc_id", "ids")
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _placed(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``; the parts' totals are one row each, so their running sum is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = all_rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("local_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of files that write_tokens wrote, from the ids read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path)
    read = rows.select("doc_id", "part", "local_start", "ids").mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return _placed(read, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def encoded_digests(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to a new folder in the shared one unless ``path`` is given) and digests what they hold."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, **options)
    return token_digests(spark, path)
