"""SimHash near-duplicates with Golay-code fuzzy keys.

The 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to the 23
bits of the perfect binary Golay code, in which every word has exactly one codeword within
three bits.  ``near(x)`` holds the codeword indices of a segment and of the segment with any
one bit flipped (one index, or six).  If two segments differ in at most one bit,
the index of either is in ``near`` of the other.

Pigeonhole over at most three differing bits: either each segment has one of them, or some
segment has none and another at most one.  So each fingerprint is stored under its index pairs
for segments (0,1), (0,2), (1,2) and looked up under near x near for (0,1) and under
index x near and near x index for the other two: two or three dozen keys, and no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import as_bytes, id_and_text, slices
from statuta.operators.components import connected_components
from statuta.runtime import checkpointed

SEED = 42
#: Generator polynomial of the [23,12,7] Golay code.
GOLAY = 0xAE3
WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
MOST_NEAR = 6
_bits = np.bitwise_count
_decoder: list[np.ndarray] = []


def _majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64-bit word of those bits that over half of the run has."""
    out = np.zeros(len(starts), np.uint64)
    full = counts > 0
    if full.any():
        ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(ones, starts[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_words(text: bytes | None, shingle: int) -> list[int]:
    parts = text.lower().split() if text else []
    if not parts:
        return []
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return [digest(b" ".join(parts), SEED)]
    return [digest(b" ".join(parts[i : i + shingle]), SEED) for i in range(len(parts) - shingle + 1)]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long, zero without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            each = [fingerprint_words(t, shingle) for t in as_bytes(batch.column("text"))]
            counts = np.array([len(x) for x in each], np.int64)
            flat = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
            fp = _majority(flat, np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, fp long")


def decoder() -> np.ndarray:
    """For each of the 2^23 words the 12-bit index of its codeword."""
    if not _decoder:
        index = np.arange(1 << 12, dtype=np.uint32)
        rest = index << 11
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, np.uint32(GOLAY << (bit - 11)), np.uint32(0))
        code = index << 11 | rest
        one = [1 << i for i in range(23)]
        errors = [0, *one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one if a < b for c in one if b < c)]
        out = np.zeros(1 << 23, np.uint16)
        for e in errors:
            out[code ^ np.uint32(e)] = index
        _decoder.append(out)
    return _decoder[0]


def near_indices(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's own codeword index, and the indices near it, padded with -1 to MOST_NEAR."""
    table = decoder()
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)
    all_ = table[segment[:, None] ^ flips].astype(np.int32)
    own = all_[:, 0].copy()
    all_.sort(axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = 1 << 20
    all_.sort(axis=1)
    near = all_[:, :MOST_NEAR]
    return own, np.where(near < 1 << 20, near, -1)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position, key, is_lookup)`` for signed 64-bit fingerprints; the key has 26 bits."""
    word = fp.view(np.uint64)
    own, near = zip(*(near_indices((word >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64), w) for s, w in zip(SHIFTS, WIDTHS, strict=True)), strict=True)
    at, keys, roles = [], [], []
    rows = np.arange(len(fp))

    def put(kind: int, left: np.ndarray, right: np.ndarray, role: int) -> None:
        ok = (left >= 0) & (right >= 0)
        value = (kind << 24) | (left.astype(np.int64) << 12) | right
        at.append(np.broadcast_to(rows[:, None], value.shape)[ok])
        keys.append(value[ok])
        roles.append(np.full(int(ok.sum()), role, np.int8))

    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        put(kind, own[i][:, None], own[j][:, None], 0)
        if kind == 0:
            for c in range(MOST_NEAR):
                put(kind, near[i][:, c : c + 1], near[j], 1)
        else:
            put(kind, own[i][:, None], near[j], 1)
            put(kind, np.where(near[i] == own[i][:, None], -1, near[i]), own[j][:, None], 1)
    return np.concatenate(at), np.concatenate(keys), np.concatenate(roles)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest linked node) that connect just what the given links connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    out = root != np.arange(len(nodes))
    return nodes[out], nodes[root[out]]


def _links(group: np.ndarray, role: np.ndarray, fp: np.ndarray, node: np.ndarray, most: int, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links, as star edges, of rows sorted by group and role (stored rows first)."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    stored = np.add.reduceat((role == 0).astype(np.int64), first)
    lookups = np.flatnonzero(role == 1)
    of = np.repeat(np.arange(len(first)), size)[lookups]
    pairs = stored[of]
    lookups, of, pairs = lookups[pairs > 0], of[pairs > 0], pairs[pairs > 0]
    cut = np.cumsum(pairs) // step
    for lo, hi in zip(np.append(0, np.flatnonzero(np.diff(cut)) + 1), np.append(np.flatnonzero(np.diff(cut)) + 1, len(pairs)), strict=True):
        n = pairs[lo:hi]
        if not len(n):
            continue
        left = np.repeat(lookups[lo:hi], n)
        right = np.repeat(first[of[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ok = (node[left] != node[right]) & (_bits((fp[left] ^ fp[right]).view(np.uint64)) <= most)
        if ok.any():
            yield _forest(node[left[ok]], node[right[ok]])


def golay_links(nodes: DataFrame, most_bits: int = 3, block: int = 2048) -> DataFrame:
    """``(src, dst)``: edges that connect exactly the nodes that links of at most ``most_bits`` connect.

    ``nodes`` is ``(node, fp)`` with distinct fingerprints.  Rows meet by key; a key with more than
    ``block`` stored rows or lookups is dealt out as blocks of both that meet once each, so no
    task gets a whole hot key.  Each group gives back a spanning star, never all its pairs.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("the keys find up to three differing bits")

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            node, fp = frame["node"].to_numpy(), frame["fp"].to_numpy()
            for start in range(0, len(fp), 4096):
                at, key, role = golay_keys(np.ascontiguousarray(fp[start : start + 4096]))
                yield pd.DataFrame({"key": key, "role": role, "fp": fp[start : start + 4096][at], "node": node[start : start + 4096][at]})

    rows = nodes.select("node", "fp").mapInPandas(emit, "key long, role byte, fp long, node long")
    hot = (
        rows.groupBy("key")
        .agg(F.sum((F.col("role") == 0).cast("long")).alias("n_stored"), F.sum((F.col("role") == 1).cast("long")).alias("n_lookup"))
        .where(f"n_stored > {block} or n_lookup > {block}")
        .select("key", F.ceil(F.col("n_stored") / block).cast("int").alias("sb"), F.ceil(F.col("n_lookup") / block).cast("int").alias("lb"))
    )
    one = F.lit(1)
    sb, lb = F.greatest(F.coalesce("sb", one), one), F.greatest(F.coalesce("lb", one), one)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("role") == 0, sb).otherwise(lb)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, lb).otherwise(sb) - 1))
    dealt = (
        rows.join(checkpointed(hot), "key", "left")
        .select("key", "role", "fp", "node", own.alias("own"), other.alias("other"))
        .withColumn("block", F.when(F.col("role") == 0, F.struct(F.col("own").alias("s"), F.col("other").alias("l"))).otherwise(F.struct(F.col("other").alias("s"), F.col("own").alias("l"))))
        .select("key", F.col("block.s").alias("s"), F.col("block.l").alias("l"), "role", "fp", "node")
        .repartition("key", "s", "l")
        .sortWithinPartitions("key", "s", "l", "role")
    )

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] | None = None
        for frame in frames:
            part = [frame[c].to_numpy() for c in ("key", "s", "l", "role", "fp", "node")]
            kept = part if kept is None else [np.concatenate(x) for x in zip(kept, part, strict=True)]
            if not len(kept[0]):
                continue
            tail = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1]) & (kept[2] == kept[2][-1])
            end = len(tail) - int(tail.sum())
            if end:
                yield from solve([x[:end] for x in kept])
                kept = [x[end:] for x in kept]
        if kept is not None and len(kept[0]):
            yield from solve(kept)

    def solve(part: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        key, s, l, role, fp, node = part
        change = np.concatenate([[False], (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (l[1:] != l[:-1])])
        for a, b in _links(np.cumsum(change), role, fp, node, most_bits):
            yield pd.DataFrame({"src": a, "dst": b})

    return dealt.mapInPandas(match, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Fingerprints link at ``most_bits`` or fewer differing bits; ``component_id`` is the
    smallest doc_id that a document reaches over links, itself included.  Null and empty texts
    and texts of white space have fingerprint zero and link like any other.  Repeated rows
    each give their row.  Rows with a null doc_id get a fingerprint and the component of
    their fingerprint's documents, or null if none has an id; they name no component.
    """
    prints = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = golay_links(nodes.where("node is not null").repartition("node"), most_bits)
    parts = connected_components(edges)
    of = checkpointed(nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(of, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
