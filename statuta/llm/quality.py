"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (characters, words, and whether words repeat) are scaled by the classes' log-count
ratios; a linear hinge-loss model is fitted to them by dual coordinate descent, drawn towards its mean
weight, and its margins are turned into probabilities on rows that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import as_bytes, id_and_text, slices, text_rows

BITS = 17
#: Bounds of the labelled sample that a model is fitted on: rows, and indicators of all of them.
MOST_ROWS, MOST_INDICATORS = 5000, 50_000_000
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_mult = np.uint32(0x9E3779B1)


def features(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """The distinct hash buckets of a text's n-grams: bytes by threes and fours, words, word pairs and runs of repeats."""
    size = 1 << bits
    b = np.frombuffer(text or b"", np.uint8)
    if not len(b):
        return np.zeros(0, np.int32)
    seen = np.zeros(size, bool)
    shift = np.uint32(32 - bits)
    wide = b.astype(np.uint32)
    for n in (3, 4):
        if len(wide) >= n:
            h = np.full(len(wide) - n + 1, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= wide[k : len(wide) - n + 1 + k]
            seen[(h * _mult) >> shift] = True
    gap = SPACES[b]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if len(start):
        place = np.arange(len(b)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(b)]])))
        mix = (wide + np.uint32(1)) * (place.astype(np.uint32) * np.uint32(2) + np.uint32(1)) * _mult
        mix ^= mix >> np.uint32(15)
        mix[gap] = 0
        word = np.add.reduceat(mix, start, dtype=np.uint32)
        seen[((word ^ np.uint32(0x5BD1E995)) * _mult) >> shift] = True
        pair = word[:-1] * np.uint32(31) + word[1:]
        seen[(pair * _mult) >> shift] = True
        same = (word[:-1] == word[1:]).astype(np.uint32)
        for n in (1, 2, 3):
            if len(same) >= n:
                h = np.full(len(same) - n + 1, 77 + n, np.uint32)
                for k in range(n):
                    h = h * np.uint32(2) + same[k : len(same) - n + 1 + k]
                seen[(h * _mult * _mult) >> shift] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray  # of buckets, with the log-count ratios multiplied in
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, index: np.ndarray) -> float:
        if not len(index):
            return self.bias
        r = self.ratio[index]
        norm = float(np.sqrt((r * r).sum()))
        return float(self.weight[index].sum()) / (norm or 1.0) + self.bias

    def score(self, index: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(index) + self.offset, -500, 500))))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """The weights, bias last, of the linear hinge-loss model of sparse rows, one dual variable at a time."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float((v * v).sum()) for v in values]) + 1
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            y = label[i]
            slope = y * (w[rows[i]] @ values[i] + w[size]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                w[rows[i]] += step * values[i]
                w[size] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def calibrated(margins: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns margins into probabilities, by Newton's method."""
    p, n = positive.sum(), (~positive).sum()
    target = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        g, h = q - target, np.maximum(q * (1 - q), 1e-9)
        grad = np.array([g @ margins + 1e-3 * (slope - 1), g.sum()])
        hess = np.array([[h @ (margins * margins) + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-8:
            break
    return (float(slope), float(offset)) if slope > 0 else (1.0, float(np.log((p + 1) / (n + 1))))


def fit(index: list[np.ndarray], label: np.ndarray, bits: int = BITS, smoothing: float = 1.0, blend: float = 0.75, cost: float = 1.0) -> QualityModel:
    """A model of sparse indicator rows with labels 0 and 1; every fifth row only sets the probabilities."""
    size = 1 << bits
    positive = np.asarray(label) > 0
    if not len(index):
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0)
    hold = np.arange(len(index)) % 5 == 4 if len(index) >= 50 else np.zeros(len(index), bool)
    train = np.flatnonzero(~hold)
    counts = np.full((2, size), smoothing)
    for i in train:
        counts[int(positive[i])][index[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sizes = np.array([len(x) for x in index])
    flat = ratio[np.concatenate(index)].astype(np.float32) if sizes.sum() else np.zeros(0, np.float32)
    ends = np.cumsum(sizes)
    values = [flat[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
    for v in values:
        v /= np.sqrt(v @ v) or 1.0
    sign = np.where(positive, 1.0, -1.0)
    w = dual_coordinate_descent([index[i] for i in train], [values[i] for i in train], sign[train], size, cost)
    bias, w = float(w[size]), w[:size]
    mean = float(np.abs(w).mean())
    w = (1 - blend) * mean + blend * w
    model = QualityModel((w * ratio), ratio, bias, 1.0, 0.0)
    judged = np.flatnonzero(hold) if hold.any() else train
    slope, offset = calibrated(np.array([model.margin(index[i]) for i in judged]), positive[judged])
    return QualityModel(model.weight, ratio, bias, slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_indicators: int = MOST_INDICATORS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model of the documents that ``labels`` marks with 0 or 1.

    It is fitted on at most ``most_rows`` labelled ids, the first by hash of the id, and on no more of them than have
    ``most_indicators`` indicators together (8 bytes each in the task that fits), whatever the length of the texts.
    An id marked more than once has the rounded mean of its marks; of rows that repeat an id the one with the least text counts, nulls last; marks
    of ids that no document has don't count.
    Without labelled documents every text scores 0.5.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    there = marks.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    taken = there.groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = id_and_text(docs, id_col, text_col, "id").join(F.broadcast(taken), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            index = [features(t, bits) for t in as_bytes(batch.column("text"))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(index)))], ["id", "label", "index"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, left = [], most_indicators
        for b in batches:
            ends = b.column("index").offsets.to_numpy()[1:] - b.column("index").offsets[0].as_py()
            n = int(np.searchsorted(ends, left, "right"))
            if n:
                parts.append(b.slice(0, n))
                left -= int(ends[n - 1])
            if n < b.num_rows:
                break
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids, marks_, lists = (whole.column(c).chunk(0) for c in ("id", "label", "index"))
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        _, first = np.unique(ids.to_numpy(), return_index=True)
        order = first[np.random.default_rng(5).permutation(len(first))]
        m = fit([flat[offsets[i] : offsets[i + 1]] for i in order], marks_.to_numpy()[order], bits)
        numbers = [pa.array([x], pa.float64()) for x in (m.bias, m.slope, m.offset)]
        packed = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (m.weight, m.ratio)]
        yield pa.RecordBatch.from_arrays([*packed, *numbers], ["weight", "ratio", "bias", "slope", "offset"])

    sample = rows.mapInArrow(run, "id long, label int, index array<int>").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    found = sample.mapInArrow(train, "weight binary, ratio binary, bias double, slope double, offset double").first()
    if found is None:
        return fit([], np.zeros(0), bits)
    return QualityModel(np.frombuffer(found["weight"], np.float32), np.frombuffer(found["ratio"], np.float32), found["bias"], found["slope"], found["offset"])


def rate(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, text_col: str = "text", column: str = "score") -> DataFrame:
    """The columns ``keep`` of each row and its ``score``, 0 to 1.

    Null and empty texts score by the bias alone, very long texts are read whole, repeated rows each give their row,
    kept columns may have any name, and no rows give no rows.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = len(model.weight).bit_length() - 1
    rows = text_rows(docs, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            scores = [m.score(features(t, bits)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(scores, pa.float64())], ["rest", "score"])

    schema = rows.select("rest", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).select(*[F.col(f"rest.`{c}`").alias(c) for c in keep], F.col("score").alias(column))
