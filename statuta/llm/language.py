"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages) is broadcast; texts are scored in sparse batches in numpy.
It grows with the number of languages in the labels, not with the rows: 128 kB for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import slices, text_rows

LETTER = regex.compile(r"\p{L}")
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the sample of each language that a model is fitted on.
MOST_PER_LANGUAGE = 1500
UNKNOWN = "und"


def grams(text: str, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Hash buckets of all character n-grams of the lower-cased text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = []
    for n in orders:
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= code[k : len(code) - n + 1 + k]
        h *= np.uint32(0x9E3779B1)
        out.append(h >> np.uint32(32 - (buckets.bit_length() - 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, float32
    prior: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, ties to the first by name, and its posterior."""
        names, values = [], []
        for text in texts:
            if not self.languages or not text or not LETTER.search(text):
                names.append(UNKNOWN)
                values.append(0.0)
                continue
            total = self.prior.astype(np.float64)
            h = grams(text, self.orders, len(self.log_prob))
            step = min(1 << 16, max(256, (1 << 22) // len(self.languages)))
            for start in range(0, len(h), step):
                total = total + self.log_prob[h[start : start + step]].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            names.append(self.languages[best])
            values.append(float(1 / np.exp(total - total[best]).sum()))
        return names, values


def fit_language(docs: DataFrame, per_language: int = MOST_PER_LANGUAGE, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of the rows that have text and a language.

    It is fitted on a bounded sample of every language that occurs: about ``per_language`` rows of each, taken by hash of
    the id.  Rows with a null id are never taken but count for the languages' shares.
    """
    rows = text_rows(docs, F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), orders)
    sizes = {r["lang"]: r["count"] for r in sizes}
    languages = sorted(sizes)
    shares = rows.sparkSession.createDataFrame([(x, i, min(1.0, per_language / sizes[x])) for i, x in enumerate(languages)], "lang string, at int, share double")
    taken = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.col("share") * float(1 << 40))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                n = np.bincount(grams(text, orders, buckets), minlength=buckets)
                total[at] = total[at] + n if at in total else n
        for at, n in total.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), at, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], ["at", "bucket", "n"])

    cells = taken.select("text", "at").mapInArrow(count, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((buckets, len(languages)), smoothing)
    counts[cells["bucket"].to_numpy(), cells["at"].to_numpy()] += cells["n"].to_numpy()
    total = sum(sizes.values())
    prior = np.log([sizes[x] / total for x in languages])
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior, orders)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, then ``lang_pred`` and ``score`` (0 to 1).

    Null and empty texts and texts without a letter give ``und`` with score 0, and so does every text when
    the model saw no language.  Very long texts are read whole, in pieces.  Ties go to the first language by name,
    repeated rows each give their row, kept columns may have any name, and no rows give no rows.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = text_rows(docs, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, values = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["rest", "lang_pred", "score"])

    schema = rows.select("rest", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).select(*[F.col(f"rest.`{c}`").alias(c) for c in keep], "lang_pred", "score")
