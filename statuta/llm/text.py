"""Byte-level text helpers used inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of lower-cased UTF-8 bytes: digits, a-z and everything outside ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


#: Rows and bytes of the Arrow batches that Python workers get; Spark's defaults take a worker much memory for long texts.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def text_rows(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with the given columns, to be read in small Arrow batches from here on in the session."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows.select(*columns)


def id_and_text(rows: DataFrame, id_col: str, text_col: str, as_id: str = "doc_id", as_text: str = "text") -> DataFrame:
    """The id as a long and the text as a string, under fixed names."""
    return text_rows(rows, F.col(id_col).cast("long").alias(as_id), F.col(text_col).cast("string").alias(as_text))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text after lower-casing A-Z only; none for null."""
    return WORD.findall(text.lower()) if text else []


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most_bytes`` of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()
