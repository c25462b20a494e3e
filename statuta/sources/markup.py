"""Key-value and grouped-list pages, read with the standard HTML parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Cells(HTMLParser):
    """Rows of cell texts, and list items under the last heading."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.groups: dict[str, list[str]] = {}
        self.heading, self.buffer, self.into = "", [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th", "h2", "h3", "li"):
            self.buffer, self.into = [], tag

    def handle_endtag(self, tag):
        if tag != self.into:
            return
        text, self.into = " ".join("".join(self.buffer).split()), ""
        if tag in ("td", "th") and self.rows:
            self.rows[-1].append(text)
        elif tag in ("h2", "h3"):
            self.heading = text
        elif tag == "li" and self.heading and text:
            self.groups.setdefault(self.heading, []).append(text)

    def handle_data(self, data):
        if self.into:
            self.buffer.append(data)


def _parsed(html: str | None) -> _Cells:
    page = _Cells()
    page.feed(html or "")
    page.close()
    return page


def properties(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, key, value`` of two-cell table rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, r[0], r[1]) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in _parsed(h).rows if len(r) == 2]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["id", "key", "value"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, "id long, key string, value string")


def grouped_lists(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, category, title`` of list items under headings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, c, t) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c, ts in _parsed(h).groups.items() for t in ts]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["id", "category", "title"])

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(run, "id long, category string, title string")
