"""Texts as line records with absolute character spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(text: F.Column) -> F.Column:
    """LF newlines."""
    return F.regexp_replace(text, "\r\n?", "\n")


def source_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, line, start_char, end_char``; offsets are code points, half open."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(canonical(F.col(text_col)), "\n")).alias("line_no", "line"))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("line") + 1).over(upto) - 1
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", (end - F.length("line")).alias("start_char"), end.alias("end_char"))


def headings(lines: DataFrame, pattern: str) -> DataFrame:
    """``lines`` with ``heading_line``, the last line up to here that matches the pattern."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading_line", F.last(F.when(F.col("line").rlike(pattern), F.col("line_no")), ignorenulls=True).over(upto))
