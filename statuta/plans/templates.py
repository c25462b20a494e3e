"""Texts that carry a whole document's text, as a column and as DuckDB SQL: the template of number ``doc_id % n``, with ``{n}`` the document's id, ``{t}`` its text on one line and ``{h}`` the text's digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.runtime import table

KEY = "doc_id"
#: The documents with their texts on one line, empty ones as a dash.
FROM_SQL = r"(SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[\x00-\x20\x7F-\x{A0}\x{2028}\x{2029}]+', ' ', 'g')), ''), '-') AS flat FROM documents WHERE doc_id IS NOT NULL) flats"


def flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, flat``: every document's whole text on one line."""
    flat = F.trim(F.regexp_replace("text", r"[\x00-\x20\x7F-\xA0\u2028\u2029]+", " "))
    return table(spark, sf_dir, "documents").where("doc_id is not null").select(KEY, F.coalesce(F.when(flat != "", flat), F.lit("-")).alias("flat"))


def text(templates: list[str | None]) -> Column:
    one = F.get(F.array(*[F.lit(t).cast("string") for t in templates]), (F.col(KEY) % len(templates)).cast("int"))
    return F.replace(F.replace(F.replace(one, F.lit("{n}"), F.col(KEY).cast("string")), F.lit("{h}"), F.md5(F.col("flat").cast("binary"))), F.lit("{t}"), F.col("flat"))


def rows(spark: SparkSession, sf_dir: str, **columns: list[str | None]) -> DataFrame:
    """Each document with a column for each list of templates."""
    return flats(spark, sf_dir).select(KEY, *[text(v).alias(k) for k, v in columns.items()])


def sql(templates: list[str | None]) -> str:
    quoted = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in templates)
    return f"replace(replace(replace([{quoted}][{KEY} % {len(templates)} + 1], '{{n}}', {KEY}::VARCHAR), '{{h}}', md5(flat)), '{{t}}', flat)"


def want(**columns: list[str | None]) -> str:
    """The SQL of what must come of each document."""
    return f"SELECT {KEY}, " + ", ".join(f"{sql(v)} AS {k}" for k, v in columns.items()) + f" FROM {FROM_SQL}"
