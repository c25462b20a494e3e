"""File sources with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key, value`` of one JSON object of objects."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` with LF newlines, a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``code, title, number`` of folders that hold a ``metadata.json`` each."""
    meta = spark.read.schema("title string, number string, doc_type string").option("multiLine", True).json(f"{path}/*/metadata.json").withColumn("file", F.input_file_name())
    parts = F.split("file", "/")
    return meta.select(F.element_at(parts, -2).alias("code"), "title", "number", "doc_type")


def packed_manifest(packed: DataFrame) -> DataFrame:
    """As ``manifest`` of folders that are packed: rows ``file, content``, a file's path and text; only each folder's ``metadata.json`` counts.

    A file for each of many documents costs a listing and an opening each, and the driver must know them all; packed ones are read by size.
    """
    parts = F.split("file", "/")
    meta = packed.where(F.element_at(parts, -1) == "metadata.json").select(F.get(parts, F.size(parts) - 2).alias("code"), F.from_json("content", "title string, number string, doc_type string").alias("m"))
    return meta.select("code", "m.title", "m.number", "m.doc_type")


def search_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_index, pos, url)`` with ``duplicate``: whether the URL came on an earlier place."""
    from pyspark.sql import Window

    first = Window.partitionBy("url").orderBy("page_index", "pos")
    return pages.withColumn("duplicate", F.row_number().over(first) > 1)


def discovered(pages: DataFrame, keys: list[str], most_pages: int | None = None, most_documents: int | None = None) -> DataFrame:
    """The results ``pages(keys, page_index, pos, url)`` that a paged search goes through, with ``duplicate``, as far as it goes.

    A search goes page by page from 1 and ends behind a page that has nothing new, before a page that isn't there, and at its limits: behind so many pages, or with the result that is the
    so-manieth new one.  A URL is new on its first place.
    """
    from pyspark.sql import Window

    if (most_pages is not None and most_pages < 1) or (most_documents is not None and most_documents < 1):
        raise ValueError("limits must be at least 1")
    first = F.row_number().over(Window.partitionBy(*keys, "url").orderBy("page_index", "pos")) == 1
    upto = Window.partitionBy(*keys).orderBy("page_index", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pages.withColumn("_new", first).withColumn("_n", F.sum(F.col("_new").cast("int")).over(upto))
    each = rows.groupBy(*keys, "page_index").agg(F.count_if("_new").alias("_fresh"))
    order = Window.partitionBy(*keys).orderBy("page_index")
    stop = (F.row_number().over(order) != F.col("page_index")) | (F.coalesce(F.lag("_fresh").over(order), F.lit(1)) == 0)
    visited = each.withColumn("_over", F.max(stop.cast("int")).over(order)).where("_over = 0")
    if most_pages is not None:
        visited = visited.where(F.col("page_index") <= most_pages)
    out = rows.join(visited.select(*keys, "page_index"), [*keys, "page_index"])
    if most_documents is not None:
        out = out.where((F.col("_n") < most_documents) | ((F.col("_n") == most_documents) & F.col("_new")))
    return out.select(*pages.columns, (~F.col("_new")).alias("duplicate"))
