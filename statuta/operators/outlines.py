"""Articles of texts that have none, by Roman outline, else by size; and the categories of diagrams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from statuta.functions import strings

# Diagram categories by relation and direction, and those that are known but stand for none.
DIAGRAM_RELATIONS = {
    "Văn bản được sửa đổi bổ sung": ("AMENDS", "CURRENT_TO_TARGET"),
    "Văn bản sửa đổi bổ sung": ("AMENDS", "TARGET_TO_CURRENT"),
    "Văn bản được thay thế": ("REPLACES", "CURRENT_TO_TARGET"),
    "Văn bản thay thế": ("REPLACES", "TARGET_TO_CURRENT"),
    "Văn bản bị bãi bỏ": ("REPEALS", "CURRENT_TO_TARGET"),
    "Văn bản bãi bỏ": ("REPEALS", "TARGET_TO_CURRENT"),
    "Văn bản quy định chi tiết, hướng dẫn thi hành": ("GUIDES", "CURRENT_TO_TARGET"),
    "Văn bản được quy định chi tiết, hướng dẫn thi hành": ("GUIDES", "TARGET_TO_CURRENT"),
}
UNUSED_CATEGORIES = [
    "Căn cứ ban hành", "Văn bản được hợp nhất", "Văn bản hợp nhất", "Văn bản được đính chính", "Văn bản đính chính", "Văn bản được giải thích", "Văn bản được công bố", "Văn bản bị đình chỉ thi hành",
    "Văn bản bị tạm ngưng hiệu lực", "Văn bản dẫn chiếu", "Văn bản được dẫn chiếu", "Văn bản áp dụng", "Văn bản hướng dẫn áp dụng", "Văn bản được hướng dẫn áp dụng",
]
OUTLINE = r"^[IVX]+\s*[/.\-]\s+\p{Lu}.+$"
PIECE = 3000


def pieces_by_size(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters, each up to the last line end in reach if there is one, trimmed."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (newline := text.rfind("\n", start, end)) > start:
            end = newline
        out.append(text[start:end].strip())
        start = end
    return out


@F.pandas_udf(ArrayType(StringType()))
def size_pieces(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else pieces_by_size(t, n) for t, n in zip(texts, sizes, strict=True)])


def outline_chunks(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, title, content``: what stands under each Roman heading and before the first, in order from 1."""
    trimmed = F.trim("line")
    lines = rows.select(id_col, F.posexplode(F.split(text_col, "\r?\n|\r")).alias("line_no", "line")).withColumn("_head", trimmed.rlike(OUTLINE))
    upto = Window.partitionBy(id_col).orderBy("line_no")
    chunk = lines.withColumn("_chunk", F.sum(F.col("_head").cast("int")).over(upto)).groupBy(id_col, "_chunk").agg(
        F.max(F.when(F.col("_head"), trimmed)).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("line_no", "line")))).alias("_body"),
    )
    content = F.regexp_replace(F.array_join(F.transform("_body", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    pos = F.row_number().over(Window.partitionBy(id_col).orderBy("_chunk"))
    return chunk.select(id_col, pos.alias("pos"), "title", content.alias("content"))


def synthetic_articles(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, number, title, content``: the outline's chunks if there are two or more, else pieces by size; blank ones go."""
    chunks = outline_chunks(rows, id_col, text_col)
    several = chunks.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(id_col))).where("_n >= 2").drop("_n")
    rest = rows.join(several.select(id_col).distinct(), id_col, "left_anti")
    trimmed = F.regexp_replace(text_col, r"^\s+|\s+$", "")
    sized = rest.select(id_col, F.posexplode(size_pieces(trimmed, F.lit(PIECE))).alias("pos", "content")).select(id_col, (F.col("pos") + 1).alias("pos"), F.lit(None).cast("string").alias("title"), "content")
    place = F.col("pos").cast("string")
    return several.unionByName(sized).where("content <> ''").select(
        id_col, F.col("pos").cast("long").alias("pos"), F.concat(F.lit("SP_"), place).alias("number"), F.coalesce("title", F.concat(F.lit("[Phần "), place, F.lit("]"))).alias("title"), "content"
    )


def categorised(rows: DataFrame, category: str, targets: str) -> DataFrame:
    """``rows`` with ``state`` (supported, unsupported, unknown; empty without targets), ``relation`` and ``direction`` by category."""
    known = rows.sparkSession.createDataFrame([(c, *r) for c, r in DIAGRAM_RELATIONS.items()] + [(c, None, None) for c in UNUSED_CATEGORIES], "_category string, relation string, direction string")
    bare = F.trim(strings.count_suffix_stripped(F.col(category)))
    joined = rows.withColumn("_bare", bare).join(F.broadcast(known), F.col("_bare") == F.col("_category"), "left")
    state = F.when(F.size(targets) == 0, "empty").when(F.col("_category").isNull(), "unknown").when(F.col("relation").isNull(), "unsupported").otherwise("supported")
    return joined.withColumn("state", state).drop("_bare", "_category")
