"""Citations in text: mentions, targets, all-or-nothing bundles, conversation references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One leftmost scan; at a place the longest form comes first, so mentions never overlap.
MENTION = r"(?iu)(?:điểm\s+[a-zđ]\s+)?(?:khoản\s+\d+[a-z]?\s+)?điều\s+\d+[a-z]?|(?:điểm\s+[a-zđ]\s+)?khoản\s+\d+[a-z]?|điều này|khoản này"


def mentions(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, raw, article, clause, point, relative``: the citations of each text in order."""
    found = rows.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(MENTION), F.lit(0))).alias("pos", "raw"))

    def part(pattern: str) -> Column:
        value = F.regexp_extract("raw", pattern, 1)
        return F.when(value != "", value)

    return found.select("id", "pos", "raw", part(r"(?iu)điều\s+(\d+[a-z]?)").alias("article"), part(r"(?iu)khoản\s+(\d+[a-z]?)").alias("clause"), part(r"(?iu)điểm\s+([a-zđ])\s").alias("point"), F.col("raw").rlike("(?iu) này$").alias("relative"))


def listed(text: Column) -> Column:
    """The numbers of ``1, 2 và 3`` in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+[a-z]?)"), F.lit(1)))


def all_or_nothing(rows: DataFrame, registry: DataFrame, bundle: str, target: str) -> DataFrame:
    """Rows with ``resolved``: whether all targets of their bundle are in ``registry(id)``."""
    known = registry.select(F.col("id").alias(target)).distinct().withColumn("_k", F.lit(1))
    verdict = rows.join(known, target, "left").groupBy(bundle).agg((F.count("_k") == F.count(F.lit(1))).alias("resolved"))
    return rows.join(verdict, bundle)


def bundle_id(unit: Column, start: Column, end: Column, text: Column) -> Column:
    """sha256 of ``unit|start|end|text`` with white space collapsed."""
    return F.sha2(F.concat_ws("|", unit, start.cast("string"), end.cast("string"), F.trim(F.regexp_replace(text, r"\s+", " "))).cast("binary"), 256)


def reply_choice(reply: Column, options: Column) -> Column:
    """The option that a clarification reply names by its number from 1 or by its label, null for neither."""
    ordinal = F.try_to_number(F.regexp_extract(reply, r"^\s*(\d{1,3})\s*$", 1), F.lit("999")).cast("int")
    same = F.filter(options, lambda o: F.lower(F.trim(o)) == F.lower(F.trim(reply)))
    return F.coalesce(F.when((ordinal >= 1) & (ordinal <= F.size(options)), F.get(options, ordinal - 1)), F.get(same, F.lit(0)))
