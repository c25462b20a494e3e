"""Whether a parsed document hangs together: its groups and articles against one another, each fault a row, by joins on the groups' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.runtime import checkpointed


def _key(*names: str) -> Column:
    """The key of a group within its document; a missing level is one of its own."""
    return F.concat_ws("|", "doc_id", *[F.coalesce(n, F.lit("~")) for n in names])


def _keys(groups: DataFrame, kind: str, *names: str) -> DataFrame:
    return groups.where(F.col("kind") == kind).select(_key(*names).alias("_key")).distinct()


def problems(units: DataFrame) -> DataFrame:
    """``doc_id, problem, number, n``: every fault of parsed documents, with the number of the unit that has it and how often it has it.

    ``units`` is ``doc_id, kind, number, part, chapter, section, subsection`` of parts, sections, subsections and articles (their own number in ``number``, the levels around
    them in the others).  Faults: duplicate_article (a number twice in a part), duplicate_part, duplicate_subsection; section_missing_part, subsection_missing_section,
    article_missing_part, article_missing_section, article_missing_subsection (what they name isn't there), subsection_without_section.
    """
    # each check reads them, and the texts that they were parsed from are far larger
    units = checkpointed(units)
    parts = _keys(units.withColumn("part", F.col("number")), "Part", "part")
    sections = _keys(units.withColumn("section", F.col("number")), "Section", "part", "chapter", "section")
    subsections = _keys(units.withColumn("subsection", F.col("number")), "Subsection", "part", "chapter", "section", "subsection")
    of = lambda kind: units.where(F.col("kind") == kind)

    def told(rows: DataFrame, problem: str) -> DataFrame:
        return rows.groupBy("doc_id", F.lit(problem).alias("problem"), "number").agg(F.count(F.lit(1)).alias("n"))

    def again(kind: str, problem: str, *names: str) -> DataFrame:
        return of(kind).groupBy("doc_id", *[F.coalesce(n, F.lit("~")).alias(f"_{n}") for n in names], "number").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").groupBy("doc_id", F.lit(problem).alias("problem"), "number").agg(F.sum("n").alias("n"))

    def lacking(rows: DataFrame, keys: DataFrame, problem: str, *names: str) -> DataFrame:
        return told(rows.withColumn("_key", _key(*names)).join(keys, "_key", "left_anti"), problem)

    articles = of("Article")
    found = [
        again("Article", "duplicate_article", "part"), again("Part", "duplicate_part"), again("Subsection", "duplicate_subsection", "part", "chapter", "section"),
        lacking(of("Section").where("part is not null"), parts, "section_missing_part", "part"), lacking(of("Subsection"), sections, "subsection_missing_section", "part", "chapter", "section"),
        lacking(articles.where("part is not null"), parts, "article_missing_part", "part"), told(articles.where("subsection is not null and section is null"), "subsection_without_section"),
        lacking(articles.where("section is not null"), sections, "article_missing_section", "part", "chapter", "section"),
        lacking(articles.where("section is not null and subsection is not null").withColumn("_s", _key("part", "chapter", "section")).join(sections.withColumnRenamed("_key", "_s"), "_s", "left_semi"), subsections, "article_missing_subsection", "part", "chapter", "section", "subsection"),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def without_orphans(units: DataFrame) -> DataFrame:
    """``units`` without the sections and subsections that no article is in."""
    articles = units.where("kind = 'Article'")
    held = articles.where("section is not null").select(_key("part", "chapter", "section").alias("_key")).distinct()
    deep = articles.where("section is not null and subsection is not null").select(_key("part", "chapter", "section", "subsection").alias("_key")).distinct()
    rest = units.where("kind not in ('Section', 'Subsection')")
    sections = units.where("kind = 'Section'").withColumn("_own", F.col("section")).withColumn("section", F.col("number")).withColumn("_key", _key("part", "chapter", "section")).join(held, "_key", "left_semi").withColumn("section", F.col("_own"))
    subsections = units.where("kind = 'Subsection'").withColumn("_own", F.col("subsection")).withColumn("subsection", F.col("number")).withColumn("_key", _key("part", "chapter", "section", "subsection")).join(deep, "_key", "left_semi").withColumn("subsection", F.col("_own"))
    return rest.unionByName(sections.select(units.columns)).unionByName(subsections.select(units.columns))
