"""Queries of citations and structural registries, over the outlines of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import citations
from statuta.plans import templates as T
from statuta.plans.registry import query
from statuta.sources.outlines import LAWS_SQL, PLACES, laws, numbers

KEY = T.KEY


def _text(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


#: Words behind a document's whole text, as clause 1 of article 1 of its law, and their mentions: kind, reason of a missing target, reason of a found one, targets, scope, whether it is the clause itself.
CITED = [
    ("theo điểm a khoản 2 điều 1 Luật số {n}/2020/QH14", [("external_point", "target_structural_unit_not_found", "same_document_reference_not_external", "d{n}_art1_cl2_pa", "LOCAL", "false")]),
    ("khoản 1, 2 và 3 Điều 2", [("local_clauses", "explicit_clause_target_missing", None, "d{n}_art2_cl1,d{n}_art2_cl2,d{n}_art2_cl3", "LOCAL", "false")]),
    ("các khoản 1 và 2 Điều 2; Điều 2", [("local_clauses", "explicit_clause_target_missing", None, "d{n}_art2_cl1,d{n}_art2_cl2", "LOCAL", "false"), ("local_article", "explicit_article_target_missing", None, "d{n}_art2", "LOCAL", "false")]),
    ("điểm a, b khoản này", [("points_of_clause", "relative_point_target_missing", None, "d{n}_art1_cl1_pa,d{n}_art1_cl1_pb", "LOCAL", "false")]),
    ("Mục 2 Chương I và Điều 9", [("local_section", "explicit_section_target_missing", None, "d{n}_ch1_sec2", "LOCAL", "false"), ("local_article", "explicit_article_target_missing", None, "d{n}_art9", "LOCAL", "false")]),
    ("Phần này, Chương này và phụ lục này", [("current_part", None, None, "=d{n}_part1", "LOCAL", "false"), ("current_chapter", None, None, "=d{n}_ch1", "LOCAL", "false"), ("current_appendix", "current_appendix_context_missing", None, "", "LOCAL", "false")]),
    ("Nghị định 1/1999/NĐ-CP", [("external_document", "target_document_not_in_snapshot", None, "", "EXTERNAL", "false")]),
    ("Điều 3 của Luật số 0/2020/QH14", [("external_article", "target_structural_unit_not_found", "registry_external_structural_resolution", "d0_art3", "EXTERNAL", "false")]),
    ("khoản này và khoản 2 Điều này", [("current_clause", None, None, "=d{n}_art1_cl1", "LOCAL", "true"), ("clause_of_article", "current_article_clause_target_missing", None, "d{n}_art1_cl2", "LOCAL", "false")]),
    ("Phụ lục I kèm theo Luật này, tiểu mục 1 mục 1 chương I, điểm b khoản 1 Điều 1", [("local_appendix", "explicit_appendix_target_missing", None, "d{n}_app_i", "LOCAL", "false"), ("local_subsection", "explicit_subsection_target_missing", None, "", "LOCAL", "false"), ("local_point", "explicit_point_target_missing", None, "d{n}_art1_cl1_pb", "LOCAL", "false")]),
    ("Phần thứ nhất và Phụ lục II", [("local_part", "explicit_part_target_missing", None, "d{n}_part1", "LOCAL", "false"), ("local_appendix", "explicit_appendix_target_missing", None, "", "LOCAL", "false")]),
    ("Luật số {n}/2020/QH14", [("external_document", None, "same_document_reference_not_external", "=d{n}", "LOCAL", "false")]),
    ("Điều này; Chương II của Luật này; “Điều 2”", [("current_article", None, None, "=d{n}_art1", "LOCAL", "false"), ("local_chapter", "explicit_chapter_target_missing", None, "d{n}_ch2", "LOCAL", "false")]),
]
WANTED = ", ".join(f"({k}, {p}, {', '.join(map(_text, m))})" for k, (_, ms) in enumerate(CITED) for p, m in enumerate(ms))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("d"), F.col(KEY).cast("string"))
    rows = T.rows(spark, sf_dir, text=["{t} — " + t for t, _ in CITED]).select(KEY, "text", doc.alias("document_id"), F.concat(doc, F.lit("_art1_cl1")).alias("unit_id"))
    none = F.lit(None).cast("string")
    context = F.struct(F.lit("1").alias("article"), F.lit("1").alias("clause"), F.concat(doc, F.lit("_art1")).alias("article_id"), F.col("unit_id").alias("clause_id"), F.concat(doc, F.lit("_ch1")).alias("chapter_id"), F.concat(doc, F.lit("_part1")).alias("part_id"), none.alias("appendix_id"))
    # what is quoted at the end is excluded from mentions
    quote = F.when(F.endswith("text", F.lit("”")), F.array(F.struct((F.length("text") - F.locate("“", F.reverse("text"))).cast("int").alias("s"), F.length("text").cast("int").alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    return citations.mentions(rows.withColumn("context", context), "text", quote)


@query(f"""WITH {LAWS_SQL}, v(k, pos, kind, missing, found, targets, scope, is_self) AS (VALUES {WANTED}), m AS (SELECT doc_id, v.* FROM documents JOIN v ON k = doc_id % {len(CITED)}),
t AS (SELECT doc_id, pos, replace(unnest(string_split(targets, ',')), '{{n}}', doc_id::VARCHAR) AS target FROM m), j AS (SELECT doc_id, pos, bool_and(starts_with(target, '=') OR l.id IS NOT NULL) AS every, string_agg(ltrim(target, '=')) AS ids FROM (SELECT doc_id, pos, target FROM t) LEFT JOIN laws l ON l.id = target GROUP BY ALL),
r AS (SELECT m.*, every, ids FROM m JOIN j USING (doc_id, pos))
SELECT doc_id, pos::BIGINT AS pos, kind, CASE WHEN every THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN every THEN CASE WHEN kind = 'external_article' AND doc_id = 0 THEN 'same_document_reference_not_external' ELSE found END ELSE missing END AS reason,
CASE WHEN every THEN ids END AS targets, CASE WHEN kind = 'external_article' AND doc_id = 0 THEN 'LOCAL' ELSE scope END AS scope, is_self = 'true' AS is_self FROM r""")
def ref2_resolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF1 to REF6, ARR2, JON8, JON9: mentions of 24 kinds and what they resolve to in the registry, all targets or none."""
    out = citations.resolved(_cited(spark, sf_dir), laws(spark, sf_dir), numbers(spark, sf_dir), [KEY])
    return out.select(KEY, F.col("pos").cast("long").alias("pos"), "kind", "status", "reason", F.array_join("targets", ",").alias("targets"), "scope", "is_self")


@query(f"""WITH {LAWS_SQL}, s AS (SELECT *, document_id[2:]::BIGINT AS k FROM laws) SELECT min(id) AS id, 'shared_key' AS problem FROM s WHERE kind = 'Point' GROUP BY parent_id HAVING count(*) > 1
UNION ALL SELECT id, 'missing_parent' FROM s WHERE kind = 'Appendix' AND k % 3 = 0 UNION ALL SELECT id, 'repeated_id' FROM s WHERE kind = 'Article' AND article = '2' AND k % 2 = 0""")
def ing7_registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING7, ING8: registries with points of one label, appendices of no parent and repeated articles."""
    u = laws(spark, sf_dir)
    n = F.substr("document_id", F.lit(2)).cast("long")
    u = u.withColumn("point", F.when(F.col("kind") == "Point", "a")).withColumn("parent_id", F.when((F.col("kind") == "Appendix") & (n % 3 == 0), "lost").otherwise(F.col("parent_id")))
    again = u.where((F.col("kind") == "Article") & (F.col("article") == "2") & (n % 2 == 0))
    return citations.registry_problems(u.unionByName(again))


@query(f"""WITH {LAWS_SQL}, l AS (SELECT document_id, id || '|' || kind || '|' || coalesce(parent_id, '') || '|' || {" || '|' || ".join(f"coalesce({c}, '')" for c in PLACES)} AS line FROM laws)
SELECT document_id, count(*) AS n_units, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY document_id""")
def ing7_registry_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING7, SNK9: the content digest of each document's part of the registry."""
    return citations.document_digests(laws(spark, sf_dir))
