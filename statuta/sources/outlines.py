"""Outlines seen in the driver's documents: of each text's lines four are an article, two articles a section, two sections a chapter, two chapters a part.

The same view exists as DuckDB SQL (``LAWS_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.citations import COORDINATES
from statuta.runtime import table
from statuta.sources.lines import canonical

ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
PLACES = COORDINATES[1:]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id is not null").withColumn("doc", F.concat(F.lit("d"), F.col("doc_id").cast("string")))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``number, document_id`` of the units of kind Document in ``laws``; their texts aren't read."""
    return _documents(spark, sf_dir).select(F.concat("doc_id", F.lit("/2020/QH14")).alias("number"), F.col("doc").alias("document_id"))


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, kind, document_id, parent_id`` and the coordinates of every unit.

    A clause is a line that isn't blank; the first clause of an article has its first sentence as point a and the rest as point b; a text with an odd number of lines has an appendix.
    """
    lines = F.filter(F.split(canonical(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x) != "")
    d = _documents(spark, sf_dir).select("doc", lines.alias("lines"))
    doc, i = F.col("doc"), F.col("i")
    step = {"part": F.floor(i / 32) + 1, "chapter": F.floor(i / 16) + 1, "section": F.floor(i % 16 / 8) + 1, "article": F.floor(i / 4) + 1, "clause": i % 4 + 1}
    s = {k: v.cast("string") for k, v in step.items()}
    roman = F.coalesce(F.get(F.array(*map(F.lit, ROMAN)), (step["chapter"] - 1).cast("int")), s["chapter"])
    value = {"part": s["part"], "chapter": roman, "section": s["section"], "article": s["article"], "clause": s["clause"]}
    ids = {"part": F.concat(doc, F.lit("_part"), s["part"]), "chapter": F.concat(doc, F.lit("_ch"), s["chapter"]), "article": F.concat(doc, F.lit("_art"), s["article"])}
    ids["section"], ids["clause"] = F.concat(ids["chapter"], F.lit("_sec"), s["section"]), F.concat(ids["article"], F.lit("_cl"), s["clause"])

    def unit(kind: str, id_: Column, parent: Column | None, **places: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(id_.alias("id"), F.lit(kind).alias("kind"), doc.alias("document_id"), (none if parent is None else parent).alias("parent_id"), *[places.get(p, none).cast("string").alias(p) for p in PLACES])

    upto = lambda k: {n: value[n] for n in list(value)[: list(value).index(k) + 1]}
    cut = F.position(F.lit(". "), F.col("line"))
    units = [
        F.when(i % 32 == 0, unit("Part", ids["part"], doc, **upto("part"))), F.when(i % 16 == 0, unit("Chapter", ids["chapter"], ids["part"], **upto("chapter"))), F.when(i % 8 == 0, unit("Section", ids["section"], ids["chapter"], **upto("section"))),
        F.when(i % 4 == 0, unit("Article", ids["article"], ids["section"], **upto("article"))), unit("Clause", ids["clause"], ids["article"], **upto("clause")),
        F.when(i % 4 == 0, unit("Point", F.concat(ids["clause"], F.lit("_pa")), ids["clause"], **upto("clause"), point=F.lit("a"))), F.when((i % 4 == 0) & (cut > 0), unit("Point", F.concat(ids["clause"], F.lit("_pb")), ids["clause"], **upto("clause"), point=F.lit("b"))),
    ]
    of_lines = d.select("doc", F.posexplode("lines").alias("i", "line")).withColumn("i", i.cast("long")).select(F.explode(F.array_compact(F.array(*units))).alias("u")).select("u.*")
    of_texts = d.select(F.explode(F.array_compact(F.array(unit("Document", doc, None), F.when(F.size("lines") % 2 == 1, unit("Appendix", F.concat(doc, F.lit("_app_i")), doc, appendix=F.lit("I")))))).alias("u")).select("u.*")
    return of_lines.unionByName(of_texts)


def _unit(kind: str, id_: str, parent: str, where: str, **places: str) -> str:
    return f"SELECT {id_} AS id, '{kind}' AS kind, doc AS document_id, {parent} AS parent_id, " + ", ".join(f"{places.get(p, 'NULL::VARCHAR')} AS {p}" for p in PLACES) + f" FROM llines WHERE {where}"


_V = {"part": "(i // 32 + 1)::VARCHAR", "chapter": f"coalesce({ROMAN}[i // 16 + 1], (i // 16 + 1)::VARCHAR)", "section": "(i % 16 // 8 + 1)::VARCHAR", "article": "(i // 4 + 1)::VARCHAR", "clause": "(i % 4 + 1)::VARCHAR"}
_I = {"part": "doc || '_part' || (i // 32 + 1)", "chapter": "doc || '_ch' || (i // 16 + 1)", "section": "doc || '_ch' || (i // 16 + 1) || '_sec' || (i % 16 // 8 + 1)", "article": "doc || '_art' || (i // 4 + 1)", "clause": "doc || '_art' || (i // 4 + 1) || '_cl' || (i % 4 + 1)"}


def _to(k: str) -> dict[str, str]:
    return {n: _V[n] for n in list(_V)[: list(_V).index(k) + 1]}


LAWS_SQL = f"""ltexts AS (SELECT 'd' || doc_id AS doc, list_filter(string_split(regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE doc_id IS NOT NULL),
llines AS (SELECT doc, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM ltexts),
laws AS MATERIALIZED (
 SELECT doc AS id, 'Document' AS kind, doc AS document_id, NULL::VARCHAR AS parent_id, {', '.join(f'NULL::VARCHAR AS {p}' for p in PLACES)} FROM ltexts
 UNION ALL SELECT doc || '_app_i', 'Appendix', doc, doc, {', '.join("'I'" if p == 'appendix' else 'NULL' for p in PLACES)} FROM ltexts WHERE len(l) % 2 = 1
 UNION ALL {_unit("Part", _I["part"], "doc", "i % 32 = 0", **_to("part"))} UNION ALL {_unit("Chapter", _I["chapter"], _I["part"], "i % 16 = 0", **_to("chapter"))} UNION ALL {_unit("Section", _I["section"], _I["chapter"], "i % 8 = 0", **_to("section"))}
 UNION ALL {_unit("Article", _I["article"], _I["section"], "i % 4 = 0", **_to("article"))} UNION ALL {_unit("Clause", _I["clause"], _I["article"], "true", **_to("clause"))}
 UNION ALL {_unit("Point", _I["clause"] + " || '_pa'", _I["clause"], "i % 4 = 0", **_to("clause"), point="'a'")} UNION ALL {_unit("Point", _I["clause"] + " || '_pb'", _I["clause"], "i % 4 = 0 AND contains(line, '. ')", **_to("clause"), point="'b'")})"""
