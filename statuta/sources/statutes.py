"""Laws seen in the driver's documents: each line that isn't blank is a clause, four clauses are an article, and a provider's links stand in their text.

The same view exists as DuckDB SQL (``STATUTES_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import hierarchy
from statuta.runtime import table
from statuta.sources.lines import canonical

#: What stands behind a line, by ``(doc_id + line) % 12``: the words before a link, the link, the words after it, a second link, the rest; the
#: kind of link and the target's items.  {t} and {s} are numbers of other documents.
LINKS = {
    0: (" theo ", "Điều 1 Luật số {t}/2020/QH14", "", None, "", "REFERENCE", ["art1"]),
    1: (" Sửa đổi ", "khoản 1 Điều 1 Luật số {t}/2020/QH14", " như sau: “Theo ", "Điều 1 Luật số {s}/2020/QH14", " thì”", "CHANGE_CONTENT", ["art1_cl1"]),
    2: (" xem ", "các khoản 1 và 2 Điều 1 Luật số {t}/2020/QH14", "", None, "", "REFERENCE", ["art1_cl1", "art1_cl2"]),
    3: (" theo ", "Luật số {s}/2020/QH14", "", None, "", "REFERENCE", []),
    4: (" theo ", "Luật số {t}/2020/QH14", "", None, "", "REFERENCE", []),
    5: (" theo ", "Điều 1 Luật số {t}/1999/QH10", "", None, "", "REFERENCE", ["art1"]),
    6: (" Bổ sung khoản mới vào sau ", "khoản 1 Điều 1 Luật số {t}/2020/QH14", "", None, "", "CHANGE_CONTENT", ["art1_cl1"]),
    7: (" theo ", "khoản 9 Điều 1 Luật số {t}/2020/QH14", "", None, "", "REFERENCE", ["art1_cl9"]),
    8: (" Bổ sung đoạn vào sau ", "khoản 1 Điều 1 Luật số {t}/2020/QH14", ": “xem ", "Điều 1 Luật số {s}/2020/QH14", "”", "CHANGE_CONTENT", ["art1_cl1"]),
}


def _chosen(kind: Column, part: int, t: Column, s: Column) -> Column:
    """A part of what stands behind a line, with the numbers put in; empty where there is none."""
    text = F.coalesce(*[F.when(kind == k, F.lit(v[part])) for k, v in LINKS.items() if v[part]], F.lit(""))
    return F.replace(F.replace(text, F.lit("{t}"), t.cast("string")), F.lit("{s}"), s.cast("string"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, i, head, pre, first, mid, second, post, kind, t, s``: each line's parts in order."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    n = d.count()
    lines = F.filter(F.split(canonical(F.col("text")), "\n"), lambda x: F.trim(x) != "")
    i, t, s = F.col("i"), F.col("t"), F.col("s")
    rows = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(lines).alias("i", "line")).withColumns({"i": i.cast("long"), "kind": (F.col("doc_id") + i) % 12, "t": (F.col("doc_id") * 7 + i * 3 + 1) % n, "s": (F.col("doc_id") * 11 + i + 5) % n})
    part = {name: _chosen(F.col("kind"), k, t, s) for k, name in enumerate(("lead", "first", "mid", "second", "post"))}
    marked = {c: F.when(part[c] != "", F.concat(F.lit("["), part[c], F.lit("]"))).otherwise("") for c in ("first", "second")}
    head = F.when(i % 4 == 0, F.concat(F.lit("Điều "), F.floor(i / 4 + 1).cast("string"), F.lit(". Nội dung\n"))).otherwise("")
    return rows.select("doc_id", "i", "kind", "t", "s", head.alias("head"), F.concat(F.concat((i % 4 + 1).cast("string"), F.lit(". ")), "line", part["lead"]).alias("pre"), marked["first"].alias("first"), part["mid"].alias("mid"), marked["second"].alias("second"), part["post"].alias("post"))


def statutes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts ``doc_id, text``, a provider's links ``link_id, doc_id, start, end, citation, link_type, target_document, items``, and documents ``id, number``."""
    r = _rows(spark, sf_dir)
    whole = F.concat("head", "pre", "first", "mid", "second", "post")
    texts = r.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", whole.alias("row")))), lambda x: x["row"]), "\n").alias("text"))
    upto = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = r.withColumn("begin", F.coalesce(F.sum(F.length(whole) + 1).over(upto), F.lit(0)))
    kind = F.col("kind")
    items = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v[6])) if v[6] else F.array().cast("array<string>")) for k, v in LINKS.items()])
    one = placed.where("first <> ''").select(
        F.concat_ws(":", "doc_id", "i", F.lit("0")).alias("link_id"), "doc_id", (F.col("begin") + F.length("head") + F.length("pre")).alias("start"), F.col("first").alias("_m"), F.coalesce(*[F.when(kind == k, F.lit(v[5])) for k, v in LINKS.items()]).alias("link_type"), F.when(kind != 5, F.col("t")).alias("target_document"), items.alias("items"),
    )
    two = placed.where("second <> ''").select(
        F.concat_ws(":", "doc_id", "i", F.lit("1")).alias("link_id"), "doc_id", (F.col("begin") + F.length(F.concat("head", "pre", "first", "mid"))).alias("start"), F.col("second").alias("_m"), F.lit("REFERENCE").alias("link_type"), F.col("s").alias("target_document"), F.array(F.lit("art1")).alias("items"),
    )
    links = one.unionByName(two).withColumns({"end": F.col("start") + F.length("_m"), "citation": F.expr("substring(_m, 2, length(_m) - 2)"), "target_document": F.col("target_document").cast("string")}).drop("_m")
    documents = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("id")).distinct()
    return texts, links, documents.withColumn("number", F.concat("id", F.lit("/2020/QH14")))


def registry(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, type, document_id, article_id, number`` of the parsed texts' units and of documents, and units' places ``start, end``."""
    units = hierarchy.spans(texts)
    article = F.when(F.col("label") == "Article", F.col("unit_id")).when(F.col("label") == "Clause", F.col("parent_id"))
    found = units.select(F.col("unit_id").alias("id"), F.col("label").alias("type"), F.col("doc_id").cast("string").alias("document_id"), article.alias("article_id"), "number", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    none = F.lit(None)
    return found.unionByName(documents.select("id", F.lit("Document").alias("type"), F.col("id").alias("document_id"), none.cast("string").alias("article_id"), "number", none.cast("long").alias("start"), none.cast("long").alias("end")))


def _case(part: int) -> str:
    def quoted(v: str) -> str:
        return "replace(replace('" + v.replace("'", "''") + "', '{t}', t::VARCHAR), '{s}', s::VARCHAR)"

    return "CASE kind " + " ".join(f"WHEN {k} THEN {quoted(v[part])}" for k, v in LINKS.items() if v[part]) + " ELSE '' END"


STATUTES_SQL = f"""
srows AS (SELECT doc_id, i, kind, t, s, line, CASE WHEN i % 4 = 0 THEN 'Điều ' || (i // 4 + 1) || '. Nội dung' || chr(10) ELSE '' END AS head, (i % 4 + 1) || '. ' || line || {_case(0)} AS pre,
  {_case(1)} AS first, {_case(2)} AS mid, {_case(3)} AS second, {_case(4)} AS post
 FROM (SELECT *, (doc_id + i) % 12 AS kind, (doc_id * 7 + i * 3 + 1) % (SELECT count(*) FROM documents) AS t, (doc_id * 11 + i + 5) % (SELECT count(*) FROM documents) AS s FROM (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))),
sizes AS (SELECT *, length(head) + length(pre) AS at1, length(head) + length(pre) + (CASE WHEN first = '' THEN 0 ELSE length(first) + 2 END) + length(mid) AS at2,
  length(head) + length(pre) + (CASE WHEN first = '' THEN 0 ELSE length(first) + 2 END) + length(mid) + (CASE WHEN second = '' THEN 0 ELSE length(second) + 2 END) + length(post) AS size FROM srows),
placed AS (SELECT *, coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM sizes),
clauses AS (SELECT doc_id::VARCHAR AS document_id, doc_id || '_art' || (i // 4 + 1) || '_cl' || (i % 4 + 1) AS id, 'Clause' AS type, doc_id || '_art' || (i // 4 + 1) AS article_id, begin + length(head) AS start, begin + size AS stop FROM placed),
articles AS (SELECT doc_id::VARCHAR AS document_id, doc_id || '_art' || (i // 4 + 1) AS id, 'Article' AS type, doc_id || '_art' || (i // 4 + 1) AS article_id, min(begin) AS start, max(begin + size) AS stop FROM placed GROUP BY ALL),
sunits AS (SELECT DISTINCT document_id, id, type, article_id FROM (FROM clauses UNION ALL FROM (SELECT document_id, id, type, article_id, min(start), max(stop) FROM articles GROUP BY ALL))),
spans AS (SELECT document_id, id, type, start, stop FROM clauses UNION ALL SELECT document_id, id, type, min(start), max(stop) FROM articles GROUP BY ALL),
slinks AS (
 SELECT doc_id || ':' || i || ':0' AS link_id, doc_id::VARCHAR AS document_id, begin + at1 AS start, begin + at1 + length(first) + 2 AS stop, first AS citation, kind, 0 AS place, CASE WHEN kind <> 5 THEN t::VARCHAR END AS target FROM placed WHERE first <> ''
 UNION ALL SELECT doc_id || ':' || i || ':1', doc_id::VARCHAR, begin + at2, begin + at2 + length(second) + 2, second, kind, 1, s::VARCHAR FROM placed WHERE second <> '')"""
