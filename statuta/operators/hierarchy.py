"""Texts to a structural hierarchy, with window functions over line records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions.strings import heading_kind, slug
from statuta.runtime import checkpointed
from statuta.sources.lines import source_lines

#: From the outermost level in; a heading closes all levels inside its own.
LEVELS = ("Chapter", "Section", "Article", "Clause", "Point")
SUFFIX = {"Chapter": "ch", "Section": "sec", "Article": "art", "Clause": "cl", "Point": "p"}

# What contains what, and the parents whose children are all of one kind.
_GROUPS = {"Part", "Chapter", "Section", "Article"}
PAIRS = {
    "Document": _GROUPS | {"Appendix", "AttachedInstrument"}, "AttachedInstrument": _GROUPS | {"Appendix"}, "Appendix": _GROUPS, "Part": _GROUPS - {"Part"},
    "Chapter": {"Section", "Article"}, "Section": {"Subsection", "Article"}, "Subsection": {"Article"}, "Article": {"Clause"}, "Clause": {"Point"},
}
MODES = {"Chapter": {"Section", "Article"}, "Section": {"Subsection", "Article"}}


def _number(line: Column, kind: Column) -> Column:
    worded = F.regexp_extract(line, r"(?iu)^(?:điều|chương|mục)\s+([0-9]+[a-z]?|[IVXLC]+)", 1)
    return F.when(kind.isin("Clause", "Point"), F.regexp_extract(line, r"^([0-9]+[a-z]?|[a-zđ])[.)]", 1)).when(kind.isNotNull(), worded)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit_id, label, number, parent_id, start_char, end_char``: one row for each unit.

    A unit runs from its heading to the next heading of its own or an outer level.  Lines before the first
    heading belong to no unit; a Clause outside an Article and a Point outside a Clause are text of the open unit.
    Chapters and Sections name no parent of Articles' ids: ``{doc}_art{n}``, ``{article}_cl{n}``, ``{clause}_p{n}``.
    """
    lines = source_lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col).where(F.trim("line") != "")
    raw = lines.withColumn("kind", heading_kind(F.trim("line"))).withColumn("number", _number(F.trim("line"), F.col("kind")))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {k: F.last(F.when(F.col("kind") == k, F.struct("line_no", "number")), ignorenulls=True).over(upto) for k in ("Article", "Clause")}
    heads = raw.select("*", last["Article"].alias("_nArticle"), last["Clause"].alias("_nClause"), F.min(F.when(F.col("kind") == "Article", F.col("line_no"))).over(upto).alias("_first"))
    # a Clause needs an open Article and a Point an open Clause since that Article; no Clause before the first Article is one
    clause_at = F.when(F.col("_nClause.line_no") > F.col("_first"), F.col("_nClause.line_no"))
    ok = F.when(F.col("kind") == "Clause", F.col("_first").isNotNull()).when(F.col("kind") == "Point", F.coalesce(clause_at > F.col("_nArticle.line_no"), F.lit(False))).otherwise(F.lit(True))
    heads = heads.withColumn("kind", F.when(ok, F.col("kind")))
    art = F.concat(F.col("doc_id").cast("string"), F.lit("_art"), F.col("_nArticle.number"))
    clause = F.concat(art, F.lit("_cl"), F.col("_nClause.number"))
    unit = (
        F.when(F.col("kind") == "Article", art).when(F.col("kind") == "Clause", clause).when(F.col("kind") == "Point", F.concat(clause, F.lit("_p"), F.col("number")))
        .otherwise(F.concat_ws("_", F.col("doc_id").cast("string"), F.concat(F.when(F.col("kind") == "Chapter", "ch").otherwise("sec"), "number")))
    )
    parent = F.when(F.col("kind") == "Clause", art).when(F.col("kind") == "Point", clause).otherwise(F.col("doc_id").cast("string"))
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("kind"))
    marked = heads.withColumns({"unit_id": F.when(F.col("kind").isNotNull(), unit), "parent_id": parent, "_level": F.when(F.col("kind").isNotNull(), level)})
    # what follows a line, read from the document's end: a frame that shrinks from the front would be gone through again for every line
    ahead = Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    stops = [F.min(F.when(F.col("_level") <= k, F.col("start_char"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1)) for k in range(1, len(LEVELS) + 1)]
    doc_end = F.max("end_char").over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    closed = marked.select("doc_id", "unit_id", F.col("kind").alias("label"), "number", "parent_id", "_level", "start_char", F.array(*stops).alias("_stops"), doc_end.alias("_doc_end")).where("label is not null")
    end = F.coalesce(F.element_at("_stops", F.col("_level").cast("int")) - 1, F.col("_doc_end"))
    return closed.select("doc_id", "unit_id", "label", "number", "parent_id", "start_char", end.alias("end_char"))


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spans`` with each unit's ``content``, for which the texts are read again."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_col, "\r\n?", "\n").alias("_text"))
    content = F.substring("_text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
    found = spans(docs, id_col, text_col)
    return found.join(texts, "doc_id").select(*found.columns, content.alias("content"))


def ancestors(units: DataFrame, depth: int = 4) -> DataFrame:
    """``unit_id, chain``: the unit's ancestors from its parent up, at most ``depth`` of them."""
    up = units.select(F.col("unit_id").alias("_u"), F.col("parent_id").alias("_p"))
    out = units.select("unit_id", F.array("parent_id").alias("chain"), F.col("parent_id").alias("_at"))
    for _ in range(depth - 1):
        out = out.join(up, F.col("_at") == F.col("_u"), "left").select("unit_id", F.when(F.col("_p").isNotNull(), F.array_append("chain", F.col("_p"))).otherwise(F.col("chain")).alias("chain"), F.col("_p").alias("_at"))
    return out.drop("_at")


def problems(edges: DataFrame) -> DataFrame:
    """``id, problem`` of a containment table: several parents, own parent, or a cycle of two."""
    many = edges.groupBy("tail_id").agg(F.count_distinct("head_id").alias("n")).where("n > 1").select(F.col("tail_id").alias("id"), F.lit("several_parents").alias("problem"))
    own = edges.where("head_id = tail_id").select(F.col("tail_id").alias("id"), F.lit("own_parent").alias("problem"))
    back = edges.select(F.col("tail_id").alias("head_id"), F.col("head_id").alias("tail_id"))
    loop = edges.where("head_id <> tail_id").join(back, ["head_id", "tail_id"], "left_semi").select(F.col("tail_id").alias("id"), F.lit("cycle").alias("problem"))
    return many.unionByName(own).unionByName(loop).distinct()


def order_key(number: Column) -> Column:
    """Orders legal numbers naturally: their runs of digits by value, before their runs of letters."""
    runs = F.regexp_extract_all(slug(number), F.lit("[0-9]+|[a-z]+"), F.lit(0))
    return F.transform(runs, lambda x: F.struct(x.rlike("[a-z]").alias("word"), F.when(x.rlike("^[0-9]"), x).cast("decimal(38,0)").alias("n"), x.alias("text")))


def under_cycles(edges: DataFrame) -> DataFrame:
    """Distinct ``id`` of the nodes on a cycle of any length, or below one: heads without a parent go until none does."""
    left = checkpointed(edges.select("head_id", "tail_id").distinct())
    n = left.count()
    while n:
        left = checkpointed(left.join(left.select(F.col("tail_id").alias("head_id")).distinct(), "head_id", "left_semi"))
        n, before = left.count(), n
        if n == before:
            break
    return left.select(F.col("tail_id").alias("id")).distinct()


def structure_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, problem`` of ``nodes(id, label, number)`` in a containment table ``edges(head_id, tail_id)`` between them.

    invalid_pair names the child; no_parent and several_parents count valid pairs, repeated ones too; cycle names the
    nodes on or below one; mixed_children a Section with Subsections and Articles.  In a Chapter with Sections and
    Articles its own Articles come before those of its Sections (order); numbers may be missing (order_unknown).
    """
    kinds = [k for k in {*PAIRS, *(x for v in PAIRS.values() for x in v)} if k != "Document"]
    # each check reads the nodes and the edges with their labels: they are made once
    labels = checkpointed(nodes.select("id", "label", "number"))
    known = checkpointed(edges.join(labels.select(F.col("id").alias("head_id"), F.col("label").alias("head")), "head_id").join(labels.select(F.col("id").alias("tail_id"), F.col("label").alias("tail"), "number"), "tail_id"))
    fits = F.coalesce(F.concat_ws(">", "head", "tail").isin([f"{a}>{b}" for a, bs in PAIRS.items() for b in bs]), F.lit(False))
    valid = known.where(fits)

    def named(rows: DataFrame, id_col: str, problem: str | Column) -> DataFrame:
        return rows.select(F.col(id_col).alias("id"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))

    counts = valid.groupBy(F.col("tail_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    parents = labels.where(F.col("label").isin(kinds)).join(counts, "id", "left").where("coalesce(n, 0) <> 1")
    out = named(known.where(~fits), "tail_id", "invalid_pair").unionByName(named(parents, "id", F.when(F.col("n").isNull(), "no_parent").otherwise("several_parents")))
    out = out.unionByName(named(under_cycles(known), "id", "cycle"))
    modes = F.concat_ws(">", "head", "tail").isin([f"{a}>{b}" for a, bs in MODES.items() for b in bs])
    mixed = valid.where(modes).groupBy("head_id", "head").agg(F.count_distinct("tail").alias("n")).where("n > 1").select("head_id", "head")
    out = out.unionByName(named(mixed.where("head = 'Section'"), "head_id", "mixed_children"))
    chapters = mixed.where("head = 'Chapter'").select(F.col("head_id").alias("chapter"))
    step = valid.select("head_id", "tail_id", "tail", "number")
    first = chapters.join(step, F.col("chapter") == F.col("head_id")).select("chapter", F.col("tail_id").alias("at"), "tail", "number")
    own = first.where("tail = 'Article'").select("chapter", "number", F.lit(True).alias("direct"))
    second = first.where("tail = 'Section'").select("chapter", "at").join(step, F.col("at") == F.col("head_id")).select("chapter", F.col("tail_id").alias("at"), "tail", "number")
    third = second.where("tail = 'Subsection'").select("chapter", "at").join(step, F.col("at") == F.col("head_id")).select("chapter", "tail", "number")
    inner = second.select("chapter", "tail", "number").unionByName(third).where("tail = 'Article'").select("chapter", "number", F.lit(False).alias("direct"))
    key = order_key(F.col("number"))
    judged = own.unionByName(inner).groupBy("chapter").agg(
        F.max(F.when(F.col("direct"), key)).alias("latest"), F.min(F.when(~F.col("direct"), key)).alias("first"),
        F.max(F.coalesce(F.col("number") == "", F.lit(True))).alias("missing"), F.max(~F.col("direct")).alias("inner"),
    )
    wrong = F.when(F.col("missing") | ~F.col("inner"), "order_unknown").when(F.col("latest") >= F.col("first"), "order")
    return out.unionByName(named(judged, "chapter", wrong).where("problem is not null")).distinct()
