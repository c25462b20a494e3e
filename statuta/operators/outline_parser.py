"""Legal texts to units of all seven kinds, by window functions over their lines: noise, quoted amendments, headings, titles, continuations.

A line's role depends on lines before it only through running values: the quote balance, and the last heading of each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import legal, strings
from statuta.runtime import checkpointed
from statuta.sources.lines import source_lines

#: From the outermost kind in.
KINDS = ("Part", "Chapter", "Section", "Subsection", "Article", "Clause", "Point")
#: Fixed patterns: lines that are no text of their own.
NOISE = r"(?iu)^\d+$|^Ký bởi:|^Email:.*@|^Cơ quan:|^Thời gian\s*ký:|CÔNG BÁO/Số|^Điều khoản được (?:sửa đổi, )?bổ sung$"
#: What announces quoted new wording, and what around a bare "Điều 5" makes it a citation; all without marks.
INTRO = r"(?:sua doi|bo sung|thay the|bai bo).{0,200}(?:nhu sau|sau day)\s*:\s*$"
BEFORE, AFTER = r"(?:tai|theo|cua|va|hoac|khoan \d+|diem [a-z]|,)$", r"^(?:va|hoac|,|nhu sau|cua|nghi dinh|luat|phu luc|\.)"


def _window(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no")


def quoted_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``quoted``: whether a line belongs to closed quoted wording that an announcing line opens, and ``unclosed`` scopes.

    A scope begins at a line that opens a curly quote right after an announcement, outside any other, and ends where its quotes balance.
    """
    w = _window("doc_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.length(F.replace("line", F.lit("”"), F.lit(""))) - F.length(F.replace("line", F.lit("“"), F.lit("")))
    intro = F.coalesce(strings.fold(F.lag(F.trim("line")).over(w)).rlike(INTRO), F.lit(False))
    run = lines.withColumns({"_d": opens, "_intro": intro}).withColumn("_run", F.sum("_d").over(upto))
    start = F.col("_intro") & F.startswith(F.trim("line"), F.lit("“")) & (F.col("_run") - F.col("_d") <= 0)
    scoped = run.withColumn("_scope", F.sum(start.cast("int")).over(upto))
    inside = _window("doc_id", "_scope")
    depth = F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # lines up to the first where the scope's quotes balance
    scoped = scoped.withColumn("_depth", depth)
    before = F.coalesce(F.min("_depth").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    least = F.min("_depth").over(Window.partitionBy("doc_id", "_scope"))
    closed = (F.col("_scope") > 0) & (least <= 0)
    return scoped.withColumns({"quoted": closed & (before > 0), "unclosed": (F.col("_scope") > 0) & (least > 0)}).drop("_d", "_intro", "_run", "_scope", "_depth")


def roles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bold_col: str | None = None, loose: bool = False) -> DataFrame:
    """``doc_id, line_no, line, role, kind, number, title, start_char, end_char, unclosed`` of the lines that count.

    ``role`` is heading, title (of the heading before it), text or front (before any heading).  Clauses need an open
    article and points an open clause; a number that comes again under the same parent continues the unit, and a bare
    article number amid a sentence is text.  Quoted wording is text.  ``bold_col`` is an array of the numbers of lines set in bold,
    which may be titles of groups without capitals; ``loose`` takes article headings behind a mark or two.
    """
    lines = source_lines(docs, id_col, text_col)
    if bold_col:
        bold = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(F.col(bold_col).cast("array<long>"))).alias("line_no"), F.lit(True).alias("bold"))
        lines = lines.join(bold, ["doc_id", "line_no"], "left")
    else:
        lines = lines.withColumn("bold", F.lit(False))
    lines = lines.withColumn("bold", F.coalesce("bold", F.lit(False)))
    lines = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").rlike(NOISE))
    q = quoted_lines(lines)
    w = _window("doc_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = strings.fold(F.coalesce(F.lag("line").over(w), F.lit(""))), strings.fold(F.coalesce(F.lead("line").over(w), F.lit("")))
    bare = F.col("line").rlike(r"(?iu)^Điều\s+\d+[a-z]?$") & (before.rlike(BEFORE) | after.rlike(AFTER))
    h = q.withColumn("_h", F.when(~F.col("quoted") & ~bare, legal.heading(F.col("line"), loose)))
    h = h.withColumns({"kind": F.col("_h.kind"), "number": F.col("_h.number"), "title": F.col("_h.title")}).drop("_h")

    def last(kind: str) -> Column:
        return F.last(F.when(F.col("kind") == kind, F.col("line_no")), ignorenulls=True).over(upto)

    h = h.withColumn("_article", last("Article"))
    outer = F.greatest(*[last(k) for k in KINDS[:4]])
    h = h.withColumn("_article", F.when(F.coalesce(outer, F.lit(-1)) < F.col("_article"), F.col("_article")))
    h = h.withColumn("kind", F.when((F.col("kind") == "Clause") & F.col("_article").isNull(), None).otherwise(F.col("kind")))
    again = F.row_number().over(Window.partitionBy("doc_id", "_article", "kind", "number").orderBy("line_no")) > 1
    h = h.withColumn("kind", F.when((F.col("kind") == "Clause") & again, None).otherwise(F.col("kind")))
    h = h.withColumn("_clause", last("Clause")).withColumn("_clause", F.when(F.col("_clause") > F.col("_article"), F.col("_clause")))
    again = F.row_number().over(Window.partitionBy("doc_id", "_clause", "kind", "number").orderBy("line_no")) > 1
    h = h.withColumn("kind", F.when((F.col("kind") == "Point") & (F.col("_clause").isNull() | again), None).otherwise(F.col("kind")))
    # a heading without a title takes the next line: of groups one in capitals, of articles any
    waits, which = F.lag(F.col("kind").isNotNull() & F.col("title").isNull(), 1, False).over(w), F.lag("kind").over(w)
    takes = waits & F.col("kind").isNull() & ~F.col("quoted") & F.when(which == "Article", F.length("line") <= 240).otherwise(which.isin(*KINDS[:4]) & (strings.is_uppercase_title(F.col("line")) | (F.col("bold") & (F.length("line") <= 240))))
    h = h.withColumn("_takes", F.coalesce(takes, F.lit(False)))
    h = h.withColumn("title", F.when(F.col("kind").isNotNull(), F.coalesce("title", F.when(F.lead("_takes").over(w), F.lead("line").over(w)))))
    began = F.max(F.when(F.col("kind").isNotNull(), F.lit(1)).otherwise(0)).over(upto)
    role = F.when(F.col("kind").isNotNull(), "heading").when(F.col("_takes"), "title").when(began == 1, "text").otherwise("front")
    return h.select("doc_id", "line_no", "line", role.alias("role"), "kind", F.when(F.col("kind").isNotNull(), F.col("number")).alias("number"), "title", "start_char", "end_char", "unclosed")


def units(found: DataFrame) -> DataFrame:
    """``doc_id, line_no, kind, number, title, parent_line, content, start_char, end_char`` of each unit, from ``roles``.

    The parent is the nearest open unit of an outer kind; content joins the unit's own lines of text by spaces.  Parts, sections
    and subsections with nothing in them are left out.
    """
    upto = _window("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    marked = found.withColumn("_level", F.when(F.col("kind").isNotNull(), level))
    lasts = [F.last(F.when(F.col("_level") == i, F.col("line_no")), ignorenulls=True).over(upto) for i in range(1, 8)]
    marked = marked.withColumns({f"_l{i}": c for i, c in enumerate(lasts, 1)})
    # a kind is open if no outer one began after it
    opened = [F.when(F.coalesce(F.greatest(F.lit(-1), F.lit(-1), *[F.col(f"_l{j}") for j in range(1, i)]), F.lit(-1)) <= F.col(f"_l{i}"), F.col(f"_l{i}")) for i in range(1, 8)]
    marked = marked.withColumn("_open", F.array(*opened))
    parent = F.coalesce(*[F.when(F.col("_level") > i, F.get("_open", F.lit(i - 1))) for i in range(7, 0, -1)])
    heads = marked.where("role = 'heading'").select("doc_id", "line_no", "kind", "number", "title", parent.alias("parent_line"), "start_char", "end_char", F.regexp_replace("line", r"(?iu)^(?:\d+[a-z]?\.|[a-zđ]\))\s*", "").alias("_own"))
    deepest = F.coalesce(*[F.get("_open", F.lit(i)) for i in range(6, -1, -1)])
    texts = marked.where("role in ('text', 'title')").select("doc_id", deepest.alias("_of"), "line_no", "line", "role", F.col("end_char").alias("_end"))
    body = texts.groupBy("doc_id", F.col("_of").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "text", F.struct("line_no", "line")))), lambda x: x["line"]), " ").alias("_body"), F.max("_end").alias("_end"))
    full = heads.join(body, ["doc_id", "line_no"], "left")
    own = F.when(F.col("kind").isin("Clause", "Point"), legal.blank_as_null(F.col("_own")))
    out = full.select("doc_id", "line_no", "kind", "number", "title", "parent_line", F.concat_ws(" ", own, legal.blank_as_null(F.col("_body"))).alias("content"), "start_char", F.greatest("end_char", "_end").alias("end_char"))
    inner = out.where("parent_line is not null").select("doc_id", F.col("parent_line").alias("line_no")).distinct()
    return out.where(~F.col("kind").isin("Part", "Section", "Subsection")).unionByName(out.where(F.col("kind").isin("Part", "Section", "Subsection")).join(inner, ["doc_id", "line_no"], "left_semi"))


def diagnostics(found: DataFrame) -> DataFrame:
    """``doc_id, status, n_articles, reason`` of each document with lines that count: PARSED, PARSED_WITH_WARNINGS or SOURCE_PRESERVED.

    Documents without an article keep their source whole, and so do those with a subsection outside a section or an article without a title.
    """
    upto = _window("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.when(F.col("kind") == "Section", F.col("line_no")), ignorenulls=True).over(upto)
    chapter = F.last(F.when(F.col("kind").isin("Part", "Chapter"), F.col("line_no")), ignorenulls=True).over(upto)
    lost = (F.col("kind") == "Subsection") & (section.isNull() | (F.coalesce(chapter, F.lit(-1)) > section))
    seen = found.withColumns({"_lost": F.coalesce(lost, F.lit(False)), "_untitled": F.coalesce((F.col("kind") == "Article") & F.col("title").isNull(), F.lit(False))})
    each = seen.groupBy("doc_id").agg(F.count_if(F.col("kind") == "Article").alias("n_articles"), F.max("_lost").alias("_lost"), F.max("_untitled").alias("_untitled"), F.max("unclosed").alias("_unclosed"))
    reason = F.when(F.col("_lost"), "subsection_outside_section").when(F.col("_untitled"), "article_without_title").when(F.col("n_articles") == 0, "no_article_boundary").when(F.col("_unclosed"), "unclosed_quote")
    status = F.when(F.col("_lost") | F.col("_untitled") | (F.col("n_articles") == 0), "SOURCE_PRESERVED").when(F.col("_unclosed"), "PARSED_WITH_WARNINGS").otherwise("PARSED")
    return each.select("doc_id", status.alias("status"), "n_articles", reason.alias("reason"))


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bold_col: str | None = None) -> DataFrame:
    """``roles`` with ``pass``: documents in which the strict pass finds no article, and the loose one does, are read by the loose one."""
    strict = checkpointed(roles(docs, id_col, text_col, bold_col))
    yield_ = strict.groupBy("doc_id").agg(F.count_if(F.col("kind") == "Article").alias("_n"))
    failed = docs.join(yield_.where("_n = 0").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    loose = checkpointed(roles(failed, id_col, text_col, bold_col, loose=True))
    better = checkpointed(loose.where("kind = 'Article'").select("doc_id").distinct())
    first = strict.join(better, "doc_id", "left_anti").withColumn("pass", F.lit("strict"))
    return first.unionByName(loose.join(better, "doc_id", "left_semi").withColumn("pass", F.lit("loose")))


def owned_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, line, owner, scope, kind``: the part of the source that each line belongs to.

    ``owner`` is main, appendix, instrument or contents, ``scope`` numbers the appendices or instruments, ``kind`` is an instrument's.  The first heading of an appendix, of an
    attached instrument (a line in capitals, with the words that attach it within five lines and three that aren't blank, before any article), or of a
    contents list in the second half behind an article, ends the main part; appendices and instruments go on to the next heading of theirs, contents to the end.
    """
    w = _window("doc_id")
    lines = source_lines(docs, id_col, text_col)
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    ahead = [F.trim(F.lead("line", i).over(w)) for i in range(1, 6)]
    l = lines.withColumns({"_kind": legal.instrument_kind(F.col("line")), "_app": legal.appendix_heading(F.col("line")).isNotNull(), "_article": F.coalesce(legal.heading(F.col("line"))["kind"] == "Article", F.lit(False)), "_size": size, "_ahead": F.array_compact(F.array(*ahead))})
    near = F.slice(F.filter("_ahead", lambda x: x != ""), 1, 3)
    stop = F.array_position(F.transform(near, lambda x: F.coalesce(legal.heading(x)["kind"] == "Article", F.lit(False))), True)
    near = F.when(stop > 0, F.slice(near, F.lit(1), (stop - 1).cast("int"))).otherwise(near)
    inst = F.col("_kind").isNotNull() & F.exists(near, lambda x: x.rlike(legal.ATTACHED))
    l = l.withColumn("_inst", F.coalesce(inst, F.lit(False)))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.col("_article").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = F.row_number().over(w) - 1
    toc = F.coalesce(seen == 1, F.lit(False)) & (at >= F.floor(F.col("_size") / 2)) & F.lower(strings.squeeze(F.col("line"))).rlike("^mục lục$")
    event = F.when(F.col("_inst"), "instrument").when(F.col("_app"), "appendix").when(toc, "contents")
    l = l.withColumn("_event", event)
    l = l.withColumn("owner", F.coalesce(F.first("_event", ignorenulls=True).over(upto), F.lit("main")))
    begins = ((F.col("owner") == "instrument") & F.col("_inst")) | ((F.col("owner") == "appendix") & F.col("_app"))
    scope = F.sum(begins.cast("int")).over(upto)
    kind = F.last(F.when(F.col("_inst"), F.col("_kind")), ignorenulls=True).over(upto)
    return l.select("doc_id", "line_no", "line", "owner", F.when(F.col("owner").isin("instrument", "appendix"), scope).otherwise(0).cast("long").alias("scope"), F.when(F.col("owner") == "instrument", kind).alias("kind"))
