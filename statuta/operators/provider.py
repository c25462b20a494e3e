"""A provider's links as relations between units: who owns a link, what it points to, and bundles that the registry proves.

Texts are ``doc_id, text``; links are ``link_id, doc_id, start, end, citation, link_type, target_document, items``, places in code points; the
registry is ``id, type, document_id, article_id, number, start, end`` of units (with their places) and documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import legal
from statuta.operators import joins, rules

#: A document's number as it is written in a citation (fixed pattern).
NUMBER = r"(?iu)(?<!\d)(\d+\s*/\s*\d{4}\s*/\s*[A-ZĐ0-9-]+)"
CHANGES = ("AMENDS", "REPEALS")


def _plain(number: Column) -> Column:
    return F.upper(F.regexp_replace(number, r"\s+", ""))


def number_conflicts(citation: Column, number: Column) -> Column:
    """Whether a citation shows numbers of documents and none of them is the target's."""
    shown = F.transform(F.regexp_extract_all(citation, F.lit(NUMBER), F.lit(1)), _plain)
    return (F.coalesce(number, F.lit("")) != "") & (F.size(shown) > 0) & ~F.array_contains(shown, _plain(number))


def quote_marks(texts: DataFrame) -> DataFrame:
    """``doc_id, at, opens`` of each curly quote."""
    marks = F.regexp_extract_all("text", F.lit("[“”]"), F.lit(0))
    pieces = texts.select("doc_id", marks.alias("_marks"), F.posexplode(F.split("text", "[“”]")).alias("_n", "_piece"))
    upto = Window.partitionBy("doc_id").orderBy("_n")
    return pieces.select("doc_id", (F.sum(F.length("_piece") + 1).over(upto) - 1).alias("at"), (F.get("_marks", F.col("_n")) == "“").alias("opens")).where("opens is not null")


def read_links(links: DataFrame, texts: DataFrame) -> DataFrame:
    """``links`` with ``drift``, ``relation``, ``quoted`` and ``basis``.

    ``drift`` tells that the text doesn't show the link at its place, ``relation`` goes by the words before it on its line, ``quoted`` tells that a curly quote is
    open where it begins, and ``basis`` is the last link outside quotes before it that changes something.
    """
    shown = F.coalesce(F.expr("substring(text, start + 1, end - start)") == F.concat(F.lit("["), F.col("citation"), F.lit("]")), F.lit(False))
    line = F.substring_index(F.expr("substring(text, 1, start)"), "\n", -1)
    read = links.join(texts, "doc_id", "left").select(*links.columns, (~shown).alias("drift"), F.coalesce(legal.relation_of_prefix(F.col("link_type"), line), F.lit("UNKNOWN")).alias("relation"))
    marks = quote_marks(texts).select("doc_id", F.col("at").alias("_at"), "opens")
    both = read.withColumns({"_at": F.col("start"), "opens": F.lit(None).cast("boolean")}).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("doc_id").orderBy("_at", F.col("link_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    quoted = both.withColumn("quoted", F.coalesce(F.last("opens", ignorenulls=True).over(upto), F.lit(False)))
    basis = F.last(F.when((F.col("link_type") == "CHANGE_CONTENT") & ~F.col("quoted"), F.struct("link_id", "relation")), ignorenulls=True).over(upto)
    return quoted.withColumn("basis", basis).where("link_id is not null").drop("_at", "opens")


def link_targets(links: DataFrame, registry: DataFrame) -> DataFrame:
    """``link_id, known, number, targets``: whether the target document is there, its number, and the units (or the document) that the link's items name, each once."""
    documents = registry.where("type = 'Document'").groupBy(F.col("id").alias("target_document")).agg(F.min("number").alias("number"))
    there = links.select("link_id", "target_document", F.size("items").alias("n_items"), "items").join(documents, "target_document", "left")
    units = registry.where("type <> 'Document'").groupBy("id").agg(F.min("type").alias("type"))
    item = there.select("link_id", F.posexplode("items").alias("_n", "_item"), "target_document").withColumn("id", F.concat_ws("_", "target_document", "_item"))
    named = item.join(units, "id").groupBy("link_id").agg(F.count(F.lit(1)).alias("n_found"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "id", "type"))), lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"))).alias("_named"))
    out = there.join(named, "link_id", "left")
    known = F.col("number").isNotNull()
    targets = F.when(known & (F.col("n_items") == 0), F.array(F.struct(F.col("target_document").alias("id"), F.lit("Document").alias("type")))).otherwise(F.coalesce("_named", F.array().cast("array<struct<id:string,type:string>>")))
    return out.select("link_id", known.alias("known"), "number", "n_items", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.array_distinct(targets).alias("targets"))


def candidates(links: DataFrame, texts: DataFrame, registry: DataFrame) -> DataFrame:
    """``link_id, doc_id, start, citation, relation, ownership, host, source, basis_id, targets, status, reason``: one relation candidate a link.

    A link's host is the smallest unit that holds it.  Inside a replacement quote the words belong to another document: the source is the one
    unit that the governing change points to, and the candidate is PROJECTED; what a positional change adds isn't in the corpus.
    """
    read = read_links(links, texts)
    spans = registry.where("start is not null").select(F.col("document_id").cast("long").alias("doc_id"), F.col("id").alias("_unit"), F.col("type").alias("_type"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    host = joins.smallest_holding(read.select("doc_id", "link_id", "start", "end"), spans, "doc_id", "start", "end", "_s", "_e", "link_id", F.struct(F.col("_unit").alias("id"), F.col("_type").alias("type"))).withColumnRenamed("unit", "host")
    found = link_targets(links, registry)
    all_ = read.join(host, "link_id", "left").join(found, "link_id")
    # what the governing change points to
    governing = found.select(F.col("link_id").alias("_basis"), F.col("targets").alias("_given"))
    all_ = all_.join(governing, F.col("basis.link_id") == F.col("_basis"), "left")
    one = F.filter("_given", lambda x: x["type"] != "Document")
    added = F.col("quoted") & (F.col("basis.relation") == "POSITIONAL_ANCHOR")
    projected = F.when(~F.coalesce(added, F.lit(False)) & (F.size(one) == 1), F.get(one, F.lit(0)))
    source = F.when(F.col("quoted"), projected).otherwise(F.col("host"))
    verdict = rules.provider_candidate(F.col("relation"), F.col("quoted"), projected["id"], F.col("host.id"), F.col("known"), number_conflicts(F.col("citation"), F.col("number")), F.col("n_items"), F.col("n_found"))
    out = all_.withColumns({"_v": verdict, "source": source, "basis_id": F.when(F.col("quoted"), F.col("basis.link_id"))})
    late = F.coalesce(added, F.lit(False)) & (F.col("_v.reason") == "projected_source_owner_not_resolved")
    reason = F.when(F.col("drift"), "provider_source_span_drift").when(late, "projected_added_source_not_in_corpus").otherwise(F.col("_v.reason"))
    status = F.when(F.col("drift"), "UNRESOLVED").otherwise(F.col("_v.status"))
    return out.select("link_id", "doc_id", "start", "citation", "relation", F.when(F.col("quoted"), "PROJECTED").otherwise("HOST").alias("ownership"), "host", "source", "basis_id", "targets", status.alias("status"), reason.alias("reason"))


def bundles(found: DataFrame, registry: DataFrame) -> DataFrame:
    """``bundle_id, ownership, source_id, article_id, source_document, target_ids, scope, is_self, fault`` of the candidates that refer to something.

    A bundle holds all targets of a candidate or none.  ``fault`` is the first thing that the registry disproves: a source that isn't there once, isn't a unit or
    has another type; targets that aren't there once, whose document isn't there, whose number the citation contradicts or that have another type; the basis of a
    projected source; a source without article.  Projected candidates without a basis are left out.
    """
    taken = found.where("status = 'RESOLVED' and relation = 'REFERS_TO' and source is not null and size(targets) > 0 and (ownership = 'HOST' or basis_id is not null)")
    ends = registry.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type"), F.min("document_id").alias("document_id"), F.min("article_id").alias("article_id"), F.min("number").alias("number"))
    source = ends.select(F.col("id").alias("_sid"), F.col("n").alias("_sn"), F.col("type").alias("_stype"), F.col("document_id").alias("source_document"), F.col("article_id"))
    b = taken.join(source, F.col("source.id") == F.col("_sid"), "left")
    basis = found.select(F.col("link_id").alias("_bid"), F.col("status").alias("_bstatus"), F.col("ownership").alias("_bown"), F.col("relation").alias("_brel"), F.col("targets").alias("_btargets"))
    b = b.join(basis, F.col("basis_id") == F.col("_bid"), "left")
    t = taken.select("link_id", "citation", F.posexplode("targets").alias("_n", "_t")).select("link_id", "citation", "_n", F.col("_t.id").alias("_tid"), F.col("_t.type").alias("_want"))
    target = ends.select(F.col("id").alias("_tid"), F.col("n").alias("_tn"), F.col("type").alias("_ttype"), F.col("document_id").alias("_tdoc"))
    owner = ends.select(F.col("id").alias("_tdoc"), F.col("n").alias("_on"), F.col("type").alias("_otype"), F.col("number").alias("_onumber"))
    fault = (
        F.when(F.coalesce("_tn", F.lit(0)) != 1, "target_not_once").when((F.coalesce("_on", F.lit(0)) != 1) | (F.col("_otype") != "Document"), "target_owner_not_a_document")
        .when(number_conflicts(F.col("citation"), F.col("_onumber")), "provider_text_target_conflict").when(F.col("_ttype") != F.col("_want"), "target_type_drift")
    )
    judged = t.join(target, "_tid", "left").join(owner, "_tdoc", "left").withColumn("_f", F.when(fault.isNotNull(), F.struct("_n", fault.alias("f"))))
    proofs = judged.groupBy("link_id").agg(F.min("_f").alias("_first"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "_tid", "_tdoc"))), lambda x: F.struct(x["_tid"].alias("id"), x["_tdoc"].alias("document"))).alias("_proved"))
    b = b.join(proofs, "link_id")
    based = (F.col("_bstatus") == "RESOLVED") & (F.col("_bown") == "HOST") & F.col("_brel").isin(*CHANGES) & F.exists("_btargets", lambda x: x["id"] == F.col("source.id"))
    projected = F.col("ownership") == "PROJECTED"
    first = (
        F.when(projected & ~F.coalesce(based, F.lit(False)), "projected_source_basis_invalid").when(F.coalesce("_sn", F.lit(0)) != 1, "source_not_once").when(F.col("_stype") == "Document", "source_not_a_unit")
        .when(F.col("_stype") != F.col("source.type"), "source_type_drift").when(F.col("_first").isNotNull(), F.col("_first.f")).when(F.col("article_id").isNull(), "source_without_article")
    )
    outside = F.exists("_proved", lambda x: x["document"] != F.col("source_document"))
    ids = F.transform("_proved", lambda x: x["id"])
    return b.select(
        F.col("link_id").alias("bundle_id"), "ownership", F.col("source.id").alias("source_id"), "article_id", "source_document", F.when(first.isNull(), ids).alias("target_ids"),
        F.when(first.isNull(), F.when(outside, "EXTERNAL").otherwise("LOCAL")).alias("scope"), (first.isNull() & (F.size(ids) == 1) & (F.get(ids, F.lit(0)) == F.col("source.id"))).alias("is_self"), first.alias("fault"),
    )
