"""Rules as expressions and joins: routing, plans, relation checks, readiness, provider candidates, reconciliation, answers' contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import legal
from statuta.runtime import checkpointed

AMENDMENT, GUIDANCE = "sửa đổi|bãi bỏ|thay thế", "văn bản.*hướng dẫn"
# Question words by intent in order of precedence with how sure they are, parent and child kinds, kinds by relation,
# properties by relation, and pairs of kinds of documents of which the first guides the second.
INTENTS = [
    (r"nhiều bước|qua nhiều|liên hệ.*(?:điều|văn bản)|dẫn chiếu|thủ tục.*hướng dẫn", "MULTI_HOP", "LOW"), (rf"thuộc chương|thuộc điều|thuộc khoản|nằm ở chương|{GUIDANCE}|quan hệ thứ bậc", "HIERARCHY", "HIGH"), (r"là gì|\bđịnh nghĩa\b|được hiểu thế nào|thế nào là|\bkhái niệm\b", "DEFINITION", "HIGH"),
    (r"khác nhau|giống nhau|so sánh|trước và sau", "COMPARISON", "HIGH"), (rf"{AMENDMENT}|hết hiệu lực|(?:có|đang có|còn) hiệu lực", "VALIDITY", "HIGH"),
]
UNITS = ["Document", "Article", "Clause", "Point"]
PARENTS = {
    "Document": ["Part", "Chapter", "Section", "Article", "Appendix", "AttachedInstrument"], "AttachedInstrument": ["Appendix", "Part", "Chapter", "Section", "Article"], "Appendix": ["Part", "Chapter", "Section", "Article"], "Part": ["Chapter", "Section", "Article"],
    "Chapter": ["Section", "Article"], "Section": ["Subsection", "Article"], "Subsection": ["Article"], "Article": ["Clause"], "Clause": ["Point"],
}
HEADS_TAILS = {"REFERS_TO": (["Appendix", "Article", "Clause", "Point"], ["Appendix", "Article", "Clause", "Point", "Document", "Part", "Chapter", "Section", "Subsection"]), "DEFINES": (["Article", "Clause"], ["LegalConcept"]), "REGULATES": (["Article", "Clause"], ["LegalSubject", "LegalAction"]), "REQUIRES": (["LegalSubject"], ["LegalConcept"])}
PAIRS = {"ISSUED_BY": [("Document", "Issuer")], "CONTAINS": [(p, c) for p, cs in PARENTS.items() for c in cs], "AMENDS": [(a, b) for a in UNITS for b in UNITS], "REPEALS": [(a, b) for a in UNITS for b in UNITS], "REPLACES": [("Document", "Document")], "GUIDES": [("Document", "Document")]} | {k: [(a, b) for a in h for b in t] for k, (h, t) in HEADS_TAILS.items()}
REQUIRED = {"AMENDS": ["effective_from"], "REPEALS": ["effective_from"], "REPLACES": ["effective_from"], "DEFINES": ["confidence", "llm_model", "created_at"], "REGULATES": ["confidence", "llm_model", "created_at"], "REQUIRES": ["confidence", "llm_model", "created_at"], "REFERS_TO": ["citation_text", "citation_type", "extraction_method", "created_at", "reference_bundle_id", "reference_target_count"]}
LOOPS_ALLOWED = ["GUIDES", "REFERS_TO", "DEFINES", "REGULATES"]
TEMPORAL = ["AMENDS", "REPEALS", "REPLACES"]


def question_rule(text: Column) -> Column:
    """``intent, confidence`` of the first rule that a question fits, null for none."""
    return F.coalesce(*[F.when(text.rlike(f"(?iuU){p}"), F.struct(F.lit(i).alias("intent"), F.lit(c).alias("confidence"))) for p, i, c in INTENTS])


def required_capability(intent: Column, text: Column, current: Column) -> Column:
    """What the graph must offer for an intent; ``current`` tells that the day was set to today for the question."""
    validity = F.when(text.rlike(f"(?iu){AMENDMENT}"), "VERSION_CHAIN_VALIDITY").when(current, "CORPUS_COMPLETE_CURRENT_VALIDITY").otherwise("SCOPED_TEMPORAL_METADATA")
    hierarchy = F.when(text.rlike(f"(?iu){GUIDANCE}"), "GUIDES_RELATIONS").otherwise("STRUCTURAL_HIERARCHY")
    return F.when(intent == "VALIDITY", validity).when(intent == "HIERARCHY", hierarchy).when(intent == "COMPARISON", "MULTIPLE_VERSIONS").when(intent == "DEFINITION", "LEXICAL_DEFINITION").when(intent == "MULTI_HOP", "SEMANTIC_MULTI_HOP_GRAPH")


def plan_contract(subs: Column) -> Column:
    """The first fault of sub-questions ``(id, depends_on)`` in order: none, an id again, or a need that doesn't come before; null for sound ones."""
    before = F.transform(subs, lambda s, i: F.transform(F.slice(subs, F.lit(1), i), lambda x: x["id"]))
    fault = F.transform(subs, lambda s, i: F.when(F.array_contains(F.get(before, i), s["id"]), F.concat(F.lit("duplicate:"), s["id"])).when(F.size(F.array_except(s["depends_on"], F.get(before, i))) > 0, F.concat(F.lit("not_preceding:"), F.get(F.array_except(s["depends_on"], F.get(before, i)), F.lit(0)))))
    return F.when(F.size(subs) == 0, "no_subqueries").otherwise(F.get(F.filter(fault, lambda f: f.isNotNull()), F.lit(0)))


def allowed(relation: Column, head: Column, tail: Column) -> Column:
    """Whether the ontology allows the relation from kind to kind."""
    known = F.array(*[F.lit(f"{r}:{a}>{b}") for r, ps in PAIRS.items() for a, b in ps])
    return F.array_contains(known, F.concat(relation, F.lit(":"), head, F.lit(">"), tail))


def plan_shape(anchor: Column, steps: Column) -> Column:
    """Null for a sound plan ``steps(relation, direction, label)``, else what is wrong: its depth, the final kind, or the first impossible step.

    An anchor of unknown kind may be an article or a clause.
    """
    starts = F.when(anchor.isNull(), F.array(F.lit("Article"), F.lit("Clause"))).otherwise(F.array(anchor))
    came = F.transform(steps, lambda s, i: F.when(i == 0, starts).otherwise(F.array(F.get(steps, i - 1)["label"])))
    fine = F.transform(steps, lambda s, i: F.exists(F.get(came, i), lambda c: F.when(s["direction"] == "outgoing", allowed(s["relation"], c, s["label"])).when(s["direction"] == "incoming", allowed(s["relation"], s["label"], c)).otherwise(False)))
    bad = F.array_position(fine, False)
    return F.when(~F.size(steps).between(2, 3), "depth").when(~F.element_at(steps, -1)["label"].isin("Article", "Clause", "Point", "LegalConcept", "LegalSubject", "LegalAction"), "target_label").when(bad > 0, F.concat(F.lit("step_"), bad.cast("string")))


def structural_mention(text: Column) -> Column:
    """``label, document, article, clause, point`` that a whole mention names, null for other texts."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    n = r"\d+[a-z]?"
    kinds = [("Point", rf"(?iu)^điểm ([a-zđ]) khoản ({n}) điều ({n})$", ("point", "clause", "article")), ("Clause", rf"(?iu)^khoản ({n}) điều ({n})$", ("clause", "article")), ("Article", rf"(?iu)^điều ({n})$", ("article",)), ("Document", r"(?iu)^(?:luật|nghị định|thông tư|quyết định|nghị quyết|pháp lệnh|hiến pháp|văn bản)(?: số)? (\d+/\d{4}/[A-ZĐ0-9-]+)$", ("document",))]

    def one(label: str, pattern: str, names: tuple[str, ...]) -> Column:
        at = {x: i for i, x in enumerate(names, 1)}
        values = [(F.upper if c == "document" else F.lower)(F.regexp_extract(t, pattern, at[c])) if c in at else F.lit(None).cast("string") for c in ("document", "article", "clause", "point")]
        return F.when(t.rlike(pattern), F.struct(F.lit(label).alias("label"), *[v.alias(c) for v, c in zip(values, ("document", "article", "clause", "point"), strict=True)]))

    return F.coalesce(*[one(*k) for k in kinds])


def structural_endpoints(mentions: DataFrame, keys: DataFrame, mention: str, expected: str, scope: str) -> DataFrame:
    """``mentions`` with ``status, reason, target``: what each mention names within the documents of its scope (an array).

    ``keys`` is ``document_id, label, article, clause, point, id``; mentions that name nothing, or another kind than
    expected, are unbound; without a scope, or with several matches, ambiguous.
    """
    m = checkpointed(mentions.withColumns({"_id": F.xxhash64(*[F.col(c).cast("string") for c in mentions.columns]), "_m": structural_mention(F.col(mention))}))
    asked = m.where("_m is not null").select("_id", F.explode(F.col(scope)).alias("_doc"), "_m.*").distinct()
    k = keys.select(F.col("document_id").alias("_doc"), F.col("label").alias("_l"), F.col("article").alias("_a"), F.col("clause").alias("_c"), F.col("point").alias("_p"), F.col("id").alias("_target"))
    # a document's mention is looked up by its number elsewhere; here it matches the documents of the scope
    same = (F.col("label") == F.col("_l")) & F.col("article").eqNullSafe(F.col("_a")) & F.col("clause").eqNullSafe(F.col("_c")) & F.col("point").eqNullSafe(F.col("_p"))
    hits = asked.join(k, "_doc").where(same).groupBy("_id").agg(F.count_distinct("_target").alias("_n"), F.min("_target").alias("_t"))
    n = F.coalesce("_n", F.lit(0))
    reason = F.when(F.col("_m").isNull(), "unsupported_mention").when(F.col(expected) != F.col("_m.label"), "label_differs").when(F.size(scope) == 0, "scope_required").when(n == 0, "no_match").when(n > 1, "several_matches")
    status = F.when(reason.isNull(), "RESOLVED").when(reason.isin("scope_required", "several_matches"), "AMBIGUOUS").otherwise("UNBOUND")
    return m.join(hits, "_id", "left").withColumns({"status": status, "reason": reason, "target": F.when(reason.isNull(), F.col("_t"))}).select(*mentions.columns, "status", "reason", "target")


def binding(anchor_status: Column, target_status: Column) -> Column:
    """BOUND, or the first end that isn't: UNBOUND_ANCHOR, AMBIGUOUS_ANCHOR, UNBOUND_TARGET or AMBIGUOUS_TARGET."""
    return F.when(anchor_status != "RESOLVED", F.concat(anchor_status, F.lit("_ANCHOR"))).when(target_status != "RESOLVED", F.concat(target_status, F.lit("_TARGET"))).otherwise("BOUND")


def rule_plan(text: Column) -> Column:
    """``anchor, anchor_label, target, steps`` that a question's words give, null for none: following citations, or the clause of a cited article."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    clause, article = F.regexp_extract(t, r"(?iuU)\bKhoản \d+ Điều (\d+)\b", 0), F.regexp_extract(t, r"(?iuU)\bĐiều \d+\b", 0)
    anchor = F.when(clause != "", clause).otherwise(article)
    number = F.regexp_extract(anchor, r"(\d+)$", 1)
    asked = F.regexp_replace(F.regexp_extract(t, r"(?iuU)\bkhoản nào\b[^?]*", 0), r"[ ?]+$", "")
    follow = F.contains(F.lower(t), F.lit("lần theo các dẫn chiếu"))

    def steps(*names: str) -> Column:
        return F.array(*map(F.lit, names))

    plan = F.struct(anchor.alias("anchor"), F.when(clause != "", "Clause").otherwise("Article").alias("anchor_label"), F.when(follow, F.concat(F.lit("Khoản 1 Điều "), number)).otherwise(asked).alias("target"), F.when(follow, steps("REFERS_TO>Clause", "REFERS_TO>Clause")).otherwise(steps("REFERS_TO>Article", "CONTAINS>Clause")).alias("steps"))
    return F.when((anchor != "") & (follow | (asked != "")), plan)


def endpoint_fusion(hits: DataFrame, label: str, k: int = 60) -> DataFrame:
    """``query_id, id, score, sources`` of units of the wanted kind among ``hits(query_id, channel, rank, id, label, article_id)``.

    A hit on another kind credits the wanted units beside it: an article its clauses, a clause its article.
    """
    direct = hits.where(F.col("label") == label).select("query_id", "id", "article_id").distinct()
    to = direct.select("query_id", F.col("id").alias("_to"), F.col("article_id").alias("_art"))
    own = hits.where(F.col("label") == label).select("query_id", "channel", "rank", F.col("id").alias("_to"))
    other = hits.where(F.col("label") != label)
    if label == "Clause":
        lent = other.where("label = 'Article'").join(to, "query_id").where("_art = id").select("query_id", "channel", "rank", "_to")
    elif label == "Article":
        lent = other.where("label = 'Clause'").join(to, "query_id").where("article_id = _to").select("query_id", "channel", "rank", "_to")
    else:
        lent = own.limit(0)
    return own.unionByName(lent).groupBy("query_id", F.col("_to").alias("id")).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))


def extraction_error(relation: Column, head: Column, tail: Column, head_id: Column, tail_id: Column, properties: Column) -> Column:
    """The first fault of an extracted relation, null for none: its name, its kinds (of REFERS_TO and the like only the tail's), a loop, missing properties, its citation type."""
    aliases = F.create_map(*[F.lit(x) for kv in legal.RELATION_ALIASES.items() for x in kv])
    ends = F.when(relation.isin(*HEADS_TAILS), F.coalesce(*[F.when(relation == r, tail.isin(ts)) for r, (_, ts) in HEADS_TAILS.items()])).otherwise(allowed(relation, head, tail))
    need = F.coalesce(*[F.when(relation == r, F.array(*map(F.lit, ps))) for r, ps in REQUIRED.items()], F.array().cast("array<string>"))
    missing = F.filter(need, lambda p: F.coalesce(F.try_element_at(properties, p), F.lit("")) == "")
    return (
        F.when(F.try_element_at(aliases, relation).isNotNull(), F.concat(F.lit("legacy:"), F.try_element_at(aliases, relation))).when(~relation.isin(*PAIRS), "unknown_relation").when(~ends, "pair")
        .when(~relation.isin(LOOPS_ALLOWED) & (head_id == tail_id), "self_loop").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
        .when((relation == "REFERS_TO") & ~F.coalesce(F.try_element_at(properties, F.lit("citation_type")).isin("DIRECT", "INDIRECT", "RANGE"), F.lit(False)), "citation_type")
    )


def record_consistency(relation: Column, head: Column, tail: Column, head_id: Column, tail_id: Column, dated: Column, known: Column, ontology_valid: Column) -> Column:
    """``state, reason``: valid, hard_fail or review (blocking) of a record before it enters a payload."""
    def out(state: str, reason: str | None) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))

    temporal, unknown = relation.isin(TEMPORAL), ~(F.array_contains(known, head_id) & F.array_contains(known, tail_id))
    return (
        F.when(~ontology_valid, out("hard_fail", "ontology_invalid")).when(temporal & (head_id == tail_id), out("hard_fail", "self_loop")).when(temporal & ~dated, out("review", "temporal_metadata_incomplete"))
        .when((relation == "GUIDES") & ((head != "Document") | (tail != "Document")), out("review", "guides_doc_type_unknown"))
        .when(unknown & relation.isin("REFERS_TO", "GUIDES", *TEMPORAL), out("review", "missing_external_document_registry")).when(unknown, out("hard_fail", "unresolved_local_endpoint")).otherwise(out("valid", None))
    )


def payload_errors(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``id, error``: every fault of a payload: kinds that aren't kept, repeated ids, relations to unknown nodes or between kinds that don't allow them."""
    kept = ["Document", "Issuer", "Appendix", "AttachedInstrument", "Part", "Chapter", "Section", "Subsection", "Article", "Clause", "Point", "LegalConcept", "LegalSubject", "LegalAction"]
    kind = F.when(F.col("kind").isin("Obligation", "Right", "Condition", "Exception"), "runtime_only").when(~F.col("kind").isin(kept), "unsupported")
    wrong = nodes.select("id", kind.alias("error")).where("error is not null")
    good = nodes.where(F.col("kind").isin(kept))
    again = good.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("error"))
    ends = good.groupBy("id").agg(F.min("kind").alias("_k"))
    r = relations.join(ends.select(F.col("id").alias("head_id"), F.col("_k").alias("_h")), "head_id", "left").join(ends.select(F.col("id").alias("tail_id"), F.col("_k").alias("_t")), "tail_id", "left")
    error = F.when(F.col("_h").isNull(), "unknown_head").when(F.col("_t").isNull(), "unknown_tail").when(~F.col("type").isin(LOOPS_ALLOWED) & (F.col("head_id") == F.col("tail_id")), "self_loop").when(~allowed(F.col("type"), F.col("_h"), F.col("_t")), "pair")
    bad = r.select(F.concat_ws(">", "head_id", "tail_id").alias("id"), error.alias("error")).where("error is not null")
    return wrong.unionByName(again).unionByName(bad)


def provider_candidate(relation: Column, projected: Column, projected_source: Column, host_source: Column, target_known: Column, number_conflict: Column, n_items: Column, n_resolved: Column) -> Column:
    """``status, reason`` of a provider's link, by the first thing that it lacks."""
    def out(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    return (
        F.when(relation == "POSITIONAL_ANCHOR", out("NOT_APPLICABLE", "positional_anchor_no_graph_edge")).when(relation == "UNKNOWN", out("AMBIGUOUS", "governing_operation_ambiguous"))
        .when(projected & projected_source.isNull(), out("UNRESOLVED", "projected_source_owner_not_resolved")).when(~projected & host_source.isNull(), out("UNRESOLVED", "source_structural_unit_not_found"))
        .when(~target_known, out("UNRESOLVED", "target_document_not_in_corpus")).when(number_conflict, out("UNRESOLVED", "provider_text_target_conflict")).when((n_items > 0) & (n_items != n_resolved), out("UNRESOLVED", "target_provider_item_unresolved"))
        .otherwise(out("RESOLVED", "provider_endpoints_resolved"))
    )


def identity_index(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value`` of the keys that stand for one value only; what stands for several is left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def projected_context(intent: Column, lost: Column, units: Column, types: Column, bundles: Column, dated: Column, versions: Column) -> Column:
    """Null where a packed context still has what its intent needs, else what it lost."""
    return (
        F.when(lost, "lost_required_evidence").when(intent.isin("FACTUAL", "DEFINITION") & (units == 0), "no_direct_evidence").when((intent == "HIERARCHY") & ~F.array_contains(types, "CONTAINS"), "hierarchy_path").when((intent == "MULTI_HOP") & ((F.size(types) == 0) | (bundles == 0)), "graph_path")
        .when((intent == "VALIDITY") & ~dated, "temporal_evidence").when((intent == "COMPARISON") & (versions < 2), "comparison_versions")
    )


def evidence_contract(row: dict[str, Column]) -> Column:
    """The first fault of an evidence unit, null for none: its id, its text, its document, label or link, or ids that don't fit its kind."""
    canonical = r"^[a-z0-9]+(?:_[a-z0-9]+)*$"
    label, i, a, c = row["label"], row["id"], row["article_id"], row["clause_id"]
    fits = F.when(label == "Document", (row["document_id"] == i) & a.isNull() & c.isNull()).when(label == "Article", (a == i) & c.isNull()).when(label == "Clause", a.isNotNull() & (c == i)).when(label == "Appendix", True).otherwise(a.isNotNull() & c.isNotNull())
    return F.when(~i.rlike(canonical), "unit_id").when(F.trim(row["content"]) == "", "blank_content").when(~row["document_id"].rlike(canonical), "document_id").when(F.trim(row["citation"]) == "", "citation").when(~F.coalesce(fits, F.lit(False)), "hierarchy_ids")


def walked_up(units: DataFrame) -> DataFrame:
    """``id, chain, cyclic``: each unit's ancestors from the root down as an array, itself last; units on or under a cycle have no chain.

    Chains grow by doubling until none changes, so depth costs its logarithm in joins.  A chain that meets an id again runs into a cycle and ends there.  A
    parent that isn't there ends a chain as a root does.
    """
    level = checkpointed(units.select("id", F.col("parent_id").alias("up"), F.array("id").alias("chain"), F.lit(False).alias("cyclic")))
    while level.where("up is not null and not cyclic").limit(1).count():
        above = level.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("chain").alias("_chain"), F.col("cyclic").alias("_cyclic"))
        open_ = F.col("up").isNotNull() & ~F.col("cyclic")
        grown = F.when(open_ & F.col("_chain").isNotNull(), F.concat("_chain", "chain")).otherwise(F.col("chain"))
        again = F.col("cyclic") | (open_ & (F.coalesce("_cyclic", F.lit(False)) | (F.size(F.array_distinct(grown)) < F.size(grown))))
        level = level.join(above, "up", "left").select("id", F.when(open_ & ~again, F.col("_up")).otherwise(F.when(F.col("cyclic"), F.col("up"))).alias("up"), F.when(again, F.array("id")).otherwise(grown).alias("chain"), again.alias("cyclic"))
        level = checkpointed(level)
    return level.select("id", F.when(~F.col("cyclic"), F.col("chain")).alias("chain"), "cyclic")


def ancestor_chains(units: DataFrame) -> DataFrame:
    """``id, chain``: each unit's ancestors from the root down, joined by ``>``, itself last; units that run into a cycle give no row (``cycles`` names them)."""
    return walked_up(units).where("not cyclic").select("id", F.array_join("chain", ">").alias("chain"))


def cycles(units: DataFrame) -> DataFrame:
    """``id`` of the units that are on a cycle of parents, or under one."""
    return walked_up(units).where("cyclic").select("id")


def containment_payload(units: DataFrame) -> DataFrame:
    """``head_id, type, tail_id, relation_id`` of a tree of units, each edge once."""
    e = units.where("parent_id is not null").select(F.col("parent_id").alias("head_id"), F.lit("CONTAINS").alias("type"), F.col("id").alias("tail_id")).distinct()
    return e.withColumn("relation_id", F.sha1(F.concat_ws("|", "head_id", "type", "tail_id", F.lit("")).cast("binary")))


def payload_conflicts(nodes: DataFrame, shared: str = "Issuer") -> DataFrame:
    """``id``: nodes that come with different contents, but for those of the kind that several documents share."""
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in nodes.columns if c != "id"])
    return nodes.where(F.col("kind") != shared).groupBy("id").agg(F.count_distinct(content).alias("n")).where("n > 1").select("id")


def owner_scoped(units: DataFrame, owner: str) -> DataFrame:
    """``units`` under an owner: their ids and parents' begin with its id in place of the document's, roots hang from it."""
    def moved(column: str) -> Column:
        return F.concat(F.col(owner), F.substr(column, F.length("document_id") + 1))

    top = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("document_id"))
    return units.where("kind <> 'Document'").withColumns({"parent_id": F.when(top, F.col(owner)).otherwise(moved("parent_id")), "id": moved("id")})


def best_focus(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def readiness_errors(row: dict[str, Column], manifest: dict[str, Column]) -> Column:
    """What keeps a document's metadata from being used, each as its field: a mismatch with the manifest, or a required field that is missing."""
    differs = [F.when((F.coalesce(row[c], F.lit("")) != "") & (F.coalesce(manifest[c], F.lit("")) != "") & (row[c] != manifest[c]), F.lit(f"mismatch:{c}")) for c in manifest]
    lacks = [F.when(F.coalesce(row[c], F.lit("")) == "", F.lit(f"missing:{c}")) for c in row if c not in manifest]
    return F.array_compact(F.array(*differs, *lacks))


def extraction_readiness(counts: dict[str, Column], complete: Column, version: Column, current: str, entities: Column) -> Column:
    """Null for an extraction that can be written, else the first thing wrong with it."""
    return (
        F.when(version != current, "ontology_version").when(~complete, "smoke_subset").when(counts["extract"] != counts["accepted"] + counts["review"] + counts["rejected"], "counts_differ").when(counts["accepted"] == 0, "nothing_accepted").when(entities == 0, "no_entities")
    )


def provider_batch_errors(rows: DataFrame) -> DataFrame:
    """``relation_id, error`` of a provider's temporal relations ``relation_id, candidate_id, wrapped_id, type, head, tail, effective_from``, every fault a row."""
    one = F.array_compact(F.array(
        F.when(~F.col("type").isin("AMENDS", "REPEALS"), "type"), F.when(~F.col("head").isin(UNITS), "head"), F.when(~F.col("tail").isin(UNITS), "tail"), F.when(F.coalesce("candidate_id", F.lit("")) == "", "no_candidate"),
        F.when(~F.col("candidate_id").eqNullSafe(F.col("wrapped_id")), "wrapper"), F.when(F.col("effective_from").isNull(), "effective_from"),
    ))
    own = rows.select("relation_id", F.explode(one).alias("error"))
    again = [rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("relation_id").alias("r")).where("n > 1").select(F.col("r").alias("relation_id"), F.lit(f"duplicate_{c}").alias("error")) for c in ("relation_id", "candidate_id")]
    return own.unionByName(again[0]).unionByName(again[1])


def diagram_record(relation: Column, method: Column, head_resolved: Column, tail_resolved: Column, head_type: Column, tail_type: Column, current_head: Column, effective: Column, document_effective: Column, guides: list[tuple[str, str]]) -> Column:
    """``state, reason, effective_from`` of a relation between documents that a diagram shows."""
    def out(state: str, reason: str | None) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))

    day = F.coalesce(effective, F.when(current_head, document_effective))
    pair = F.concat_ws(">", head_type, tail_type).isin([f"{a}>{b}" for a, b in guides])
    state = (
        F.when(~head_resolved | ~tail_resolved, out("review", "unresolved_diagram_target")).when((method != "DIAGRAM") | ~relation.isin("GUIDES", *TEMPORAL), out("rejected", "unsupported_diagram_relation"))
        .when(relation.isin(TEMPORAL) & day.isNull(), out("review", "temporal_metadata_incomplete")).when((relation == "GUIDES") & ~F.coalesce(pair, F.lit(False)), out("rejected", "guides_pair")).otherwise(out("valid", None))
    )
    return F.struct(state.alias("s"), F.when(relation.isin(TEMPORAL) & (state["state"] == "valid"), day).alias("effective_from"))


def rewritten(question: Column, label: Column, keep: Column) -> Column:
    """A question with its first "that article" and the like replaced by the label, unless an anchor that must stay would be lost; then as it was."""
    back = r"(?iu)(?:khoản|điều|luật|văn bản|nghị định)\s+(?:này|đó|ấy|trên)"
    new = F.regexp_replace(question, f"(?s)^(.*?){back}", F.concat(F.lit("$1"), F.regexp_replace(label, r"([$\\])", r"\\$1")))
    lost = F.exists(keep, lambda k: ~F.contains(new, k))
    return F.when(label.isNull() | lost, question).otherwise(new)
