"""Citations of legal units: mentions by pattern in order of precedence, and their resolution against a registry by joins.

Mentions need places in the text, which Spark's pattern functions don't give, so a small Arrow function finds them; all
that follows is joins on one lookup key.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from statuta.functions import legal
from statuta.runtime import checkpointed

# Kinds of document, words for units, how their numbers are written, and the codes of missing targets further down.
DOCUMENT_KINDS = ["Luật", "Nghị định", "Thông tư", "Quyết định", "Nghị quyết", "Pháp lệnh", "Hiến pháp"]
UNIT_WORDS = {"point": "điểm", "clause": "khoản", "article": "điều", "subsection": "tiểu mục", "section": "mục", "chapter": "chương", "part": "phần", "appendix": "phụ lục"}
PLAIN, ROMAN, LETTER = r"\d+[a-z]?", "[IVXLCDM]+", "[a-zđ]"
NUMBERS = {"point": LETTER, "chapter": ROMAN, "part": rf"(?:thứ\s+[a-zà-ỹ]+|{ROMAN}|{PLAIN})", "appendix": rf"(?:{ROMAN}|\d+[A-Z]*)(?:[./-][A-Z0-9]+)*"}
DOCUMENT_NUMBER = r"\d+/\d{4}/[A-ZĐ0-9-]+"
THIS, OF, AND, ENACTED, SOME = "này", "của", "và", "ban hành", "các"


def _spaced(words: str) -> str:
    return words.replace(" ", r"\s+")


def _any(words: list[str]) -> str:
    return f"(?:{'|'.join(map(_spaced, words))})"


def _unit(name: str, number: str | None = None) -> str:
    """A unit's word and its number; appendices may say that it is a number."""
    between = r"(?:\s+số)?\s+" if name == "appendix" else r"\s+"
    return rf"{_spaced(UNIT_WORDS[name])}{between}(?P<{name}>{number or NUMBERS.get(name, PLAIN)})"


def _within(names: str) -> str:
    """A unit and the ones around it, smallest first; sections and chapters may be joined by "of"."""
    first, *rest = names.split()
    return _unit(first) + "".join((rf"\s+(?:{OF}\s+)?" if n in ("section", "chapter") else r"\s+") + _unit(n) for n in rest)


def _listed(item: str, word: str, repeat: str) -> str:
    """One or more items with commas and a last "and"; the unit's word may stand again before those that ``repeat`` says."""
    again = rf"(?:{word}\s+)?"
    return rf"{item}(?:\s*,\s*{again if repeat == 'all' else ''}{item})*(?:\s+{AND}\s+{again}{item})?"


def _patterns() -> list[tuple[str, re.Pattern]]:
    """Name and pattern of each kind of mention, in order of precedence: other documents' units, units of the same document, units around the text."""
    document = rf"{_any(DOCUMENT_KINDS)}\s+(?:số\s+)?(?P<document>{DOCUMENT_NUMBER})\b"
    out = {}
    for names in ("point clause article", "clause article", "subsection section chapter", "section chapter", "chapter", "part", "article"):
        out[f"external_{names.split()[0]}"] = rf"{_within(names)}\s+(?:{OF}\s+)?{document}"
    out["external_appendix"] = rf"{_unit('appendix')}\s+{_any([f'{ENACTED} kèm theo', 'kèm theo', OF])}\s+{document}"
    out["external_document"] = document
    for names in ("subsection section chapter", "section chapter"):
        out[f"local_{names.split()[0]}"] = _within(names) + r"\b"
    own = {"appendix": rf"(?:\s+(?:{_spaced(ENACTED)}\s+)?kèm\s+theo\s+{_any(['văn bản', 'luật', 'nghị định', 'thông tư', 'quyết định'])}\s+{THIS})?\b"}
    for name in ("appendix", "part", "chapter"):
        out[f"current_{name}"] = rf"{_spaced(UNIT_WORDS[name])}\s+{THIS}\b"
        out[f"local_{name}"] = _unit(name) + own.get(name, rf"\b(?:\s+{OF}\s+{_any(['luật', 'văn bản'])}\s+{THIS}\b)?")
    some, this = rf"(?:{SOME}\s+)?", lambda name: rf"\s+{UNIT_WORDS[name]}\s+{THIS}\b"
    out["points_of_clause"] = some + _unit("point", _listed(LETTER, UNIT_WORDS["point"], "last")) + this("clause")
    out["local_point"] = _within("point clause article") + r"\b"
    out["local_clauses"] = some + _unit("clause", _listed(PLAIN, UNIT_WORDS["clause"], "all")) + r"\s+" + _unit("article") + r"\b"
    out["clause_of_article"] = _unit("clause") + this("article")
    out |= {f"current_{name}": rf"{UNIT_WORDS[name]}\s+{THIS}\b" for name in ("clause", "article")}
    out["local_article"] = _unit("article") + r"\b"
    return [(name, re.compile(rf"(?i)\b{pattern}")) for name, pattern in out.items()]


#: A mention never overlaps one of a kind before its own.
PATTERNS = _patterns()
COORDINATES = ["document", "appendix", "part", "chapter", "section", "subsection", "article", "clause", "point"]
FOUND = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("raw", StringType()), StructField("kind", StringType()), *(StructField(c, StringType()) for c in COORDINATES)]))
#: What a missing target is called (fixed codes).
REASONS = {f"current_{u}": f"current_{u}_context_missing" for u in ("appendix", "part", "chapter", "clause", "article")} | {f"local_{u}": f"explicit_{u}_target_missing" for u in ("appendix", "part", "chapter", "section", "subsection", "point", "article")} | {
    "local_clauses": "explicit_clause_target_missing", "points_of_clause": "relative_point_target_missing", "clause_of_article": "current_article_clause_target_missing",
}


def _beginnings() -> tuple[re.Pattern, dict[str, set[int]], re.Pattern]:
    """The words that a mention can begin with, each known by its last letter that isn't ASCII: a pattern of these letters, their places in the words, and a pattern of the words."""
    words = sorted({w.split()[0].lower() for w in (*DOCUMENT_KINDS, *UNIT_WORDS.values(), SOME)})
    places: dict[str, set[int]] = {}
    for w in words:
        at, letter = max((i, c) for i, c in enumerate(w) if not c.isascii())
        places.setdefault(letter, set()).add(at)
    both = "".join(sorted(c + c.upper() for c in places))
    return re.compile(f"[{both}]"), places, re.compile(rf"(?i)\b(?:{'|'.join(words)})")


MARK, MARK_PLACES, BEGINNING = _beginnings()


def beginnings(text: str) -> list[int]:
    """Where a mention can begin, in order.  Most texts hold few of these letters, and one letter is looked for much faster than a pattern of words."""
    out = {m.start() - back for m in MARK.finditer(text) for back in MARK_PLACES[m[0].lower()] if back <= m.start() and BEGINNING.match(text, m.start() - back)}
    return sorted(out)


def found_in(text: str, excluded: list[tuple[int, int]], heading: int | None) -> list[dict]:
    """The mentions of a text in order of place; none in an excluded span, and no bare article where the heading stands."""
    places, out = beginnings(text), []
    taken = bytearray(len(text) if places else 0)
    for a, b in excluded if places else []:
        taken[a:b] = b"\1" * len(taken[a:b])
    for name, pattern in PATTERNS:
        end = 0
        for at in places:
            if at < end or not (m := pattern.match(text, at)):
                continue
            end = m.end()
            if (name == "local_article" and at == heading) or taken.find(1, at, end) >= 0:
                continue
            taken[at:end] = b"\1" * (end - at)
            groups = m.groupdict()
            out.append({"start": at, "end": end, "raw": m[0], "kind": name} | {c: groups.get(c) for c in COORDINATES})
    return sorted(out, key=lambda x: x["start"])


@F.pandas_udf(FOUND)
def _found(texts: pd.Series, excluded: pd.Series, headings: pd.Series) -> pd.Series:
    return pd.Series([found_in(t or "", [(x["s"], x["e"]) for x in (e if e is not None else [])], None if pd.isna(h) else int(h)) for t, e, h in zip(texts, excluded, headings, strict=True)])


def mentions(rows: DataFrame, text: str, excluded: Column | None = None, heading: Column | None = None) -> DataFrame:
    """``rows`` with a row for each mention: ``pos, start, end, raw, kind`` and the coordinates that it names; other columns stay."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    found = _found(text, excluded if excluded is not None else none, (heading if heading is not None else F.lit(None)).cast("int"))
    return rows.select("*", F.posexplode(found).alias("pos", "_m")).select(*rows.columns, "pos", "_m.*")


def lookup_key(kind: Column | str, document: Column, **coordinates: Column) -> Column:
    """The one key of a unit: its kind, its document, and the coordinates that tell units of the kind apart."""
    parts = [F.coalesce(v, F.lit("?")) for v in coordinates.values()]
    return F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, document, *parts)


def unit_keys(units: DataFrame) -> DataFrame:
    """``key, id`` of a registry ``id, kind, document_id`` with coordinates; documents are units of kind Document."""
    c = {n: F.col(n) for n in COORDINATES[1:]}
    of = {"Document": [], "Appendix": ["appendix"], "Part": ["part"], "Chapter": ["chapter"], "Section": ["chapter", "section"], "Subsection": ["chapter", "section", "subsection"], "Article": ["article"], "Clause": ["article", "clause"], "Point": ["article", "clause", "point"]}
    key = F.coalesce(*[F.when(F.col("kind") == k, lookup_key(k, F.col("document_id"), **{n: c[n] for n in names})) for k, names in of.items()])
    return units.select(key.alias("key"), "id")


def _targets(m: DataFrame) -> Column:
    """The keys or ids that a mention stands for: ``key`` to be looked up, or ``id`` that the context gives."""
    def upper(name: str) -> Column:
        return F.upper(F.trim(name))

    def lower(name: str) -> Column:
        return F.lower(F.trim(name))

    home = F.coalesce("target_document", "document_id")
    part, article, clause = legal.part_number(F.col("part")), lower("article"), lower("clause")
    numbers = F.transform(F.regexp_extract_all(F.col("clause"), F.lit(r"(?i)(\d+[a-z]?)"), F.lit(1)), F.lower)
    labels = F.transform(F.regexp_extract_all(F.lower("point"), F.lit(r"(?U)\b([a-zđ])\b"), F.lit(1)), lambda p: p)
    own = F.col("context.article")

    def keys(kind: str, *values: Column) -> Column:
        return F.array(lookup_key(kind, home, **{str(i): v for i, v in enumerate(values)}))

    rules = {
        "point": keys("Point", article, clause, lower("point")), "clause": keys("Clause", article, clause), "subsection": keys("Subsection", upper("chapter"), lower("section"), lower("subsection")), "section": keys("Section", upper("chapter"), lower("section")),
        "chapter": keys("Chapter", upper("chapter")), "part": keys("Part", part), "article": keys("Article", article), "appendix": keys("Appendix", upper("appendix")), "document": F.array(lookup_key("Document", home)),
    }
    by_kind = {f"external_{k}": v for k, v in rules.items()} | {f"local_{k}": v for k, v in rules.items() if k not in ("clause", "document")} | {
        "local_clauses": F.transform(numbers, lambda n: F.concat_ws("|", F.lit("Clause"), home, article, n)),
        "points_of_clause": F.transform(labels, lambda p: F.concat_ws("|", F.lit("Point"), home, own, F.coalesce(F.col("context.clause"), F.lit("?")), p)),
        "clause_of_article": F.array(F.concat_ws("|", F.lit("Clause"), home, own, clause)),
    }
    ids = {"current_appendix": "appendix_id", "current_part": "part_id", "current_chapter": "chapter_id", "current_clause": "clause_id", "current_article": "article_id"}
    by_id = {k: F.array(F.concat(F.lit("="), F.coalesce(F.col(f"context.{v}"), F.lit("?")))) for k, v in ids.items()}
    return F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in (by_kind | by_id).items()])


def resolved(found: DataFrame, registry: DataFrame, documents: DataFrame, row: list[str]) -> DataFrame:
    """``row`` columns with ``pos, kind, raw, status, reason, targets, scope, is_self`` for each mention.

    ``found`` has the mentions' columns, ``document_id``, ``unit_id`` (the source) and ``context``, a struct of ``article, clause,
    article_id, clause_id, chapter_id, part_id, appendix_id``.  ``registry`` is as for ``unit_keys``; ``documents`` is ``number, document_id``.
    All targets of a mention are found or none counts.  The mentions are written once, since their texts would be searched again for their verdicts.
    """
    found = checkpointed(found.select(*dict.fromkeys([*row, "pos", "kind", "raw", "document_id", "unit_id", "context", *COORDINATES])))
    known = documents.groupBy(F.upper(F.regexp_replace("number", r"\s+", "")).alias("_number")).agg(F.count(F.lit(1)).alias("_docs"), F.min("document_id").alias("_doc"))
    m = found.join(known, F.upper(F.regexp_replace("document", r"\s+", "")) == F.col("_number"), "left")
    m = m.withColumn("target_document", F.when(F.col("_docs") == 1, F.col("_doc")))
    m = m.withColumn("_keys", _targets(m))
    one = m.select(*row, "pos", F.posexplode("_keys").alias("_at", "_key"))
    units = unit_keys(registry).groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    given = F.startswith("_key", F.lit("=")) & (F.col("_key") != "=?")
    looked = one.join(units, F.col("_key") == F.col("key"), "left").withColumns({"_n": F.when(given, 1).otherwise(F.coalesce("_n", F.lit(0))), "_id": F.when(given, F.substr("_key", F.lit(2))).otherwise(F.col("_id"))})
    verdict = looked.groupBy(*row, "pos").agg(F.min("_n").alias("_least"), F.max("_n").alias("_most"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("_ids"))
    out = m.join(verdict, [*row, "pos"], "left")
    external, docs = F.startswith("kind", F.lit("external_")), F.coalesce("_docs", F.lit(0))
    missing = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    least, most = F.coalesce("_least", F.lit(0)), F.coalesce("_most", F.lit(0))
    status = F.when(external & (docs != 1), F.when(docs == 0, "UNRESOLVED").otherwise("AMBIGUOUS")).when(least == 0, "UNRESOLVED").when(most > 1, "AMBIGUOUS").otherwise("RESOLVED")
    local = F.col("target_document") == F.col("document_id")
    reason = (
        F.when(external & (docs == 0), "target_document_not_in_snapshot").when(external & (docs > 1), "target_document_identity_ambiguous")
        .when(external & (least == 0), "target_structural_unit_not_found").when(external & (most > 1), "target_structural_unit_ambiguous")
        .when(external & local, "same_document_reference_not_external").when(external, "registry_external_structural_resolution")
        .when((F.col("kind") == "points_of_clause") & F.col("context.clause_id").isNull(), "current_clause_context_missing").when(least == 0, F.try_element_at(missing, "kind")).when(most > 1, "target_structural_unit_ambiguous")
    )
    targets = F.when(status == "RESOLVED", F.col("_ids"))
    return out.select(*row, "pos", "kind", "raw", status.alias("status"), reason.alias("reason"), targets.alias("targets"), F.when(external & ~F.coalesce(local, F.lit(False)), "EXTERNAL").otherwise("LOCAL").alias("scope"), F.coalesce(F.array_contains(targets, F.col("unit_id")) & (F.size(targets) == 1), F.lit(False)).alias("is_self"))


def registry_problems(units: DataFrame) -> DataFrame:
    """``id, problem``: repeated ids, keys that two units share, parents that aren't there, and documents that are no unit's."""
    repeated = units.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    shared = unit_keys(units).groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n > 1").select("id", F.lit("shared_key").alias("problem"))
    parents = units.select(F.col("id").alias("parent_id")).distinct()
    lost = units.where("parent_id is not null").join(parents, "parent_id", "left_anti").select("id", F.lit("missing_parent").alias("problem"))
    homeless = units.where("kind <> 'Document'").join(units.where("kind = 'Document'").select("document_id"), "document_id", "left_anti").select("id", F.lit("missing_document").alias("problem"))
    return repeated.unionByName(shared).unionByName(lost).unionByName(homeless).distinct()


def document_digests(units: DataFrame) -> DataFrame:
    """``document_id, n_units, digest``: sha256 of each document's sorted unit lines, a document's units being few."""
    line = F.concat_ws("|", "id", "kind", F.coalesce("parent_id", F.lit("")), *[F.coalesce(c, F.lit("")) for c in COORDINATES[1:]])
    return units.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_units"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("digest"))
