"""What a message of a conversation refers to, turn by turn: pending choices, units named outright, and units spoken of before.

Messages are read one by one in the order of their turns.  What a message names is looked up beforehand for all messages together, by joins;
what it means depends on the conversation so far: a choice that was offered, and the units that answers were grounded on, each kept
for five user turns after it was last used, the five latest at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators.conversation import explicit_references
from statuta.streaming.folds import Machine, fold, fold_stream

# Messages that cancel, phrases that point back with the kind of unit they mean (the most specific first), and codes.
CANCEL = ("hủy", "huỷ", "bỏ qua", "hủy bỏ", "huỷ bỏ", "thôi")
POINTING = [("điểm này", "Point"), ("điểm đó", "Point"), ("khoản này", "Clause"), ("khoản đó", "Clause"), ("điều này", "Article"), ("điều đó", "Article"), ("luật này", "Document"), ("văn bản này", "Document"), ("văn bản đó", "Document"), ("quy định này", "Any"), ("quy định đó", "Any")]
DOCUMENT_NUMBER, ARTICLE = r"(?iu)(\d+/\d{4}/[A-ZĐ0-9-]+)", r"(?iu)điều\s+(\d+[a-z]?)"
#: Most units that a message can name, most choices offered, turns and number of focuses.
MOST_REFERENCES, MOST_CHOICES, FOCUS_TURNS, MOST_FOCUSES = 5, 5, 5, 5


def plain_message(text: Column) -> Column:
    """A message in lower case with single spaces, without spaces and marks at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"^[ !?.,]+|[ !?.,]+$", "")


def pointed_kind(text: Column) -> Column:
    """The kind of unit that the first phrase of the list points back to, ``Any`` for no particular one, null where nothing points back."""
    t = F.lower(text)
    return F.coalesce(*[F.when(F.contains(t, F.lit(phrase)), F.lit(kind)) for phrase, kind in POINTING])


def named(messages: DataFrame, units: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The key and text of messages with ``n_references`` and ``found``, the units they name in order: array of ``id, label, type, number``.

    ``units`` is ``id, label, type, number, article`` of documents (without an article) and articles.  An article without a document is looked up in all documents;
    of the units of one article number the six with the least ids are enough to tell one from several and to offer five.
    """
    refs = explicit_references(
        F.when(F.size(F.regexp_extract_all(text, F.lit(DOCUMENT_NUMBER), F.lit(1))) > 0, F.transform(F.regexp_extract_all(text, F.lit(DOCUMENT_NUMBER), F.lit(1)), F.upper)).otherwise(F.array(F.lit("*"))),
        F.when(F.size(F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1))) > 0, F.transform(F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1)), F.lower)).otherwise(F.array(F.lit("*"))),
        MOST_REFERENCES,
    )
    refs = F.filter(refs, lambda r: (r["identity"] != "*") | (r["number"] != "*"))
    asked = messages.select(*key, text).withColumn("_refs", F.coalesce(refs, F.array().cast("array<struct<identity:string,number:string>>")))
    one = asked.select(*key, F.posexplode("_refs").alias("_n", "_r")).select(*key, "_n", F.concat_ws("|", "_r.identity", "_r.number").alias("_key"))
    unit = F.struct("id", "label", "type", "number")
    keyed = units.select(F.concat_ws("|", F.upper("number"), F.coalesce("article", F.lit("*"))).alias("_key"), "id", unit.alias("_u"))
    loose = units.where("article is not null").select(F.concat_ws("|", F.lit("*"), "article").alias("_key"), "id", unit.alias("_u"))
    least = Window.partitionBy("_key").orderBy("id")
    known = keyed.unionByName(loose).withColumn("_p", F.row_number().over(least)).where(F.col("_p") <= MOST_CHOICES + 1).drop("id")
    hits = one.join(known, "_key").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_p", "_u"))), lambda x: x["_u"]).alias("found"))
    return asked.join(hits, key, "left").withColumns({"n_references": F.size("_refs"), "found": F.coalesce("found", F.array().cast(hits.schema["found"].dataType))}).drop("_refs")


def _once(found: list[dict]) -> list[dict]:
    """Each unit once, and of the units of one document number the first."""
    out, ids, numbers = [], set(), set()
    for u in found:
        if u["id"] in ids or u.get("number") in numbers:
            continue
        ids.add(u["id"])
        if u.get("number"):
            numbers.add(u["number"])
        out.append(u)
    return out


def _offer(units: list[dict], reason: str) -> tuple[str, str, None, list[dict]]:
    return "CLARIFY_SELECT", reason, None, units[:MOST_CHOICES]


def _fresh(row: dict, focuses: list[dict]) -> tuple[str, str | None, dict | None, list[dict] | None]:
    """Outcome, reason, the unit and the choices of a message by what it names or points back to."""
    if row["n_references"]:
        units = _once(row.get("found") or [])
        if len(units) == 1:
            return "RESOLVED", "CURRENT_MESSAGE", units[0], None
        return _offer(units, "SEVERAL_CANDIDATES") if units else ("CLARIFY_RESTATE", "REFERENT_NOT_FOUND", None, [])
    if kind := row.get("points"):
        units = [f for f in focuses if kind == "Any" or f["type"] == kind]
        if len(units) == 1:
            return "RESOLVED", "HISTORY_FOCUS", units[0], None
        return _offer(units, "SEVERAL_FOCUSES") if units else ("CLARIFY_RESTATE", "REFERENT_NOT_FOUND", None, [])
    return "STANDALONE", None, None, None


def _chosen(message: str, choices: list[dict]) -> dict | None:
    if message.isascii() and message.isdecimal():
        return choices[int(message) - 1] if len(message) < 9 and 1 <= int(message) <= len(choices) else None
    return next((c for c in choices if " ".join(c["label"].lower().split()) == message), None)


def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
    """One user message.  A choice that is pending comes first; then what the message names; then what it points back to."""
    state = state or {"turn": 0, "pending": None, "focuses": []}
    now, message = state["turn"] + 1, row.get("plain", "")
    alive = [f for f in state["focuses"] if now - f["used"] <= FOCUS_TURNS]
    focuses = sorted(alive, key=lambda f: (-f["used"], f["id"]))[:MOST_FOCUSES]
    pending = state["pending"]
    if pending is not None and message in CANCEL:
        outcome, reason, unit, choices = "CANCEL", None, None, None
    elif pending:  # choices were offered
        unit = _chosen(message, pending)
        outcome, reason, choices = ("RESOLVED", "PENDING_CLARIFICATION", None) if unit else ("CLARIFY_SELECT", "SELECT_INPUT_INVALID", pending)
    else:
        outcome, reason, unit, choices = _fresh(row, focuses)
    if unit:
        unit = {k: unit.get(k) for k in ("id", "label", "type", "number")}
        alive = [f for f in alive if f["id"] != unit["id"]] + [unit | {"used": now}]
    told = (row["turn"], outcome, reason, unit and unit["id"], ",".join(c["id"] for c in choices or []), len(focuses))
    return {"turn": now, "pending": choices, "focuses": alive}, [told]


MACHINE = Machine(step, "turn long, outcome string, reason string, unit string, choices string, n_focuses long")


def read_messages(messages: DataFrame, units: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conv_id, turn, plain, points, n_references, found`` of messages: all that doesn't depend on the conversation."""
    asked = named(messages, units, [key, turn])
    return asked.select(key, F.col(turn).alias("turn"), plain_message(F.col("text")).alias("plain"), pointed_kind(F.col("text")).alias("points"), "n_references", "found")


def resolved(messages: DataFrame, units: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conv_id, turn, outcome, reason, unit, choices, n_focuses`` of each user message (``conv_id, turn, text``), conversation by conversation."""
    return fold(read_messages(messages, units, key, turn), MACHINE, key, "turn")


def resolved_stream(read: DataFrame, key: str = "conv_id") -> DataFrame:
    """As ``resolved`` over a stream of what ``read_messages`` gives."""
    return fold_stream(read, MACHINE, key, "turn")
