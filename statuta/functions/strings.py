"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vietnamese and Western accented letters by the base letter they fold to.
FOLDED = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåāą",
    "c": "çćč",
    "d": "đ",
    "e": "èéẻẽẹêềếểễệëēę",
    "i": "ìíỉĩịïī",
    "n": "ñńň",
    "o": "òóỏõọôồốổỗộơờớởỡợöøō",
    "u": "ùúủũụưừứửữựüū",
    "y": "ỳýỷỹỵÿ",
}


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    marks = "".join(FOLDED.values())
    bases = "".join(k * len(v) for k, v in FOLDED.items())
    return F.translate(F.lower(text), marks, bases)


def slug(text: Column) -> Column:
    """Folded, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def document_number(text: Column) -> Column:
    """Upper case without white space; null for blank."""
    value = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.when(value != "", value)


def is_legal_number(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]+[a-z]?$"), F.lit(False))


def point_label(text: Column) -> Column:
    return F.when(text == "đ", F.lit("dd")).otherwise(text)


def roman(text: Column) -> Column:
    """The value of a Roman numeral, null for other text; a smaller digit before a larger one subtracts."""
    digits = F.transform(F.split(F.upper(text), ""), lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).when(c == "D", 500).when(c == "M", 1000))
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, d: F.struct((s["sum"] + d - F.when(s["last"] < d, 2 * s["last"]).otherwise(0)).alias("sum"), d.alias("last")), lambda s: s["sum"])
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), total)


def heading_kind(line: Column) -> Column:
    """Which structural heading a line is, by its first words; null for none."""
    rules = (("Article", r"(?iu)^điều\s+\d+[a-z]?\b"), ("Chapter", r"(?iu)^chương\s+[IVXLC\d]+\b"), ("Section", r"(?iu)^mục\s+\d+\b"), ("Clause", r"^\d+[a-z]?\.\s"), ("Point", r"^[a-zđ]\)\s"))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(rules):
        out = F.when(line.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def is_uppercase_title(line: Column, most: int = 240) -> Column:
    return (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) <= most)


def contains_quote(text: Column, quote: Column) -> Column:
    """Whether the quote stands in the text, white space and case aside; blank quotes never do."""
    q = F.lower(squeeze(quote))
    return (q != "") & F.contains(F.lower(squeeze(text)), q)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_<>{}\[\]#])", r"\\$1")


def redact(text: Column, preview: int = 12) -> Column:
    """``length:16 hex digits of the sha256:preview``."""
    return F.concat_ws(":", F.length(text).cast("string"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16), F.substring(text, 1, preview))


def structural_type(unit_id: Column) -> Column:
    """The kind of unit that an id's suffix names."""
    return F.when(unit_id.rlike(r"_p[a-z]+$"), "Point").when(unit_id.rlike(r"_cl[0-9a-z]+$"), "Clause").when(unit_id.rlike(r"_art[0-9a-z]+$"), "Article").otherwise("Document")


def relevance_group(unit_id: Column) -> Column:
    return F.substring_index(unit_id, "_cl", 1)


def line_at(text: Column, offset: Column) -> Column:
    """The line that holds a code-point offset."""
    before = F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)
    return F.concat(before, F.substring_index(F.substr(text, offset + 1), "\n", 1))


def count_suffix_stripped(text: Column) -> Column:
    """Without a trailing count in brackets."""
    return F.regexp_replace(text, r"\s*\([0-9]+\)\s*$", "")


def conversation_title(text: Column, most: int = 60) -> Column:
    value = squeeze(text)
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 1), F.lit("…")))


def size_chunks(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` code points."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def json_object(text: Column) -> Column:
    """From the first brace to the last of a noisy answer, null if it has none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
