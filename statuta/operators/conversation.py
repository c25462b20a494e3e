"""References in conversation texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that point back, the most specific first.
ANAPHORA = {"điểm này": "Point", "khoản này": "Clause", "điều này": "Article", "luật này": "Document"}


def anaphora(text: Column) -> Column:
    """The most specific phrase that points back, null for none."""
    out = F.lit(None).cast("string")
    for phrase in reversed(ANAPHORA):
        out = F.when(F.contains(F.lower(text), F.lit(phrase)), F.lit(phrase)).otherwise(out)
    return out


def replace_first(text: Column, phrase: Column, value: Column) -> Column:
    """The text with the first occurrence of the phrase, in any case, replaced; a null or missing phrase changes nothing."""
    at = F.coalesce(F.position(phrase, F.lower(text)), F.lit(0))
    return F.when(at > 0, F.overlay(text, value, at, F.length(phrase))).otherwise(text)


def explicit_references(identities: Column, numbers: Column, most: int = 5) -> Column:
    """The first ``most`` pairs of identities and article numbers, identities outermost: array of (identity, number)."""
    pairs = F.flatten(F.transform(F.array_distinct(identities), lambda i: F.transform(F.array_distinct(numbers), lambda n: F.struct(i.alias("identity"), n.alias("number")))))
    return F.slice(pairs, 1, most)


def open_quote(prefix: Column) -> Column:
    """Whether the last opening quote of the prefix comes after its last closing one."""
    back = F.reverse(prefix)
    opened, closed = F.instr(back, "“"), F.instr(back, "”")
    return (opened > 0) & ((closed == 0) | (opened < closed))


def quote_states(text: Column, step: int) -> Column:
    """``(at, open)`` of the prefixes that end at every ``step``-th character and at the end: array, null for a null text."""
    size = F.length(text)
    at = F.concat(F.filter(F.sequence(F.lit(0), size, F.lit(step)), lambda o: (o > 0) & (o < size)), F.array(size))
    return F.transform(at, lambda o: F.struct(o.cast("long").alias("at"), open_quote(F.substring(text, F.lit(1), o)).alias("open")))


def anchors_kept(rewritten: Column, anchors: Column) -> Column:
    """Whether a rewritten question still holds every anchor."""
    return F.forall(anchors, lambda a: F.contains(rewritten, a))
