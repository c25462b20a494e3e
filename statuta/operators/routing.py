"""Rules that route a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern occurs, null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def intent(forced: Column, goal: Column, rule: Column, confident: Column, classifier: Column) -> Column:
    """Forced, else a reference goal, else a confident rule, else the classifier, else the rule, else FACTUAL."""
    return F.coalesce(forced, F.when(goal == "REFERS_TO", "MULTI_HOP"), F.when(confident, rule), classifier, rule, F.lit("FACTUAL"))


def temporal_source(explicit: Column, expressed: Column, differs: Column, historic: Column) -> Column:
    """Where a question's date comes from: CONFLICT of request and text, EXPLICIT, EXPRESSION, NONE for questions on validity or versions, else DEFAULT."""
    return F.when(explicit & expressed & differs, "CONFLICT").when(explicit, "EXPLICIT").when(expressed, "EXPRESSION").when(historic, "NONE").otherwise("DEFAULT")


def sub_queries(rows: DataFrame, text: str, gap: str) -> DataFrame:
    """A row for each part of a question with its place ``pos`` and ``depends_on``, the place before; blank parts go."""
    parts = rows.select("*", F.posexplode(F.split(text, gap)).alias("pos", "_part"))
    return parts.withColumns({"question": F.trim("_part"), "depends_on": F.when(F.col("pos") > 0, F.col("pos") - 1)}).where("question <> ''")
