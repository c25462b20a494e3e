"""Set operations on ranked units and token sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_contexts(rows: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """The first row of each unit over contexts in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(unit).orderBy(*order))).where("_n = 1").drop("_n")


def token_overlap(text: Column, other: Column) -> Column:
    """The share of a text's distinct tokens that the other has too."""
    mine = F.array_distinct(F.split(F.lower(text), " "))
    return F.size(F.array_intersect(mine, F.split(F.lower(other), " "))) / F.size(mine)


def subtract_intervals(start: Column, end: Column, excluded: Column) -> Column:
    """What is left of [start, end) without the sorted, disjoint ``excluded`` array of structs (s, e)."""
    gaps = F.transform(excluded, lambda x, i: F.struct(F.greatest(start, F.when(i == 0, start).otherwise(F.get(excluded, i - 1)["e"])).alias("s"), F.least(end, x["s"]).alias("e")))
    last = F.struct(F.greatest(start, F.coalesce(F.get(excluded, F.size(excluded) - 1)["e"], start)).alias("s"), end.alias("e"))
    return F.filter(F.array_append(gaps, last), lambda g: g["s"] < g["e"])
