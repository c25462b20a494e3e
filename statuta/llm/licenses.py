"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of a text that occurs in a template votes for the diagonal ``word position
- template position``.  A phrase is found where one diagonal has all its votes.  For longer notices,
neighbouring diagonals (words added or lost in between) are merged, and a merged run counts when it
covers enough of the notice within a span of about its length.  Only grams whose first word begins a template's gram are joined: others can't vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2
#: How far apart diagonals may be to be merged, which share of a notice must be covered, and how long its span may be.
SLACK, COVER, STRETCH = 4, 0.6, 1.5
#: Lower-casing is of A-Z alone; Java's and DuckDB's pattern of what separates words after it.
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and the opening words of public license notices, lower-cased.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "cc",
}


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """``(number, label, is_phrase, words)`` of every template."""
    both = [(label, True, text.split()) for text, label in PHRASES.items()] + [(label, False, text.split()) for text, label in NOTICES.items()]
    return [(i, *t) for i, t in enumerate(both)]


def gram_rows(k: int = K) -> list[tuple[str, int, int, int, str, bool]]:
    """``(gram, template, place, grams in it, label, is_phrase)`` for each k-gram of each template."""
    return [
        (" ".join(words[i : i + k]), number, i, len(words) - k + 1, label, phrase)
        for number, label, phrase, words in templates()
        for i in range(len(words) - k + 1)
    ]


def values_sql(k: int = K) -> str:
    return ", ".join(f"('{g}', {t}, {p}, {n}, '{label}', {str(phrase).lower()})" for g, t, p, n, label, phrase in gram_rows(k))


def _grams(spark: SparkSession, k: int) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values_sql(k)} AS t(t_gram, template, place, n_grams, label, phrase)")


def scan_licenses(docs: DataFrame, k: int = K, slack: int = SLACK, cover: float = COVER, stretch: float = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices.

    ``score`` is 1 where a phrase stands, else the largest covered share of a notice, 0 without votes.
    Null and empty texts have no words: zero counts, null places and empty labels.  Very long texts are scanned whole.
    Rows are told apart by doc_id (null included) and text, so repeated rows each give the same result, and
    other columns, whatever their names, are not read.  No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), A_Z, A_Z.lower())
    words = F.array_remove(F.split(text, GAP), "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), words.alias("words"))
    firsts = sorted({g[0].split()[0] for g in gram_rows(k)})
    exploded = rows.select("doc_id", "h", "words", F.posexplode("words").alias("pos", "word")).where(F.col("word").isin(firsts))
    grams = exploded.select("doc_id", "h", "pos", F.array_join(F.slice("words", F.col("pos") + 1, k), " ").alias("gram"))
    votes = (
        grams.join(F.broadcast(_grams(spark, k)), (F.xxhash64("gram") == F.xxhash64("t_gram")) & (F.col("gram") == F.col("t_gram")))
        .select("doc_id", "h", "template", "label", "phrase", "n_grams", (F.col("pos") - F.col("place")).alias("diagonal"), "place")
        .distinct()
    )
    keys = ["doc_id", "h", "template", "label", "phrase", "n_grams"]
    along = votes.groupBy(*keys, "diagonal").agg(F.count(F.lit(1)).alias("n_votes"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    order = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")
    # A phrase stays on one diagonal: each is a run of its own.
    run = F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.sum(F.coalesce(new, F.lit(0))).over(order))
    runs = (
        along.withColumn("run", run)
        .groupBy(*keys, "run")
        .agg(
            F.sum("n_votes").alias("n_votes"),
            F.min("diagonal").alias("start"),
            (F.max(F.col("diagonal") + F.col("hi")) - F.min(F.col("diagonal") + F.col("lo")) + k).alias("span"),
        )
        .withColumn("share", F.least(F.col("n_votes") / F.col("n_grams"), F.lit(1.0)))
        .withColumn("base", F.col("phrase") & (F.col("n_votes") == F.col("n_grams")))
        .withColumn("notice", ~F.col("phrase") & (F.col("share") >= cover) & (F.col("span") <= stretch * (F.col("n_grams") + k - 1)))
    )
    found = runs.groupBy("doc_id", "h").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") | F.col("notice"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("base"), 1.0).when(~F.col("phrase"), F.col("share")).otherwise(0.0)).alias("score"),
        F.sum(F.col("notice").cast("long")).alias("n_notices"),
    )
    counted = rows.select("doc_id", "h", F.size("words").cast("long").alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "f_doc", "h": "f_h"})
    zero = F.lit(0).cast("long")
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("h") == F.col("f_h")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_notices", zero).alias("n_notices"),
    )


def oracle(k: int = K, slack: int = SLACK, cover: float = COVER, stretch: float = STRETCH) -> str:
    """The same in DuckDB SQL."""
    return f"""
WITH grams(t_gram, template, place, n_grams, label, phrase) AS (VALUES {values_sql(k)}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{A_Z}', '{A_Z.lower()}'), '{GAP}'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(range(len(words))) AS pos FROM d),
votes AS (SELECT DISTINCT doc_id, template, label, phrase, n_grams, pos - place AS diagonal, place
  FROM w JOIN grams ON t_gram = array_to_string(words[pos + 1 : pos + {k}], ' ')),
along AS (SELECT doc_id, template, label, phrase, n_grams, diagonal, count(*) AS n_votes, min(place) AS lo, max(place) AS hi
  FROM votes GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {slack} THEN 1 ELSE 0 END AS gap FROM along),
marked AS (SELECT *, CASE WHEN phrase THEN diagonal ELSE sum(gap) OVER (PARTITION BY doc_id, template ORDER BY diagonal) END AS run FROM gaps),
runs AS (SELECT doc_id, template, label, phrase, n_grams, run, sum(n_votes) AS n_votes, min(diagonal) AS start,
  max(diagonal + hi) - min(diagonal + lo) + {k} AS span FROM marked GROUP BY ALL),
judged AS (SELECT *, least(n_votes / n_grams, 1.0) AS share, phrase AND n_votes = n_grams AS base,
  NOT phrase AND n_votes / n_grams >= {cover} AND span <= {stretch} * (n_grams + {k} - 1) AS notice FROM runs),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base OR notice)), ','), '') AS labels,
  max(CASE WHEN base THEN 1.0::DOUBLE WHEN NOT phrase THEN share::DOUBLE ELSE 0.0::DOUBLE END) AS score,
  count(*) FILTER (notice) AS n_notices FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM d LEFT JOIN found USING (doc_id)"""
