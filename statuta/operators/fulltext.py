"""Full-text and vector channels for batches of questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import strings
from statuta.operators.ranking import top_k

#: What stands between words of lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def postings(docs: DataFrame, asked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, id, tf, len`` of the terms in ``asked(term)`` alone; the others go before anything is shuffled.  A document's postings lie together."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w")).select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return words.join(asked, "term", "left_semi").repartition("id").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", most_terms: int = 200_000) -> DataFrame:
    """``query_id, id, score, rank``: the k best documents of ``queries(query_id, text)`` by BM25.

    Only the postings of terms that some question asks for are made and scored.  Corpus counts are one row.  Up to ``most_terms`` terms of questions go to the documents, whose
    scores are added where their postings lie, so that pairs of questions and documents are never shuffled; more are joined by shuffles.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    near = F.broadcast if terms.count() <= most_terms else lambda x: x
    hits = postings(docs, near(terms.select("term").distinct()), id_col, text_col)
    # words are cut as for the postings: counting them by pattern takes several times as long
    n_docs, mean_len = docs.agg(F.count(F.lit(1)), F.avg(F.size(tokens(F.col(text_col))))).first()
    # counted by the column that scores read as well, so that both share one shuffle of words
    df = hits.groupBy("term").agg(F.count("len").alias("df"))
    idf = F.log(1.0 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = near(terms.join(df, "term").select("query_id", "term", idf.alias("idf")))
    # what goes by the term alone is made once a term, what goes by the posting once a posting; the rest for each question that meets it
    hits = hits.withColumn("over", F.col("tf") + k1 * (1.0 - b + b * F.col("len") / F.lit(mean_len).cast("double")))
    part = F.col("idf") * F.col("tf") * (k1 + 1.0) / F.col("over")
    scores = hits.join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return top_k(scores, k, ["query_id"], [F.round("score", 9).desc(), "id"])


def vector_candidates(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None, own: bool = False, shard_rows: int = 32_768, block: int = 8_192, cells: int = 1 << 20) -> DataFrame:
    """``query_id, id, score, rank``: exact cosine of ``vectors(id, v[, group])`` and ``queries(query_id, q)``, k best for each query and group.

    Rows in shards meet queries in blocks as matrix products of at most ``cells`` scores (or one query's) at a time, and each meeting gives back k rows a query.  So a worker
    holds one shard, one block and one slice of scores, however large the tables.  ``own`` keeps a query's own id.  Scores are rounded to 12 digits, ties go to the smaller id.
    """
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block))
    kind = F.col(group).cast("string") if group else F.lit("")
    left = vectors.select("id", "v", kind.alias("kind"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def unit(rows: pd.Series) -> np.ndarray:
        x = np.stack(rows.to_numpy()).astype("float64")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return x

    def best(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of scores the k best: query, id, score."""
        s = np.round(scores, 12)
        key = np.where(np.isnan(s), np.inf, -s)
        if not own:
            key[asked[:, None] == ids[None, :]] = np.inf
        least = np.partition(key, k - 1, axis=1)[:, k - 1 : k] if k < len(ids) else np.full((len(asked), 1), np.inf)
        row, at = np.nonzero(key <= least)
        if not own:
            other = asked[row] != ids[at]
            row, at = row[other], at[other]
        order = np.lexsort((ids[at], key[row, at], row))
        row, at = row[order], at[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return asked[row[first]], ids[at[first]], s[row[first], at[first]]

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "kind": pd.Series([], dtype="object"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})]
        if len(a) and len(b):
            asked, q = b["query_id"].to_numpy(), unit(b["q"])
            for name, part in a.groupby("kind"):
                ids, v = part["id"].to_numpy(), unit(part["v"])
                step = max(1, cells // len(ids))
                found = [best(asked[i : i + step], ids, q[i : i + step] @ v.T) for i in range(0, len(asked), step)]
                query, near, score = map(np.concatenate, zip(*found, strict=True))
                out.append(pd.DataFrame({"query_id": query, "kind": name, "id": near, "score": score}))
        return pd.concat(out[1:] or out)

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(nearest, "query_id long, kind string, id long, score double")
    return top_k(near, k, ["query_id", "kind"], [F.desc("score"), "id"])


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, id, score, rank``: exact cosine of all vectors for each question, its own id aside."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return vector_candidates(rows, queries.select("query_id", F.col(vector_col).alias("q")), k).select("query_id", "id", "score", "rank")


def chunks(text: Column, size: int = 160) -> Column:
    """A finished answer in pieces for sending."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def grounded_quotes(docs: DataFrame, items: DataFrame, block: int = 1000) -> DataFrame:
    """Distinct ``doc_id, item_id``: the items whose text stands in a document, white space and case aside.

    A quote's words but the first and last are whole words of the text, so candidates share its rarest one;
    quotes of one or two words, which may begin and end inside words, are tried against every document in blocks of ``block``.
    """
    d = docs.select("doc_id", F.lower(strings.squeeze(F.col("text"))).alias("_text"))
    q = items.select("item_id", F.lower(strings.squeeze(F.col("text"))).alias("_quote")).where("_quote <> ''").distinct()
    q = q.withColumn("_inner", F.expr("slice(split(_quote, ' '), 2, greatest(size(split(_quote, ' ')) - 2, 0))"))
    words = q.select("_quote", F.explode("_inner").alias("_word")).distinct()
    seen = d.select("doc_id", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")).join(words.select("_word").distinct(), "_word", "left_semi")
    often = seen.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = words.join(often, "_word", "left").groupBy("_quote").agg(F.min_by("_word", F.struct(F.coalesce("_n", F.lit(0)), "_word")).alias("_word"))
    near = rarest.join(seen, "_word").select("_quote", "doc_id").distinct()
    long = near.join(d, "doc_id").where(F.contains("_text", F.col("_quote"))).select("doc_id", "_quote").join(q, "_quote")
    few = q.where(F.size("_inner") == 0)
    blocks = few.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-few.count() // block)))).alias("_block")).agg(F.collect_list(F.struct("item_id", "_quote")).alias("_quotes"))
    found = F.filter("_quotes", lambda x: F.contains(F.col("_text"), x["_quote"]))
    short = d.crossJoin(blocks).select("doc_id", F.explode(found).alias("_q")).select("doc_id", "_q.item_id")
    return long.select("doc_id", "item_id").unionByName(short).distinct()
