"""Approximate nearest neighbours by collision-counting hashing.

Vectors are put on the unit sphere, one coordinate longer, so that the largest inner product is the nearest point.
The rows are dealt into shards.  A shard keeps one sorted array for each of many random projections.  A query uses the
projections in which it lies farthest out: there its windows hold few vectors and its neighbours are most frequent among them.  It opens a window around
its own projection in each, widens all windows in steps (virtual rehashing: a wider window is a union of the buckets of a
coarser grid centred at the query) and counts for each vector in how many windows it lies.

What a neighbour of similarity s collides in is known beforehand: given the query's projection c, that of the neighbour is
normal around s c, independently for each projection.  So a count that a neighbour falls short of with a probability of ``MISS`` at most follows from s, the
windows and no property of the data.  Vectors with that count for the k-th best similarity verified so far are verified, those with most
collisions first, and the count needed rises as better ones are found.  Windows are widened while that saves more verifications than it costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Projections; how many of them a query uses; half-width of the first windows, in typical projections of a unit vector; growth of the
#: windows; probability of missing a vector as good as the k-th one found.
PROJECTIONS, USED, WIDTH, GROWTH, MISS = 512, 32, 1.2, 1.3, 0.08
SHARDS, SHARD_ROWS, QUERY_BLOCK = 16, 8192, 4096

_GRID = np.linspace(-8.0, 8.0, 4097)
_PHI = np.array([0.5 * (1.0 + erf(x / sqrt(2.0))) for x in _GRID])


def normal_share(x: np.ndarray) -> np.ndarray:
    """The share of a normal variable below x."""
    return np.interp(x, _GRID, _PHI)


def directions(dim: int, n: int, seed: int = 1) -> np.ndarray:
    d = np.random.default_rng([seed, dim]).standard_normal((n, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def needed_collisions(centres: np.ndarray, radius: float, similarity: float, dim: int, miss: float) -> float:
    """The count that a vector of this similarity reaches with a probability of ``1 - miss``."""
    spread = sqrt(max(1.0 - similarity * similarity, 1e-12) / dim)
    off = centres * (1.0 - similarity)
    p = normal_share((off + radius) / spread) - normal_share((off - radius) / spread)
    return float(p.sum() - np.interp(1.0 - miss, _PHI, _GRID) * np.sqrt((p * (1.0 - p)).sum()))


class CollisionIndex:
    """The sorted projections of one shard; ``increments`` and ``verified`` tell what searches have cost."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 1):
        self.ids, self.vectors, self.increments, self.verified = ids, vectors, 0, 0
        self.longest = np.linalg.norm(vectors, axis=1).max()
        scaled = vectors / self.longest
        extra = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        self.axes = directions(vectors.shape[1] + 1, projections, seed)
        values = self.axes[:, :-1] @ scaled.T + self.axes[:, -1:] * extra
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)

    def windows(self, axes: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Queries x used projections: where the windows of this radius begin and end in the sorted arrays."""
        lo, hi = np.empty(axes.shape, np.int64), np.empty(axes.shape, np.int64)
        flat, at = axes.ravel(), np.argsort(axes, axis=None, kind="stable")
        cuts = np.flatnonzero(np.diff(flat[at])) + 1
        for same in np.split(at, cuts):
            values, c = self.sorted[flat[same[0]]], centres.ravel()[same]
            lo.ravel()[same], hi.ravel()[same] = np.searchsorted(values, c - radius, "left"), np.searchsorted(values, c + radius, "right")
        return lo, hi

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, used: int = USED, width: float = WIDTH, growth: float = GROWTH, miss: float = MISS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, position, score)`` of each query's k best verified vectors, without its own row."""
        dim, used = self.axes.shape[1], min(used, len(self.axes))
        all_centres = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ self.axes[:, :-1].T
        axes = np.argpartition(-np.abs(all_centres), used - 1, axis=1)[:, :used]
        centres = np.take_along_axis(all_centres, axes, axis=1)
        asked = [_Asked(self, i, q, k) for i, q in zip(query_ids, queries, strict=True)]
        radius, open_ = width / sqrt(dim), np.arange(len(queries))
        while len(open_):
            lo, hi = self.windows(axes[open_], centres[open_], radius)
            left = []
            for q, a, b in zip(open_.tolist(), lo.tolist(), hi.tolist(), strict=True):
                it = asked[q]
                it.widen(axes[q].tolist(), a, b)
                need = lambda s, q=q: needed_collisions(centres[q], radius, s, dim, miss)  # noqa: B023, E731
                if it.worth_widening(need) and radius < 2.0:
                    left.append(q)
                else:
                    it.verify_all(need)
            open_ = np.array(left, np.int64)
            radius *= growth
        found, scores = zip(*(it.best() for it in asked), strict=True)
        return np.repeat(query_ids, [len(x) for x in found]), np.concatenate(found), np.concatenate(scores)


class _Asked:
    """One query in a shard: its counts, and what has been verified."""

    def __init__(self, index: CollisionIndex, query_id: int, query: np.ndarray, k: int):
        self.index, self.query, self.k = index, query, k
        n = len(index.ids)
        self.own = np.flatnonzero(index.ids == query_id)
        self.counts = np.zeros(n, np.int64)
        self.counts[self.own] = -(1 << 40)  # a verified vector's count is far below any that is needed
        self.rest = n - len(self.own)
        self.found, self.scores = np.zeros(0, np.int64), np.zeros(0)  # the k best, and what ties with the last
        self.start = self.end = None
        self.cost, self.increments, self.unit = np.inf, 0, float(np.linalg.norm(query) * index.longest)

    def widen(self, axes: list[int], lo: list[int], hi: list[int]) -> None:
        order = self.index.order
        if self.start is None:
            new = [order[a, x:y] for a, x, y in zip(axes, lo, hi, strict=True)]
        else:
            new = [order[a, x:y] for a, l, s, e, h in zip(axes, lo, self.start, self.end, hi, strict=True) for x, y in ((l, s), (e, h)) if x < y]
        if new:
            joined = np.concatenate(new)
            self.counts += np.bincount(joined, minlength=len(self.counts))
            self.increments += len(joined)
            self.index.increments += len(joined)
        self.start, self.end = lo, hi

    def verify(self, at: np.ndarray) -> None:
        scores = self.index.vectors[at] @ self.query
        self.counts[at] = -(1 << 40)
        self.rest -= len(at)
        self.index.verified += len(at)
        found, scores = np.concatenate([self.found, at]), np.concatenate([self.scores, scores])
        if len(scores) > self.k:  # a product may differ from the exact score in its last digits
            best = scores >= np.partition(scores, -self.k)[-self.k] - 1e-9 * self.unit
            found, scores = found[best], scores[best]
        self.found, self.scores = found, scores

    def kth(self) -> float:
        """The similarity of the k-th best verified vector, -1 before there are k."""
        return max(-1.0, float(np.partition(self.scores, -self.k)[-self.k]) / self.unit) if len(self.scores) >= self.k else -1.0

    def worth_widening(self, need) -> bool:
        """Whether wider windows have lately saved more than they cost; the vectors that collide most are verified first."""
        if self.rest <= 4 * self.k:
            return False
        self.verify(np.argpartition(self.counts, -2 * self.k)[-2 * self.k :])
        above = np.count_nonzero(self.counts >= need(self.kth()))
        cost = self.increments + self.index.vectors.shape[1] * above
        better, self.cost = cost < 0.9 * self.cost, cost
        return better

    def verify_all(self, need) -> None:
        """Verifies all vectors that collide often enough, those that collide most first."""
        all_ = self.rest <= 4 * self.k
        at = np.flatnonzero(self.counts >= (0 if all_ else need(self.kth())))
        at = at[np.argsort(-self.counts[at], kind="stable")]
        counts, width = -self.counts[at], 4 * self.k
        while len(at):
            self.verify(at[:width])
            at, counts, width = at[width:], counts[width:], 2 * width
            if not all_ and len(at):
                left = int(np.searchsorted(counts, -need(self.kth()), "right"))
                at, counts = at[:left], counts[:left]

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        scores = (self.index.vectors[self.found] * self.query).sum(axis=1)
        best = np.lexsort((self.index.ids[self.found], -scores))[: self.k]
        return self.found[best], scores[best]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("dim", F.size("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = PROJECTIONS, used: int = USED, width: float = WIDTH, growth: float = GROWTH, miss: float = MISS, least_shards: int = SHARDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k largest inner products found, best first, ties to the smaller id.

    A row's own id is no candidate.  Vectors that are null, zero or hold null or non-finite components take no part, and
    vectors of another length than the query's are not compared.  Rows that repeat an id count once, the
    lexically smallest vector.  Queries with no candidate give no row.

    Every row is indexed.  Rows are dealt by hash to shards of about SHARD_ROWS, queries in blocks of QUERY_BLOCK
    visit each shard, and each shard gives back k rows a query.
    """
    rows = _usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.*")
    asked = _usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.*")
    n_rows, n_queries = vectors.count(), queries.count()
    shards, blocks = max(least_shards, -(-n_rows // SHARD_ROWS)), max(1, -(-n_queries // QUERY_BLOCK))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    left = rows.select("dim", spread.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def shard(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        data = data.sort_values("vec_id")
        index = CollisionIndex(data["vec_id"].to_numpy(), np.stack(data["v"].to_numpy()), projections)
        asked, parts = ask["vec_id"].to_numpy(), []
        vectors = np.stack(ask["v"].to_numpy())
        for at in range(0, len(asked), 256):
            q, found, score = index.search(asked[at : at + 256], vectors[at : at + 256], k, used, width, growth, miss)
            parts.append(pd.DataFrame({"query_id": q, "vec_id": index.ids[found], "score": score}))
        return pd.concat(parts)

    keys = ["dim", "shard", "block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(shard, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
