"""Operator 8: exact top-k inner products through an impact-ordered index.

Each block of candidates keeps, per dimension, postings in segments of equal quantised
value. A query's contribution in a dimension is shifted so that none is negative; its
segments are then worked off across all dimensions by descending impact. After every
stretch, what a vector could still gain is bounded by the next segment of each
dimension. The search stops only when that bound proves that all members of the top k
are among the vectors still possible, and rescores those exactly.

A block of candidates is dealt to one place and indexed once; the queries stream past it
in batches, so memory depends on the block alone. Only where there are more than
`slice_rows` queries does a block go to several places, one for each slice of them.

Vectors that are null, or hold null or non-finite components, take no part, nor do null
ids. Shorter vectors are filled with zeros. Ties go to the smaller id, repeated
candidates stay apart, and of repeated query ids each row is searched and the best k of
all count. A query never finds rows of its own id. Components and scores beyond the
range of a long are held at its limits, for ranking too. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import cut

EXACT = float(1 << 52)  # sums up to it are exact as doubles
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v: components as floor(scale * x), for vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))


class ImpactIndex:
    """Postings of one block of candidates, per dimension in segments of equal quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = 12):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = self.vectors.min(0).astype(float), self.vectors.max(0).astype(float)
        self.greatest = np.maximum(np.abs(self.low), np.abs(self.high))
        self.segments = []  # (dimension, members, values, least, greatest) of each segment
        for d in range(self.vectors.shape[1]):
            v = self.vectors[:, d].astype(float)
            width = max(1.0, (self.high[d] - self.low[d]) // levels + 1)
            level = ((v - self.low[d]) // width).astype(int)
            by = np.argsort(level, kind="stable")
            for p in np.split(by, np.flatnonzero(np.diff(level[by])) + 1):
                self.segments.append((d, p, v[p], v[p].min(), v[p].max()))
        self.dimension = np.array([s[0] for s in self.segments], int)
        self.least, self.most = (np.array([s[k] for s in self.segments]) for k in (3, 4))
        self.plain = self.vectors.astype(float)

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (-score, id), exactly."""
        n, q = len(self.ids), query.astype(float)
        if float(np.abs(q) @ self.greatest) >= EXACT:
            exact = self.vectors.astype(object) @ query.astype(object)
            return self.best(np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in exact], np.int64), np.arange(n), own, k)
        base = np.minimum(q * self.low, q * self.high)
        weight = q[self.dimension]
        impact = np.maximum(weight * self.least, weight * self.most) - base[self.dimension]
        steps = np.lexsort((self.dimension, -impact))
        steps = steps[weight[steps] != 0]
        gained = np.zeros(n)
        left = {d: [*impact[steps[self.dimension[steps] == d]], 0.0] for d in np.flatnonzero(q)}  # impacts still to come, in order
        nth = dict.fromkeys(left, 0)
        bound = full = checked = sum(x[0] for x in left.values())
        possible = np.arange(n)
        others = np.flatnonzero(self.ids != own)  # rows of the query's id are no results, however many there are
        for step in steps.tolist():
            d, p, values, _, _ = self.segments[step]
            gained[p] += q[d] * values - base[d]
            nth[d] += 1
            bound += left[d][nth[d]] - left[d][nth[d] - 1]
            if len(others) > 4 * k and bound < 0.7 * full and bound < 0.85 * checked:
                checked = bound
                floor = np.partition(gained[others], len(others) - k)[len(others) - k]
                possible = np.flatnonzero(gained + bound >= floor)
                if len(possible) <= max(64, n // 8):
                    break  # the proof: whoever is outside has at most gained + bound, below k others
        scores = self.plain[possible] @ q
        return self.best(scores.astype(np.int64), possible, own, k)

    def best(self, scores: np.ndarray, rows: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        keep = self.ids[rows] != own
        scores, ids = scores[keep], self.ids[rows][keep]
        if len(scores) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        by = np.lexsort((ids, -scores.astype(float), -scores.astype(object))) if len(scores) and scores.min() == -(2**63) else np.lexsort((ids, -scores))
        return [(-int(scores[i]), int(ids[i])) for i in by[:k]]


def grid(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of the lists, filled with zeros up to `width`, cut beyond it."""
    out = np.zeros((len(lists), width), np.int64)
    off = lists.offsets.to_numpy()
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(off)
    row, at = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = 32_768, slice_rows: int = 1 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query. Inputs: vec_id, v as `quantised` gives them."""
    n_blocks = max(1, -(-candidates.count() // block))
    n_slices = max(1, -(-queries.count() // slice_rows))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = candidates.select(place(n_blocks).alias("b"), upto(n_slices).alias("s"), F.lit(0).alias("side"), "vec_id", "v")
    asks = queries.select(upto(n_blocks).alias("b"), place(n_slices).alias("s"), F.lit(1).alias("side"), "vec_id", "v")
    dealt = cand.unionByName(asks).repartition("b", "s").sortWithinPartitions("b", "s", "side")

    def search(batches):
        where, ids, lists, index = None, [], [], None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in range(3)])
            starts = np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
            found = []
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                own, vec, v = tuple(at[:2, a].tolist()), batch.column(3).slice(a, z - a), batch.column(4).slice(a, z - a)
                if own != where:
                    where, ids, lists, index = own, [], [], None
                if not at[2, a]:
                    ids.append(vec.to_numpy())
                    lists.append(v)
                    continue
                if lists and index is None:
                    width = max(int(np.diff(x.offsets.to_numpy()).max()) for x in lists)
                    index = ImpactIndex(np.concatenate(ids), np.concatenate([grid(x, max(width, 1)) for x in lists]))
                    ids, lists = [], []
                if index is not None:
                    for i, q in zip(vec.to_pylist(), grid(v, index.vectors.shape[1]), strict=True):
                        found += [(i, c, -score) for score, c in index.search(q, i, k)]
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_every(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by `every`, against all rows."""
    all_rows = cut(quantised(vectors))
    return top_k(all_rows.where(F.col("vec_id") % every == 0), all_rows, k)


TOP_K_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
