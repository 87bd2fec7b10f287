"""Operator 7: toxicity by the nearest labelled examples.

Labels are learned from rows whose crc32(doc_id) mod 4 is not 2. A sample of at most
`max_examples` labelled rows, half of it kept for toxic ones, is used; a third of it
calibrates, the rest is the reference set. That bound is what makes the index small
enough to send to every task.

Terms are words and their prefixes of five bytes; all terms that at least two texts of the
reference set hold span the space. A term weighs (1 + ln tf) * idf * rf**2: idf from its
document frequency in all documents, and rf, the relevance factor of supervised term
weighting, log2(2 + a / c), where a and c are the shares of the toxic and of the other
reference texts that hold the term (one text is added to the latter). No term is left
out, words that toxic texts favour count more.

Every whole text is compared with the reference set by exact cosine: a block-max inverted
index keeps each term's postings in blocks of texts with the block's greatest weight,
blocks are scored by descending upper bound, and the search stops once no block can beat
the k-th best. Distance-weighted votes of the k nearest give a raw score; an isotonic fit
on the calibration texts, weighted back to the label rates of all labelled rows, makes it
a probability, and the neighbours are the evidence.

Null texts are empty; a text without any term of the space gets the rate of such texts
among the calibration texts, or else of all labels. Repeated label rows count once, a
document with both labels counts as toxic, of a labelled id with several texts the one of
the least MD5 counts; null labels and ids are left out. Without labels of both kinds every
score is 0. Rows of equal text get equal scores. Extra columns are ignored. Empty tables
give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import bucket_of, cut
from tandem.llm.textkit import Lookup, Words, span_hashes, sub_batches

MAX_EXAMPLES, NEIGHBOURS, BLOCK, PREFIX = 3_600, 15, 512, 5


def term_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all terms: words without ASCII punctuation at the ends, lower case also in Latin-1, and their prefixes of five bytes."""
    words = Words(texts, lower=True)
    d = words.data
    lead = np.concatenate([[0], d[:-1]])
    capital = (lead == 0xC3) & (d >= 0x80) & (d <= 0x9E) & (d != 0x97)
    d[capital] += 0x20
    mark = np.zeros(256, bool)
    mark[33:127] = True
    mark[48:58] = mark[65:91] = mark[97:123] = False
    start, end = words.start.copy(), words.end.copy()
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live]) & mark[d[start[live]]]]
        start[live] += 1
    live = np.arange(len(start))
    while len(live):
        live = live[(start[live] < end[live]) & mark[d[end[live] - 1]]]
        end[live] -= 1
    size = end - start
    some = np.flatnonzero(size >= 2)
    long_ = np.flatnonzero(size > PREFIX)
    row = np.concatenate([words.doc[some], words.doc[long_]])
    return row, np.concatenate([span_hashes(d, start[some], end[some], 1), span_hashes(d, start[long_], start[long_] + PREFIX, 2)])


def distinct_counts(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, times), sorted by row and key."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else order
    return row[at], key[at], np.diff(np.append(at, len(row)))


def vectors_of(texts: pa.Array, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each row, term, tf) of a batch, in terms of `lookup`."""
    row, key = term_keys(texts)
    col = lookup(key)
    row, col, tf = distinct_counts(row[col >= 0], col[col >= 0])
    return np.searchsorted(row, np.arange(len(texts) + 1)), col, tf


def examples(docs: DataFrame, labels: DataFrame, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y, fits (used for calibration), text of the sample, and the number of labelled rows per label."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    own = own.where((bucket_of(F.col("doc_id"), 4) != 2) & F.col("y").isin(0, 1))
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = lambda y: own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples // 2)
    chosen = F.broadcast(part(1).unionByName(part(0)))  # at most max_examples rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    return rows.select("doc_id", "y", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("fits"), "text"), totals


class BlockMaxIndex:
    """The reference set in TF-IDF space; see the module's text. Row r of the set is text ids[r] with label y[r]; (rows, cols, tf) are its terms."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, ids: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray, tf: np.ndarray):
        order = np.lexsort((rows, cols))
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        self.postings = terms, weight, ids, y, small(rows[order]), small(np.bincount(cols, minlength=len(terms))), small(tf[order])
        self.steps, self.levels, self.base = np.array([0.0, 1.0]), np.array([0.0, 1.0]), 0.0
        self.build()

    def __getstate__(self):  # what is sent to tasks: a few bytes per posting
        return self.postings, self.steps, self.levels, self.base

    def __setstate__(self, state):
        self.postings, self.steps, self.levels, self.base = state
        self.build()

    def build(self):
        """Weights, and entries: one for each term and block, with its postings and its greatest weight."""
        terms, self.weight, self.ids, self.y, rows, per_term, tf = self.postings
        self.lookup, self.n = Lookup(terms), len(self.ids)
        cols = np.repeat(np.arange(len(terms)), per_term)
        self.rows, w = rows.astype(np.int32), (1 + np.log(tf.astype(float))) * self.weight[cols]
        self.w = w / np.sqrt(np.bincount(self.rows, w * w, self.n))[self.rows]
        self.blocks = -(-self.n // BLOCK)
        where = cols * self.blocks + self.rows // BLOCK
        at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else where
        self.begin = np.append(at, len(where))
        self.block = self.rows[at] // BLOCK
        self.most = np.maximum.reduceat(self.w, at) if len(at) else np.zeros(0)
        self.first = np.searchsorted(cols[at], np.arange(len(terms) + 1))

    def query(self, cols: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest texts and their cosines, exactly; ties go to the lower row."""
        w = (1 + np.log(tf)) * self.weight[cols]
        w = w / np.sqrt((w * w).sum())
        entry, n = ranges(self.first[cols], self.first[cols + 1])
        w = np.repeat(w, n)
        block = self.block[entry]
        bound = np.bincount(block, w * self.most[entry], self.blocks)
        by = np.argsort(-bound, kind="stable")
        by = by[bound[by] > 0]
        turn = np.full(self.blocks, len(by))
        turn[by] = np.arange(len(by))
        turn = turn[block]
        score, done, step, kth = np.zeros(self.n), 0, max(2, len(by) // 4), 0.0
        while done < len(by) and bound[by[done]] >= kth - 1e-12:
            use = np.flatnonzero((turn >= done) & (turn < done + step))
            at, n = ranges(self.begin[entry[use]], self.begin[entry[use] + 1])
            score += np.bincount(self.rows[at], self.w[at] * np.repeat(w[use], n), self.n)
            done, step = done + step, step * 2
            some = score[score > 0]
            if len(some) > k:
                kth = np.partition(some, len(some) - k)[len(some) - k]
        near = np.flatnonzero((score >= kth) & (score > 0))
        near = near[np.lexsort((near, -score[near]))][:k]
        return near, np.minimum(score[near], 1.0)

    def raw(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Distance-weighted vote, with a weak pull to the label rate."""
        w = 1 / (1.05 - cosine)
        return float(((w * self.y[near]).sum() + 0.5 * self.base) / (w.sum() + 0.5))

    def calibrated(self, raw: float) -> float:
        return float(np.clip(np.interp(raw, self.steps, self.levels), 0, 1))


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges one after another, and the length of each range."""
    n = stop - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares increasing fit: (mean x, level) of its pools. Equal x are one point."""
    at, which = np.unique(x, return_inverse=True)
    weight = np.bincount(which, w)
    pools: list[list[float]] = []
    for own in zip(at * weight, np.bincount(which, y * w), weight, strict=True):
        pools.append(list(own))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many of all texts each term stands: summed inside tasks, then over them. One row per term reaches the driver."""
    held = texts.sparkSession.sparkContext.broadcast(Lookup(terms))

    def count(batches):
        total = np.zeros(len(terms), np.int64)
        for b in sub_batches(batches):
            _, col, _ = vectors_of(b.column(0), held.value)
            total += np.bincount(col, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    seen = texts.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(terms), np.int64)
    df[seen["term"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    return df


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> BlockMaxIndex | None:
    """The calibrated index of the reference set; None without labelled texts of both kinds."""
    rows, totals = examples(docs, labels, max_examples)
    rows = cut(rows)

    def keys(batches):
        for b in sub_batches(batches):
            row, key, tf = distinct_counts(*term_keys(b.column(2)))
            at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], names=["doc_id", "y", "keys", "tf"])

    table = rows.where("not fits").select("doc_id", "y", "text").mapInArrow(keys, "doc_id long, y int, keys array<long>, tf array<long>").orderBy("doc_id").toArrow()  # at most max_examples rows
    y = table["y"].to_numpy().astype(np.int64)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return None
    size = np.diff(np.concatenate([[0], np.cumsum([len(x) for x in table["keys"]])]))
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in table[c].chunks])
    row, key, tf = np.repeat(np.arange(len(y)), size), flat("keys").view(np.uint64), flat("tf")
    terms, col = np.unique(key, return_inverse=True)
    kept = np.bincount(col, minlength=len(terms)) >= 2
    row, tf, col = row[kept[col]], tf[kept[col]], (np.cumsum(kept) - 1)[col[kept[col]]]
    terms = terms[kept]
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    idf = np.log((docs.count() + 1) / (document_frequencies(texts, terms) + 1))
    toxic = np.bincount(col, y[row], len(terms)) / n1
    other = (np.bincount(col, 1 - y[row], len(terms)) + 1) / n0
    weight = np.maximum(idf, 0.01) * np.log2(2 + toxic / other) ** 2
    index = BlockMaxIndex(terms, weight, table["doc_id"].to_numpy(), y, row, col, tf)
    index.base = totals[1] / (totals[0] + totals[1])
    held = docs.sparkSession.sparkContext.broadcast(index)

    def rate(batches):
        for b in sub_batches(batches):
            at, col, tf = vectors_of(b.column(1), held.value.lookup)
            raw = [held.value.raw(*held.value.query(col[a:z], tf[a:z])) if z > a else None for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.float64())], names=["y", "raw"])

    tried = rows.where("fits").select("y", "text").mapInArrow(rate, "y int, raw double").toPandas()  # at most max_examples rows
    held.unpersist()
    own, raw = tried["y"].to_numpy(np.int64), tried["raw"].to_numpy(float)
    if len(set(own)) == 2:
        weight = np.where(own == 1, totals[1] / (own == 1).sum(), totals[0] / (own == 0).sum())
        none = np.isnan(raw)
        if (~none).any():
            index.steps, index.levels = isotonic(raw[~none], own[~none].astype(float), weight[~none])
        if none.any():
            index.base = float((weight * own)[none].sum() / weight[none].sum())
    return index


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the five nearest examples) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def rate(batches):
        index: BlockMaxIndex | None = held.value
        known: dict[bytes, tuple[float, list[int]]] = {}  # of texts seen before
        for b in sub_batches(batches):
            n = b.num_rows
            score, evidence = np.full(n, index.base if index else 0.0), [[] for _ in range(n)]
            if index:
                at, col, tf = vectors_of(b.column(2), index.lookup)
                for i in np.flatnonzero(np.diff(at)):
                    c, t = col[at[i] : at[i + 1]], tf[at[i] : at[i + 1]]
                    name = hashlib.md5(c.tobytes() + t.tobytes()).digest()
                    if name not in known:
                        near, cosine = index.query(c, t)
                        if len(known) > 20_000:
                            known.clear()
                        known[name] = (index.calibrated(index.raw(near, cosine)), index.ids[near[:5]].tolist())
                    score[i], evidence[i] = known[name]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return rows.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
