"""Operator 12: periodic runs of words, found on a harmonic grid with difference-cover common extensions.

A run of period q holds at least four periods, hence three grid places that lie 3q apart at
most from its start: for every q the places 0, 3q, 6q, ... of a text are asked how far its words
agree with those q later, to the right and to the left. The places of all periods together are
n times a harmonic sum. How far two places agree is read from a difference cover of the period
31: comparing a few words leads both to places of the cover; only suffixes that begin in the
cover are sorted, by blocks of 31 words and then by doubling, and the least common prefix of
neighbours between two of them comes from a sparse table. Most places disagree within those few
words, so texts get their sorted suffixes only if some place needs them.

Words are compared as such (as codes of a dictionary of the batch), whatever they are. Null
texts and texts of blanks have no words and no run. Very long texts are taken whole: memory is
some hundred bytes per word of a batch of about a MB, or of one longer text. Ties are resolved
as the contract of the query says: greatest exponent, least start, least period. Rows are
independent of each other: repeated rows and ids repeat their result. A null id is read as the
empty string where faults are dealt. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.textkit import sub_batches

# A perfect difference set; any two places are led into it by moving both by less than 31.
COVER_PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
LEAST_WORDS, LEAST_PERIODS = 6, 4
GRID_ROWS = 1 << 20


class Extensions:
    """How many words agree from two places of an integer array on. Every text in it must end with a code found nowhere else."""

    def __init__(self, codes: np.ndarray):
        v, n = COVER_PERIOD, len(codes)
        self.n = n
        self.codes = np.concatenate([codes, np.full(v + 1, -1 - n, np.int64)])
        inside = np.zeros(v, bool)
        inside[list(COVER)] = True
        to = np.array([next(a for a in COVER if inside[(a + gap) % v]) for gap in range(v)])
        self.lead = (to[None, :] - np.arange(v)[:, None]) % v  # by the first place modulo v, and the gap modulo v
        self.order = self.rank = None

    def shift(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.lead[i % COVER_PERIOD, (j - i) % COVER_PERIOD]

    def few(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words that agree on the way into the cover, whether all do)."""
        most = self.shift(i, j)
        agree, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        while len(live):
            live = live[self.codes[i[live] + agree[live]] == self.codes[j[live] + agree[live]]]
            agree[live] += 1
            live = live[agree[live] < most[live]]
        return agree, agree == most

    def sort(self) -> None:
        """Ranks of the cover's suffixes, and a sparse table of the common prefixes of neighbours."""
        v, codes = COVER_PERIOD, self.codes
        place = np.flatnonzero(np.isin(np.arange(self.n) % v, COVER))
        m = len(place)
        _, word = np.unique(codes, return_inverse=True)
        at = np.full(self.n + v + 1, -1, np.int64)
        at[place] = np.arange(m)
        rank = np.zeros(m, np.int64)
        open_ = np.arange(m)
        for k in range(v):  # blocks of v words; only places that still tie are looked at
            if not len(open_):
                break
            rank, open_ = refine(rank, open_, word[place[open_] + k])
        levels, step = [rank], v
        while len(open_):  # then twice as many words each time
            after = place[open_] + step
            rank, open_ = refine(rank, open_, np.where(after < self.n, rank[at[np.minimum(after, self.n)]], -1))
            levels.append(rank)
            step *= 2
        order = np.argsort(rank)
        a, b = place[order[:-1]].copy(), place[order[1:]].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in reversed(range(len(levels))):
            ok = (a < self.n) & (b < self.n)
            same = ok.copy()
            same[ok] = levels[k][at[a[ok]]] == levels[k][at[b[ok]]]
            jump = same * (v << k)
            common += jump
            a, b = a + jump, b + jump
        live = np.flatnonzero((a < self.n) & (b < self.n))
        while len(live):
            live = live[codes[a[live]] == codes[b[live]]]
            for x in (common, a, b):
                x[live] += 1
        self.at, self.order = at, order
        self.rank = rank
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            last, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-w], last[w:]))

    def beyond(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from two places of the cover on."""
        if self.rank is None:
            self.sort()
        a, b = self.rank[self.at[i]], self.rank[self.at[j]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << int(k))])
        return out


def refine(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks told apart by `key` among the places `open_`, which tie; those that still tie. A rank is the number of lesser places."""
    order = np.lexsort((key, rank[open_]))
    members, r, k = open_[order], rank[open_][order], key[order]
    first = np.ones(len(members), bool)
    first[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    group = np.ones(len(members), bool)
    group[1:] = r[1:] != r[:-1]
    index = np.arange(len(members))
    start = np.maximum.accumulate(np.where(group, index, 0))
    head = np.maximum.accumulate(np.where(first, index, 0))
    new = rank.copy()
    new[members] = r + head - start
    size = np.diff(np.append(np.flatnonzero(first), len(members)))
    return new, np.sort(members[np.repeat(size > 1, size)])


def grid(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the harmonic grid, in parts: for each period up to a quarter of a text, every third multiple of it."""
    most = lengths // LEAST_PERIODS
    text = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (lengths[text] - period - 1) // (3 * period) + 1
    ends = np.cumsum(places)
    start = 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GRID_ROWS, side="right")))
        n, p, t = places[start:stop], period[start:stop], text[start:stop]
        which = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield t[which], 3 * p[which] * k, p[which]
        start = stop


def runs_of(codes: list[np.ndarray]) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of the texts, by text, start and period."""
    lengths = np.array([len(c) for c in codes], np.int64)
    base = np.cumsum(lengths + 1) - (lengths + 1)
    whole = np.concatenate([np.append(c, -1 - i) for i, c in enumerate(codes)]) if len(codes) else np.zeros(0, np.int64)
    kept = []
    for t, x, q in grid(lengths):
        i = base[t] + x
        hit = whole[i] == whole[i + q]
        kept.append((t[hit], x[hit], q[hit]))
    t, x, q = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 3
    if not len(t):
        return np.zeros((0, 4), np.int64)
    ahead, back = Extensions(whole), Extensions(mirrored(whole, base, lengths))
    i = base[t] + x
    right, more_right = ahead.few(i, i + q)
    j = base[t] + lengths[t] - x  # of the word before x in the mirrored text
    left, more_left = back.few(j - q, j)
    need = np.maximum(LEAST_WORDS, LEAST_PERIODS * q) - q
    able = more_right | more_left | (right + left >= need)
    t, x, q, i, j, need = (a[able] for a in (t, x, q, i, j, need))
    right, left, more_right, more_left = (a[able] for a in (right, left, more_right, more_left))
    if more_right.any() or more_left.any():
        texts = np.unique(t[more_right | more_left])  # only these are sorted
        sub = np.full(len(codes), -1)
        sub[texts] = np.arange(len(texts))
        part = np.concatenate([whole[base[k] : base[k] + lengths[k] + 1] for k in texts])
        own = np.cumsum(lengths[texts] + 1) - (lengths[texts] + 1)
        for value, more, first, words in ((right, more_right, x, part), (left, more_left, lengths[t] - x - q, mirrored(part, own, lengths[texts]))):
            if more.any():
                ext = Extensions(words)
                a = own[sub[t[more]]] + first[more]
                b = a + q[more]
                few, on = ext.few(a, b)
                few[on] += ext.beyond(a[on] + few[on], b[on] + few[on])
                value[more] = few
    good = right + left >= need
    found = np.stack([t[good], x[good] - left[good], q[good] + right[good] + left[good], q[good]], 1)
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :3] != found[:-1, :3]).any(1)  # of one stretch, its least period
    found = found[first]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def mirrored(whole: np.ndarray, base: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each text's words from the last to the first; the code that ends it stays at its end."""
    n = lengths + 1
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(whole)) - base[text]
    return whole[base[text] + np.where(at < lengths[text], lengths[text] - 1 - at, at)]


def with_fault(words: list[bytes], key: str) -> list[bytes]:
    """The words, or with the fault of the contract: a tenth of the texts repeat a stretch of theirs up to the end."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    times, rest = divmod(n - a, p)
    return words[:a] + stretch * times + stretch[:rest]


def periodic_runs(docs: DataFrame, faulty: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), collapsed_sha256: one row for each row of `docs`.

    Collapsed, a text is without the words that any run holds after its first period. `faulty` deals the contract's
    faults first, by crc32 of doc_id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, 1 << 20):
            words = [t.encode().split() for t in b.column(1).to_pylist()]  # bytes split at 0x20 and 0x09 to 0x0D only
            if faulty:
                words = [with_fault(w, "" if k is None else str(k)) for w, k in zip(words, b.column(0).to_pylist(), strict=True)]
            coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum([len(w) for w in words])
            found = runs_of(np.split(coded, ends[:-1]))
            first = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
            digests = []
            for i, ws in enumerate(words):
                own = found[first[i] : first[i + 1]]
                if len(own):
                    edge = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edge, own[:, 1] + own[:, 3], 1)
                    np.add.at(edge, own[:, 1] + own[:, 2], -1)
                    ws = [w for w, k in zip(ws, np.cumsum(edge[:-1]).tolist(), strict=True) if not k]
                digests.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields=list(run)))
            yield pa.record_batch([b.column(0), runs, pa.array(digests)], names=["doc_id", "runs", "collapsed_sha256"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(over, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string")


def run_digest(found: DataFrame) -> DataFrame:
    """The query's columns: n_runs, the run of the greatest exponent, and hashes of all runs and of the collapsed text."""
    # exponents are compared exactly: length_a * period_b against length_b * period_a
    better = lambda a, b: (a.length * b.period > b.length * a.period) | ((a.length * b.period == b.length * a.period) & ((a.start < b.start) | ((a.start == b.start) & (a.period < b.period))))
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x.start.cast("string"), F.lit(","), x.length.cast("string"), F.lit(","), x.period.cast("string"), F.lit("\n"))), "")
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
    exponent = F.expr("1000 * top.length div top.period")
    return one.select("doc_id", "n_runs", "top.start", "top.length", "top.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
