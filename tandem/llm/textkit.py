"""Vectorised word handling for Arrow batches of texts, shared by the operators.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D; because those
separators are ASCII, words can be cut on UTF-8 bytes. Everything here works on one
batch inside a Spark task: Spark partitions and shuffles the rows.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def process_cache() -> types.ModuleType:
    """Objects that outlive one task of a Python worker (tokenizers and the like)."""
    name = "_tandem_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, a bijection."""
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def mix_int(x: int) -> int:
    """`mix` for one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def sub_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 2 << 20, max_docs: int = 4000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `max_bytes` at most (one long text may hold more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        off, _ = buffers(col)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), start + max_docs, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls; offsets count from the array's own start."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data


class Words:
    """Words of a batch of texts: `doc` (row of the batch), `start`, `end` (bytes in `data`), `first` (per row, index of its first word)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        space, fold = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
        space[[9, 10, 11, 12, 13, 32]] = True
        fold[65:91] += 32
        self.off, raw = buffers(texts)
        n = len(raw)
        self.data = np.zeros(n + 8, np.uint8)
        self.data[:n] = fold[raw] if lower else raw
        gap = space[raw]
        edge = np.ones(n + 1, bool)  # a separator or another text stands before this byte
        edge[1:] = gap
        edge[self.off] = True
        inside = ~gap
        self.start = np.flatnonzero(inside & edge[:-1])
        edge[:n] = gap
        edge[n] = True
        last = self.off[1:][self.off[1:] > self.off[:-1]]
        after = edge[1:].copy()
        after[last - 1] = True
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed)

    def strings(self, index: np.ndarray) -> list[str]:
        view = self.data
        return [view[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(self.start[index], self.end[index], strict=True)]

    def lengths_in_code_points(self) -> np.ndarray:
        """Code points per word."""
        head = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=head[1:])
        return head[self.end] - head[self.start]

    def code_point_offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in code points of its own text."""
        head = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=head[1:])
        base = head[self.off[:-1]][self.doc]
        return head[self.start] - base, head[self.end] - base


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; `data` needs 8 bytes of padding. Spans of up to 8 bytes differ surely if of one length."""
    size = end - start
    keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))
    h = mix(eight[start] & keep[np.minimum(size, 8)])
    h = mix(h + size.astype(np.uint64) * M1 + np.uint64(seed & (2**64 - 1)))
    done, live = 8, np.flatnonzero(size > 8)
    while len(live):
        h[live] = mix(h[live] * M2 + (eight[start[live] + done] & keep[np.minimum(size[live] - done, 8)]))
        done += 8
        live = live[size[live] > done]
    return h


def shingles(words: Words, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `n` words; a text of 1 to n-1 words has one shingle, of all its words."""
    h = words.hashes() if hashes is None else hashes
    odd = [np.uint64(mix_int(k + 1) | 1) for k in range(n)]
    runs = np.maximum(words.count - n + 1, 0)
    row = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(words.first[:-1], runs)
    total = np.zeros(len(row), np.uint64)
    for k in range(n):
        total += h[at + k] * odd[k]
    short = np.flatnonzero((words.count > 0) & (runs == 0))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = words.count[short] > k
            extra[has] += h[words.first[short[has]] + k] * odd[k]
        row, total = np.concatenate([row, short]), np.concatenate([total, extra + np.uint64(1)])
        order = np.argsort(row, kind="stable")
        row, total = row[order], total[order]
    return row, mix(total)


class Lookup:
    """Positions of uint64 keys (well mixed) in a sorted array; -1 if absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - self.bits)
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << self.shift).astype(np.int32)
        run = np.diff(np.append(self.first, len(keys)))
        self.most = int(run.max(initial=0))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.first[(h >> self.shift).astype(np.int64)].astype(np.int64)
        for _ in range(self.most):
            at += self.keys[at] < h
        return np.where(self.keys[at] == h, at, -1) if len(self.keys) > 1 else np.full(len(h), -1)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return h.view(np.int64)


def prefix_starts(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of `n` rows begins in the sorted array `row` (n + 1 values)."""
    return np.searchsorted(row, np.arange(n + 1))
