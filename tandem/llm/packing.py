"""Operator 5: packing along a space-filling curve.

Each document's hashed word vector (1 + ln tf per word, scaled to length 1) is projected to
four dimensions by random signs, the point is placed on a Hilbert curve, documents are
range-sorted by that key, and neighbours along the curve fill sequences of `size` tokens
one after another. The borders of the ranges are quantiles of the bytes along the curve,
not of the documents, so every task gets about as much text. Every range packs its own
run; the rest at its end is cut into sequences whose lengths are powers of two, which
take no padding.

Null and empty texts consist of the end id alone. Equal curve positions (copies) are
spread over ranges by a hash of the row, so a large group of copies is no hot key.
Rows of equal id and text are packed as often as they occur. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import doc_text
from tandem.llm.textkit import Words, mix, sub_batches
from tandem.llm.tokens import encoder, vocabulary_dir

DIMENSIONS, BITS = 4, 8
UNIT = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"


def project(words: Words, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Grid coordinates of each text: its word vector, scaled to length 1, times random signs. Such sums are near standard normal, and their normal quantile is the coordinate."""
    h = words.hashes()
    order = np.lexsort((h, words.doc))
    row, h = words.doc[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else order
    weight = 1 + np.log(np.diff(np.append(at, len(h))))
    row, h, n = row[at], mix(h[at]), len(words.count)
    norm = np.sqrt(np.bincount(row, weight**2, n))
    out = np.zeros((n, dimensions), np.int64)
    some = norm > 0
    for k in range(dimensions):
        sign = ((h >> np.uint64(k)) & np.uint64(1)).astype(np.int64) * 2 - 1
        x = np.bincount(row, weight * sign, n)[some] / norm[some]
        share = 0.5 + 0.5 * np.tanh(0.7978845608 * (x + 0.044715 * x**3))
        out[some, k] = np.clip(share * (1 << bits), 0, (1 << bits) - 1)
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points with `bits` bits per coordinate."""
    x = points.T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            turn = (x[i] & q) > 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turn, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        gray = np.where(x[-1] & q, gray ^ (q - 1), gray)
        q >>= 1
    x ^= gray
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, curve: the documents with their position on the curve."""

    def keys(batches):
        for b in sub_batches(batches):
            yield pa.record_batch([b.column(0), b.column(1), pa.array(hilbert(project(Words(b.column(1)))), pa.int64())], names=["doc_id", "text", "curve"])

    return doc_text(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(keys, "doc_id long, text string, curve long")


def place_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, curve, place: the order of packing, the curve and under it a hash of the row."""
    return curve_keys(docs).withColumn("place", F.shiftleft("curve", 31).bitwiseOR(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 31) - 1))))


def borders(placed: DataFrame, ranges: int) -> list[int]:
    """The places that cut the corpus into `ranges` stretches of about equal bytes: quantiles of one row per UNIT bytes of each text, by a mergeable sketch of bounded size."""
    units = (F.octet_length("text") + 64) / F.lit(float(UNIT)) + F.pmod(F.col("place"), F.lit(1024)) / 1024.0  # a fraction counts as often as the hash is beyond it
    keys = placed.select("place", F.floor(units).cast("int").alias("n")).where("n > 0").select(F.explode(F.array_repeat("place", F.col("n"))).alias("place"))
    found = keys.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 16 * ranges)).first()[0] if ranges > 1 else []
    return sorted(set(found or []))


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per piece of a document: where it starts there, its length, and its place in a sequence.

    doc_id, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, curve. `partitions` is the number of ranges, the session's shuffle partitions by default.
    """
    folder = folder or vocabulary_dir()
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = place_keys(docs)
    cuts = docs.sparkSession.sparkContext.broadcast(np.array(borders(placed, partitions), np.int64))  # fewer than `partitions` longs

    @F.arrow_udf("int")
    def range_of(place: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts.value, place.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    ranged = placed.repartitionById(partitions, range_of("place")).sortWithinPartitions("place", "doc_id").select("doc_id", "text", "curve")

    def fill(batches):
        enc, base, place = encoder(folder), TaskContext.get().partitionId() << 32, 0
        # pieces of the sequence that is still open: (doc_id, start, ids, doc_tokens, curve)
        held: list[tuple] = []

        def rows(found):
            cols = list(zip(*found, strict=True)) if found else [[] for _ in range(8)]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in PIECES.split(", ")])

        def row(piece, sequence, offset):
            doc, start, ids, total, curve = piece
            return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset, curve

        for b in sub_batches(batches, 4 << 20, 20_000):
            ids, counts = enc.encode(b.column(1))
            docs_, curves = b.column(0).to_pylist(), b.column(2).to_pylist()
            out, at = [], 0
            for doc, curve, n in zip(docs_, curves, counts.tolist(), strict=True):
                own = np.empty(n + 1, "<u4")
                own[:n], own[n] = ids[at : at + n], end_id
                at += n
                start = 0
                while start <= n:
                    stop = min(n + 1, start + size - place % size)
                    held.append((doc, start, own[start:stop], n + 1, curve))
                    place += stop - start
                    start = stop
                    if place % size == 0:
                        offset = 0
                        for piece in held:
                            out.append(row(piece, place // size - 1, offset))
                            offset += len(piece[2])
                        held = []
            yield rows(out)
        out, sequence, rest = [], place // size, place % size
        room = offset = 0
        for doc, start, own, total, curve in held:
            used = 0
            while used < len(own):
                if not room:
                    room, offset, sequence = 1 << (rest.bit_length() - 1), 0, sequence + 1
                    rest -= room
                take = min(room, len(own) - used)
                out.append(row((doc, start + used, own[used : used + take], total, curve), sequence, offset))
                used, room, offset = used + take, room - take, offset + take
        yield rows(out)

    return ranged.mapInArrow(fill, PIECES)
