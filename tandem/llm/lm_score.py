"""Operator 4: language-model scores from a weighted backoff automaton.

Every n-gram of one to three words of the training texts becomes a state with a failure
arc; none is left out, so the model grows with the corpus. A state's arcs carry

    p(w | h) = (1 - f(h)) * c(hw) / c(h) + f(h) * p(w | h'),

its failure arc carries f(h) to the next shorter context h', and the root is the add-0.5
unigram model over the vocabulary and one unknown word. The failure weight is the
Good-Turing mass of unseen continuations of contexts with about the same count (buckets of
half octaves): of all training positions after such contexts, the share whose n-gram
occurs there alone. A context seen once cannot show whether it repeats; its weight is
halfway between that of contexts seen twice and 1. All conditional distributions sum to 1.
Read from left to right, a text carries its state from token to token and adds up the
logarithms; as a state depends on the last two tokens only, the positions of a block of
texts are traversed in one vectorised step.

The automaton is never gathered in one place. Texts are dealt into blocks of about
`block_bytes`; each block sends its distinct n-grams, with their training counts there, to
the parts of the key space (about `part_keys` n-grams each), and gets their counts in the
corpus back: the part of the automaton that it needs. A message is a sorted run of keys,
stored as differences. There are blocks * parts messages, so both sizes should grow with
the executors' memory on very large corpora (256 MB and 64 million at 100 TB).

N-grams are keyed by hashes with 18 bits more than it takes to number the corpus's bytes,
so that one in some hundred thousands meets another at most, at every size. Texts travel
compressed.

Null texts are empty and consist of the end token. Repeated rows are learned and scored as
often as they occur. Extra columns are ignored. Empty tables give no rows; without
training rows all words are unknown. A block holds at least one whole text and all rows
that share a non-null id and the text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import bucket_of, cut
from tandem.llm.textkit import Words, mix, sub_batches

END = np.uint64(0x9E3779B97F4A7C15)  # the end token, and the context before a text's first word
BLOCK_BYTES, PART_KEYS, SPARE_BITS, BUCKETS = 6 << 20, 3_000_000, 18, 128
ASKED = "part int, block int, n long, keys binary, counts binary"
ANSWERED = "block int, part int, n long, counts binary, words long"
COUNTED = "doc_id array<long>, held_out array<boolean>, n_tokens array<long>, counts binary, words long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the n-gram of context key a and word b."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(31))))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token keys, position of each text's end token): every text's words and its end token, in order."""
    words = Words(texts, lower=True)
    ends = np.cumsum(words.count + 1) - 1
    keys = np.empty(len(words) + len(ends), np.uint64)
    is_end = np.zeros(len(keys), bool)
    is_end[ends] = True
    keys[is_end], keys[~is_end] = END, words.hashes()
    return keys, ends


def ngrams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct n-gram keys, per order and token the place of the n-gram that ends there, end of each text). The lowest two bits are the order; a text's first token has no trigram, its bigram is there instead."""
    keys, ends = tokens(texts)
    before = np.empty_like(keys)
    before[1:], before[:1] = keys[:-1], END
    before[ends[:-1] + 1] = END
    pairs = follow(before, keys)
    triples = np.empty_like(keys)
    triples[1:] = follow(pairs[:-1], keys[1:])
    cut_ = lambda h, order: ((h >> np.uint64(64 - bits)) & ~np.uint64(3)) | np.uint64(order)
    triples = cut_(triples, 3)
    starts = np.append(0, ends[:-1] + 1)
    pairs = cut_(pairs, 2)
    triples[starts] = pairs[starts]
    own, place = np.unique(np.concatenate([cut_(keys, 1), pairs, triples]), return_inverse=True)
    return own, place.reshape(3, -1), ends


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def dealt(rows: DataFrame) -> DataFrame:
    """doc_id, held_out, block, size, text: the rows with their texts compressed."""

    def squeeze(batches):
        for b in sub_batches(batches):
            texts = [t.encode() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(map(len, texts), pa.int64()), pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())], names=["doc_id", "held_out", "block", "size", "text"])

    return rows.select("doc_id", "held_out", "block", "text").mapInArrow(squeeze, "doc_id long, held_out boolean, block int, size long, text binary")


def texts_of(table: pa.Table) -> pa.Array:
    return pa.array([pa.decompress(z, n, "zstd", asbytes=True) for z, n in zip(table.column("text").to_pylist(), table.column("size").to_pylist(), strict=True)], pa.binary()).cast(pa.string())


def asks(blocks: DataFrame, parts: int, bits: int) -> DataFrame:
    """part, block, n, keys, counts: the n-grams of each block with their training counts there, dealt over the key space."""
    borders = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)

    def ask(table: pa.Table) -> pa.Table:
        own, place, ends = ngrams(texts_of(table), bits)
        learn = ~table.column("held_out").to_numpy()
        size = np.diff(np.append(-1, ends))
        used = np.repeat(learn, size)
        used = np.stack([used, used, used])
        used[2, np.append(0, ends[:-1] + 1)] = False
        n = np.bincount(place[used], minlength=len(own))
        cuts = np.concatenate([[0], np.searchsorted(own, borders), [len(own)]])
        some = np.flatnonzero(np.diff(cuts))
        step = np.diff(own, prepend=np.uint64(0))
        step[cuts[some]] = own[cuts[some]]  # every message starts with a whole key
        spans = [(cuts[i], cuts[i + 1]) for i in some]
        cols = [some, np.full(len(some), table.column("block")[0].as_py()), np.diff(cuts)[some]]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array([packed(step[a:z]) for a, z in spans], pa.binary()), pa.array([packed(n[a:z]) for a, z in spans], pa.binary())], names=["part", "block", "n", "keys", "counts"])

    return blocks.groupBy("block").applyInArrow(ask, ASKED)


def answers(asked: DataFrame) -> DataFrame:
    """block, part, n, counts: the corpus counts of each message's n-grams, in its order; words: in one message of each part, the number of its words in training texts."""

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(k, n), dtype=np.uint64) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([unpacked(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        distinct, which = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, which, counts)
        ends = np.cumsum(sizes)
        back = [packed(total[which[z - n : z]]) for z, n in zip(ends, sizes, strict=True)]
        words = np.zeros(len(sizes), np.int64)
        words[0] = int((((distinct & np.uint64(3)) == 1) & (total > 0)).sum())
        return pa.table([table.column("block"), table.column("part"), table.column("n"), pa.array(back, pa.binary()), pa.array(words)], names=["block", "part", "n", "counts", "words"])

    return asked.groupBy("part").applyInArrow(answer, ANSWERED)


def counted(blocks: DataFrame, answered: DataFrame, bits: int) -> DataFrame:
    """One row per block: its texts' ids, lengths, and for every token the counts of the word, the bigram and the trigram that end there."""

    def count(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise RuntimeError("the documents changed while they were scored")
        own, place, ends = ngrams(texts_of(texts), bits)
        order = np.argsort(found.column("part").to_numpy())
        blobs, sizes = found.column("counts").to_pylist(), found.column("n").to_pylist()
        total = np.concatenate([unpacked(blobs[i], sizes[i]) for i in order]) if len(order) else np.zeros(0, np.uint64)
        if len(total) != len(own):
            raise RuntimeError("the documents changed while they were scored")
        at = total[place]
        at[2, np.append(0, ends[:-1] + 1)] = 0
        words = sum(found.column("words").to_pylist())
        return pa.table([pa.array([x], t) for x, t in ((texts.column("doc_id").to_pylist(), pa.list_(pa.int64())), (texts.column("held_out").to_pylist(), pa.list_(pa.bool_())), (np.diff(np.append(-1, ends)).tolist(), pa.list_(pa.int64())), (packed(at.reshape(-1)), pa.binary()), (words, pa.int64()))], names=["doc_id", "held_out", "n_tokens", "counts", "words"])

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(count, COUNTED)


def contexts(n: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the one-word and of the two-word context of each token (0 where a text's first token has no two-word one), from its counts n (3 x tokens)."""
    one, two = np.empty_like(n[0]), np.empty_like(n[1])
    one[1:], two[1:] = n[0, :-1], n[1, :-1]
    starts = np.append(0, ends[:-1] + 1)
    one[starts], two[starts] = n[0, ends], 0  # before a text stands the end token
    return one, two


def bucket(n: np.ndarray) -> np.ndarray:
    """Half octaves of the counts: 0 for 1, 2 for 2, 3 for 3."""
    return np.minimum((2 * np.log2(np.maximum(n, 1).astype(float))).astype(np.int64), BUCKETS - 1)


def failure_weights(rows: DataFrame) -> np.ndarray:
    """2 x BUCKETS: f of one-word and of two-word contexts by their counts' bucket, from all training positions. At most 2 * BUCKETS rows reach the driver."""

    def tally(batches):
        seen = np.zeros((2, 2, BUCKETS), np.int64)  # per length of the context: positions, and those whose n-gram occurs once
        for b in batches:
            for held, size, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, ends = unpacked(blob, 3 * sum(size)).reshape(3, -1), np.cumsum(size) - 1
                learn = np.repeat(~np.array(held, bool), size)
                for k, context in enumerate(contexts(n, ends)):
                    own = learn & (context > 0)
                    where = bucket(context[own])
                    seen[k, 0] += np.bincount(where, minlength=BUCKETS)
                    seen[k, 1] += np.bincount(where, n[k + 1][own] == 1, BUCKETS).astype(np.int64)
        k, at = np.nonzero(seen[:, 0])
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(seen[k, 0, at]), pa.array(seen[k, 1, at])], names=["k", "bucket", "n", "once"])

    sums = rows.select("held_out", "n_tokens", "counts").mapInArrow(tally, "k int, bucket int, n long, once long").groupBy("k", "bucket").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()
    n, once = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for r in sums:
        n[r["k"], r["bucket"]], once[r["k"], r["bucket"]] = r["n"], r["once"]
    f = (once + 1) / (n + 2)
    f[:, 0] = (f[:, 2] + 1) / 2
    return f


def traverse(n: np.ndarray, ends: np.ndarray, n_train: int, vocabulary: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token, the probability at the root, and that of the state which the text carries there."""
    n = n.astype(float)
    p = root = (n[0] + 0.5) / (n_train + 0.5 * (vocabulary + 1))
    for k, context in enumerate(contexts(n, ends)):
        fail = np.where(context > 0, f[k, bucket(context)], 1.0)
        p = (1 - fail) * n[k + 1] / np.maximum(context, 1) + fail * p
    return root, p


def language_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from rows whose crc32(doc_id) mod 5 is not 1."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket_of(F.col("doc_id"), 5) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)).alias("n")).first()["n"]
    bits = min(64, math.ceil(math.log2(size + 2)) + SPARE_BITS)
    parts = max(1, math.ceil(size / 2.4 / part_keys))
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id are no hot key
    blocks = dealt(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(max(1, math.ceil(size / block_bytes)))).cast("int")))
    found = cut(counted(blocks, answers(asks(blocks, parts, bits)), bits))
    totals = found.agg(
        F.coalesce(F.sum(F.expr("aggregate(zip_with(held_out, n_tokens, (h, n) -> if(h, 0L, n)), 0L, (a, x) -> a + x)")), F.lit(0)).alias("n"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("v"),
    ).first()
    n_train, vocabulary = int(totals["n"]), int(totals["v"])
    held = spark.sparkContext.broadcast(failure_weights(found))

    def score(batches):
        for b in batches:
            for i in range(b.num_rows):
                sizes = np.array(b.column(2)[i].as_py(), np.int64)
                n, ends = unpacked(b.column(3)[i].as_py(), 3 * int(sizes.sum())).reshape(3, -1), np.cumsum(sizes) - 1
                root, p = traverse(n, ends, n_train, vocabulary, held.value)
                first = np.append(0, ends[:-1] + 1)
                cols = [sizes, np.add.reduceat((n[0] > 0).astype(np.int64), first), np.add.reduceat(np.log10(root), first), np.add.reduceat(np.log10(p), first)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, *map(pa.array, cols)], names=[x.split()[0] for x in SCORED.split(", ")])

    out = found.select("doc_id", "held_out", "n_tokens", "counts").mapInArrow(score, SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
