"""Token counts, packing and mixing against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tandem.llm import mixing, packing, token_counts
from tandem.llm.tokens import encoder, vocabulary_dir

TEXTS = ["", None, "one", "a b  c\n\nd", "Ünï çödé 日本 text\twith odd　spaces  ", "don't stop, it's 1234 5678!", "<|endoftext|> is plain here", "x" * 5000, "word " * 3000, " lead", "trail ", "\r\n\x0b\x0c", "emoji 👩‍👩‍👧 é́"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts=TEXTS, sources=("a", "b", None)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(plain):
    rng = np.random.default_rng(5)
    alphabet = list("ab Z\n\t '.,é ßñ 0ñ日　ȿ١") + ["  ", "'s", "\u0085", " "]
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(500)]
    enc = encoder(vocabulary_dir())
    ids, n = enc.encode(pa.array(texts, pa.string()))
    assert np.split(ids, np.cumsum(n)[:-1])[4].tolist() == plain(texts[4])
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == plain(t), repr(t)


def test_histogram_answers_every_limit(spark, plain):
    lengths = [len(plain(t)) for t in TEXTS]
    rows = {r.context_limit: r for r in token_counts.token_counts(docs(spark)).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(lengths)
    for limit, r in rows.items():
        assert r.truncated_total == sum(min(x, limit) for x in lengths) and r.docs_longer == sum(x > limit for x in lengths)
        assert r.total_tokens == sum(lengths) and r.quantile == pytest.approx(sum(x <= limit for x in lengths) / len(lengths)) and r.tokens_within == sum(x for x in lengths if x <= limit)
    at = {r.limit: r for r in token_counts.at_limits(token_counts.token_counts(docs(spark)), [0, 2, 700, 10**6]).collect()}
    assert all(r.truncated_total == sum(min(x, k) for x in lengths) for k, r in at.items())


def test_empty_tables(spark):
    none = docs(spark, [])
    assert token_counts.token_counts(none).count() == 0 and packing.pack(none).count() == 0 and mixing.mix_sources(none).count() == 0


def check_pack(rows, texts, plain, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain(t), 1], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size and (at == size or at & (at - 1) == 0)  # no padding at all


def test_pack_is_whole_and_gapless(spark, plain):
    for partitions in (None, 3):
        check_pack(packing.pack(docs(spark), size=256, partitions=partitions).collect(), TEXTS, plain, 256)


def test_targets_by_filling(spark):
    rng = np.random.default_rng(2)
    sizes = {f"s{i}": int(rng.integers(0, 400)) for i in range(9)} | {None: 50}
    df = spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate(sizes.items())], SCHEMA)
    got = {r.source: r.target for r in mixing.targets(mixing.sizes(df)).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:  # the contract's own rounds
        left = total - sum(2 * sizes[s] for s in full)
        want = {s: 2.0 * sizes[s] if s in full else left * w[s] / sum(w[x] for x in w if x not in full) for s in w}
        above = {s for s in w if s not in full and want[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    assert all(got[s] == pytest.approx(want[s]) for s in w)


def test_mix_meets_budgets_and_repeats(spark):
    rng = np.random.default_rng(4)
    texts = ["w " * int(rng.integers(0, 30)) for _ in range(400)] + [None]
    df = docs(spark, texts, ("a", "a", "a", "b", None, "c"))
    rows = mixing.mix_sources(df, range_rows=16).collect()
    assert len(rows) == len(texts) and {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix_sources(df, range_rows=64).collect()}
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_mixed_documents_hold_the_words_taken(spark):
    texts = ["a b c", "d", "e f g h i", "", None, "j k l m n o p q r s t u v w"]
    df = docs(spark, texts)
    want = {r.doc_id: r.taken for r in mixing.mix_sources(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len((r.text or "").split())
    assert all(got[i] == n for i, n in want.items())


def test_repeated_rows_and_extra_columns(spark, plain):
    df = docs(spark, ["same text"] * 5).withColumns({"curve": F.lit("clash"), "spread": F.lit(1)})
    assert packing.pack(df, size=8).agg(F.sum("length")).first()[0] == 5 * (len(plain("same text")) + 1)
    assert mixing.mix_sources(df.withColumn("size", F.lit(7)).withColumn("doc_id", F.lit(1).cast("long"))).count() == 5


def test_projection_equals_plain_sums():
    texts = ["a b b c", "", "Ünï x " * 7, "the cat sat on the mat " * 20]
    words = packing.Words(pa.array(texts))
    key = dict(zip(words.strings(np.arange(len(words))), packing.mix(words.hashes()).tolist(), strict=True))
    got = packing.project(words)
    for t, point in zip(texts, got.tolist(), strict=True):
        tf = Counter(t.split())
        norm = sum((1 + np.log(n)) ** 2 for n in tf.values()) ** 0.5
        for k in range(packing.DIMENSIONS):
            x = sum((1 + np.log(n)) * (1 if key[w] >> k & 1 else -1) for w, n in tf.items()) / norm if tf else None
            want = 0 if x is None else min(255, int(256 * (0.5 + 0.5 * np.tanh(0.7978845608 * (x + 0.044715 * x**3)))))
            assert abs(point[k] - want) <= 1, (t, k)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_is_one_path_through_all_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_pieces_follow_the_curve_in_balanced_ranges(spark, plain):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, int(n)) % 500) for n in rng.lognormal(5, 1, 500)] + ["copy of a text " * 90] * 150
    df = docs(spark, texts)
    rows = sorted(packing.pack(df, partitions=6).collect(), key=lambda r: (r.sequence_id, r.offset))
    place = {r.doc_id: r.place for r in packing.place_keys(df).collect()}
    ranges = defaultdict(list)
    for r in rows:
        ranges[r.sequence_id >> 32].append(r)
    size = [sum(len(texts[r.doc_id]) for r in own if not r.start) for own in ranges.values()]
    assert len(ranges) == 6 and max(size) < 1.6 * np.mean(size)  # of bytes, though a hundred and fifty copies lie on one place of the curve
    last = -1
    for _, own in sorted(ranges.items()):
        order = [r.doc_id for r in own if not r.start]
        assert [place[i] for i in order] == sorted(place[i] for i in order) and place[order[0]] > last
        last = place[order[-1]]
        # the same documents poured into sequences one after another
        pieces, at, total = [], 0, sum(len(plain(texts[i])) + 1 for i in order)
        cuts = list(range(2048, total, 2048))
        tail, end = total % 2048, total - total % 2048
        while tail:
            step = 1 << (tail.bit_length() - 1)
            end, tail = end + step, tail - step
            cuts.append(end)
        cuts = sorted({*cuts, total})
        for i in order:
            n, start = len(plain(texts[i])) + 1, 0
            while start < n:
                stop = min(n, start + next(c for c in cuts if c > at) - at)
                pieces.append((i, start, stop - start))
                at, start = at + stop - start, stop
        assert [(r.doc_id, r.start, r.length) for r in own] == pieces
