"""Operator 3: near duplicates by improved consistent weighted sampling.

1. Document frequencies of five-word shingles, over all documents, in a count sketch of
   2**20 slots: its size does not depend on the corpus. A shingle weighs
   tf * (1 + ln((N+1)/(df+1)) / (4 ln(N+2))), a damped inverse document frequency.
2. Improved consistent weighted sampling draws `BANDS * ROWS` samples per text; two texts
   agree in each with a probability equal to their weighted Jaccard similarity.
3. Bands of ROWS samples give bucket keys. Equal texts are one vertex from here on.
4. A bucket's most central text (the one whose buckets are largest) is its leader and is
   compared with all others. Texts of a bucket that are not in one class then meet in
   blocks of bounded size, whatever the bucket's size, and are compared there.
5. Candidates whose samples agree in at least `estimate` are verified on whole texts by
   exact weighted Jaccard similarity; groups of a leader are salted.
6. Connected components of the verified links are the classes.

Null texts are empty; all texts without words are one class, as equal texts are. Texts
of one to four words have one shingle. Rows of equal id and text get equal rows. A null
id is kept and never becomes a representative unless all ids of its class are null.
Extra columns are ignored, or kept as they are by `deduplicated`, whatever their names.
Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import bitmap, cut, hot_join, in_bitmap
from tandem.llm.textkit import Words, mix, mix_int, prefix_starts, process_cache, shingles, sub_batches

N_WORDS, BANDS, ROWS = 5, 10, 4
SLOT_BITS, BLOCK = 20, 4096
LEAST_BITS, MOST_BITS = 24, 30  # of the map that picks wanted texts: eight bits a text between these
LEFT, RIGHT = 512, 2048  # texts on the sides of a block, on average
SALTED = 256  # texts that one leader meets in one group


def plain_text() -> Column:
    """The column text; null and blank texts as empty ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.when(F.rlike(text, F.lit(r"^[\x20\x09-\x0D]*$")), F.lit("")).otherwise(text)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, v (128-bit digest of the text), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).select("doc_id", digest(F.col("text")).alias("v"), "text")


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 52-bit shingle, tf) of a batch of at most 4,096 texts, sorted by row and shingle."""
    row, h = shingles(Words(texts), N_WORDS)
    key = np.sort((row.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), tf


def slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """The count sketch: documents per slot, summed over tasks block by block as they stream in. 8 MB reach the driver."""

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in sub_batches(batches, column="text"):
            _, h, _ = bags(b.column(0))
            total += np.bincount(slots(h), minlength=1 << SLOT_BITS)
        parts = [total[i : i + BLOCK].astype("<i8" if total.max() > 2**31 - 1 else "<i4").tobytes() for i in range(0, len(total), BLOCK)]
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def add(batches):
        sums = {}
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(x, "<i4" if len(x) == 4 * BLOCK else "<i8").astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    parts = texts.select("text").mapInArrow(count, schema)
    rows = parts.repartition("block").mapInArrow(add, schema).collect()  # 256 rows of 32 KB
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for r in rows:
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i8")
    return total


def idf_table(df: np.ndarray, n_docs: int) -> np.ndarray:
    return (1 + np.log((n_docs + 1) / (np.minimum(df, n_docs) + 1)) / (4 * np.log(n_docs + 2))).astype(np.float32)


def gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 Gamma(2, 1) draws, their inverses, and the logarithms of as many others."""
    held = process_cache().__dict__
    if "gamma" not in held:
        u = np.random.default_rng(11).random((4, 1 << 16))
        r, c = -np.log1p(-u[0]) - np.log1p(-u[1]), -np.log1p(-u[2]) - np.log1p(-u[3])
        held["gamma"] = (np.maximum(r, 1e-6), 1 / np.maximum(r, 1e-6), np.log(np.maximum(c, 1e-300)))
    return held["gamma"]


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n_rows x k consistent samples as 32-bit values (0 for rows without shingles)."""
    r_of, inverse, log_c = gamma_tables()
    out = np.zeros((n_rows, k), np.uint32)
    log_w, low, at = np.log(weight.astype(np.float64)), np.uint64(0xFFFF), prefix_starts(row, n_rows)
    a = 0
    while a < n_rows:  # stretches of rows that fit the processor's cache
        b = int(np.searchsorted(at, at[a] + 24_000, side="right")) - 1
        b = min(max(b, a + 1), n_rows)
        x, lw = h[at[a] : at[b]], log_w[at[a] : at[b]]
        some = np.flatnonzero(at[a + 1 : b + 1] > at[a:b])
        if len(x):
            seg = (at[a:b] - at[a])[some]
            for j in range(k):
                z = (x + np.uint64(mix_int(2 * j + 101))) * np.uint64(mix_int(2 * j + 102) | 1)
                z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                z ^= z >> np.uint64(29)
                i = (z & low).astype(np.int64)
                r, beta = r_of[i], (z >> np.uint64(32)).astype(np.float64) * 2.0**-32
                t = np.floor(lw * inverse[i] + beta)
                value = log_c[((z >> np.uint64(16)) & low).astype(np.int64)] - r * (t - beta + 1)
                out[a + some, j] = (mix(np.minimum.reduceat(value, seg).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        a = b
    return out


def signatures(texts: DataFrame, idf) -> DataFrame:
    """doc_id, v, sig (samples), keys (one per band, which its last four bits name; null for texts without words)."""

    def sign(batches):
        for b in sub_batches(batches, column="text"):
            row, h, tf = bags(b.column(2))
            n = b.num_rows
            sig = samples(row, h, tf * idf.value[slots(h)], n)
            keys = np.zeros((n, BANDS), np.uint64)
            for band in range(BANDS):
                for r in range(ROWS):
                    keys[:, band] = mix(keys[:, band] * np.uint64(31) + sig[:, band * ROWS + r].astype(np.uint64) + np.uint64(band + 1))
                keys[:, band] = (keys[:, band] & ~np.uint64(15)) | np.uint64(band)
            none = np.bincount(row, minlength=n) == 0
            as_list = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), kind))
            keys_ = as_list(keys.view(np.int64), pa.int64())
            keys_ = pa.array([None if e else v for e, v in zip(none, keys_.to_pylist(), strict=True)], pa.list_(pa.int64())) if none.any() else keys_
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_list(sig.view(np.int32), pa.int32()), keys_], names=["doc_id", "v", "sig", "keys"])

    return texts.mapInArrow(sign, "doc_id long, v binary, sig array<int>, keys array<long>")


def leader_pairs(members: DataFrame, vertices: DataFrame, estimate: float) -> DataFrame:
    """Each bucket's most central text b with every other text a of it, once over all buckets, if their samples agree in a share of at least `estimate`: a, b, n (texts of the bucket), ra, rb (ids that hold their texts).

    b, a leader, may stand in very many pairs, so its samples come to its buckets first, of which it has at most BANDS.
    """
    own = vertices.select("v", "rep", "sig")
    lead = members.groupBy("key").agg(F.max(F.struct("c", "v"))["v"].alias("v"), F.first("n").alias("n"))
    lead = lead.join(own.hint("merge"), "v").select("key", "n", F.col("v").alias("b"), F.col("rep").alias("rb"), F.col("sig").alias("sb"))
    met = members.select("key", "v").join(lead.hint("merge"), "key").where(F.col("v") != F.col("b")).join(own.hint("merge"), "v")
    same = F.aggregate(F.zip_with("sig", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    met = met.where(same >= estimate * BANDS * ROWS).select(F.col("v").alias("a"), "b", "n", F.col("rep").alias("ra"), "rb")
    # each pair once, with the leader as b: its text is sent to its groups, not the other way round
    once = met.groupBy(F.greatest("a", "b").alias("g"), F.least("a", "b").alias("l")).agg(F.min(F.struct("b", "a", "ra", "rb")).alias("p"), F.max("n").alias("n"))
    return once.select("p.a", "p.b", "n", "p.ra", "p.rb")


def wanted_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of `wanted` (v, rep, and more) with their texts: one row of each group of equal texts, that of the id `rep`."""
    wanted = cut(wanted)
    width = min(MOST_BITS, max(LEAST_BITS, (8 * wanted.count()).bit_length()))
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("v").alias("k")), "k", width))  # 2 to 128 MB

    @F.arrow_udf("boolean")
    def maybe(k: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, k.to_numpy(zero_copy_only=False).view(np.uint64)))

    # of a group of equal texts only the representative's row is shuffled, keyed by its id too, so that no large group meets one task
    some = texts.where(maybe(F.xxhash64("v"))).withColumnsRenamed({"v": "w", "doc_id": "id"})
    return some.join(wanted.hint("merge"), (F.col("v") == F.col("w")) & F.col("id").eqNullSafe(F.col("rep"))).drop("w", "id", "rep")


def verify(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """a, b, similarity: pairs at `threshold` or more by exact weighted Jaccard similarity of whole texts."""
    held = wanted_texts(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("ra").alias("rep")), F.struct(F.col("b").alias("v"), F.col("rb").alias("rep")))).alias("x")).select("x.*").distinct(), texts)
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / SALTED)).alias("salt"))
    members = dealt.select("b", "salt", F.col("a").alias("v"), F.lit(1).alias("turn"))
    leads = dealt.select("b", "salt", F.col("b").alias("v"), F.lit(0).alias("turn")).distinct()
    dealt_out = members.unionByName(leads).join(held.hint("merge"), "v").select("b", "salt", "v", "text", "turn").repartition("b", "salt").sortWithinPartitions("b", "salt", "turn", "v")

    def compare(batches):
        lead, lead_h, lead_w = None, None, None
        for b in sub_batches(batches, column="text"):
            row, h, tf = bags(b.column(3))
            w = tf * idf.value[slots(h)].astype(np.float64)
            at = prefix_starts(row, b.num_rows)
            found = []
            for i, (own, v, turn) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                hi, wi = h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]
                if not turn:
                    lead, lead_h, lead_w = own, hi, wi
                    continue
                if own != lead or not len(hi) or not len(lead_h):
                    continue
                j = np.minimum(np.searchsorted(lead_h, hi), len(lead_h) - 1)
                common = np.minimum(wi, lead_w[j])[lead_h[j] == hi].sum()
                similarity = common / (wi.sum() + lead_w.sum() - common)
                if similarity >= threshold:
                    found.append((v, own, float(similarity)))
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return dealt_out.mapInArrow(compare, "a binary, b binary, similarity double")


def components(edges: DataFrame, steps: int = 0) -> DataFrame:
    """v, label: the least vertex of each vertex's component. Neighbours' least labels, then labels' labels, until nothing changes; after `steps` steps, if given, some vertex of the component, so that a component may have several labels."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("beyond"))
        new = cut(step.join(jump.hint("merge"), "label").select("v", F.least("label", "beyond").alias("label"), (F.col("old") != F.least("label", "beyond")).alias("moved")))
        labels, steps = new.select("v", "label"), steps - 1
        if not steps or not new.where("moved").limit(1).count():
            return labels


def links(texts: DataFrame, vertices: DataFrame, idf, threshold: float, estimate: float) -> DataFrame:
    """a, b, similarity: verified links between different texts (steps 3 to 5)."""
    banded = vertices.where(F.col("keys").isNotNull()).select("v", "copies", F.explode("keys").alias("key"))
    size = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = banded.join(size.hint("merge"), "key")
    central = held.groupBy("v").agg((F.sum("n") + F.max("copies")).alias("c"))
    members = cut(held.join(central.hint("merge"), "v").select("key", "v", "c", "n"))
    found = cut(verify(cut(leader_pairs(members, vertices, estimate)), texts, idf, threshold).dropDuplicates(["a", "b"]))
    return found.unionByName(cut(cross_links(members, components(found, steps=1), texts, vertices, idf, threshold, estimate)))


def agreement(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """In how many samples each row of `x` agrees with each row of `y`; 0 if they share a band before `band`, whose bucket compares them."""
    same, earlier = np.zeros((len(x), len(y)), np.int8), np.zeros((len(x), len(y)), bool)
    for at in range(BANDS):
        shared = np.ones(same.shape, bool)
        for k in range(at * ROWS, (at + 1) * ROWS):
            equal = x[:, k, None] == y[None, :, k]
            same += equal
            shared &= equal
        if at < band:
            earlier |= shared
    same[earlier] = 0
    return same


def with_partners(dealt: DataFrame, least: int, first_band: bool = False) -> DataFrame:
    """The rows of `dealt` (key, i, j: a block; side, v, label, sig), without sig, that agree in `least` samples with a row of the block's other side and another label. With `first_band`, the last four bits of `key` name its band, and pairs that share a band before it don't count."""

    def meet(batches):
        name, held, lab, sig, hit = None, [], np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.int32), np.zeros(0, bool)

        def lefts():
            at = 0
            for part in held:
                yield part.filter(pa.array(hit[at : at + part.num_rows]))
                at += part.num_rows

        for b in batches:
            group = np.stack([b.column(c).to_numpy() for c in range(4)])
            starts = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1, [b.num_rows]]) if b.num_rows else [0]
            label, own = b.column(5).to_numpy(), b.column(6).flatten().to_numpy().reshape(-1, BANDS * ROWS)
            rows = b.select(["key", "i", "j", "side", "v", "label"])
            found = np.zeros(b.num_rows, bool)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                here = tuple(group[:3, s].tolist())
                if not group[3, s]:
                    if here != name:
                        yield from lefts()
                        name, held, lab, sig, hit = here, [], lab[:0], sig[:0], hit[:0]
                    held.append(rows.slice(s, e - s))
                    lab, sig, hit = np.append(lab, label[s:e]), np.concatenate([sig, own[s:e]]), np.append(hit, np.zeros(e - s, bool))
                elif here == name:
                    step = max(1, (1 << 18) // len(lab))
                    for x in range(s, e, step):
                        y = min(e, x + step)
                        near = (agreement(own[x:y], sig, here[0] & 15 if first_band else 0) >= least) & (label[x:y, None] != lab[None, :])
                        found[x:y] = near.any(1)
                        hit |= near.any(0)
            yield rows.filter(pa.array(found))
        yield from lefts()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(meet, "key long, i long, j long, side int, v binary, label long")


def cross_links(members: DataFrame, labels: DataFrame, texts: DataFrame, vertices: DataFrame, idf, threshold: float, estimate: float) -> DataFrame:
    """a, b, similarity: verified links between texts that share a bucket but no class so far, so many that all of them are joined.

    One end of such a pair is outside the bucket's largest class. These ends are dealt over blocks of about LEFT
    texts, each of which meets the whole bucket in parts of about RIGHT texts, so that no task holds a bucket. Samples
    alone are dealt over all blocks, and a pair counts in the bucket of its first common band only; the texts follow into those blocks in which they have a partner by samples. There
    pairs are compared, and what leaves a block are links alone.
    """
    own = cut(members.join(labels.hint("merge"), "v", "left").select("key", "v", F.coalesce("label", "v").alias("label")))
    classes = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("most"))
    # leaders have met all others of buckets of two
    mixed = cut(classes.select("key", "n", F.col("most.label").alias("main"), (F.col("n") - F.col("most.m")).alias("o")).where((F.col("o") > 0) & (F.col("n") > 2)))
    own = own.join(mixed.hint("merge"), "key").withColumn("rest", F.col("label") != F.col("main")).withColumn("lefts", F.ceil(F.col("o") / LEFT)).withColumn("rights", F.ceil(F.col("n") / RIGHT))
    own = cut(own.select("key", "v", F.xxhash64("label").alias("label"), "rest", "lefts", "rights"))
    signed = own.join(vertices.select("v", "sig").hint("merge"), "v")
    at_left, at_right = F.pmod(F.xxhash64("v"), F.col("lefts")), F.pmod(F.xxhash64("v", F.lit(1)), F.col("rights"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = signed.where("rest").select("key", at_left.alias("i"), upto("rights").alias("j"), F.lit(0).alias("side"), "v", "label", "sig")
    right = signed.select("key", upto("lefts").alias("i"), at_right.alias("j"), F.lit(1).alias("side"), "v", "label", "sig")
    least = int(np.ceil(estimate * BANDS * ROWS - 1e-9))
    near = cut(with_partners(left.unionByName(right), least, first_band=True))
    whole = wanted_texts(near.select("v").distinct().join(vertices.select("v", "rep", "sig").hint("merge"), "v"), texts)
    dealt = near.join(whole.hint("merge"), "v").select("key", "i", "j", "side", "v", "label", "sig", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def meet(batches):
        name, ids, lab, sig, held, heavy = None, [], np.zeros(0, np.int64), None, [], np.zeros(0)
        for b in sub_batches(batches, column="text"):
            group = np.stack([b.column(c).to_numpy() for c in range(4)])
            starts = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1, [b.num_rows]])
            v, label = b.column(4).to_pylist(), b.column(5).to_numpy().copy()
            own = b.column(6).flatten().to_numpy().reshape(-1, BANDS * ROWS)
            row, h, tf = bags(b.column(7))
            w, at = tf * idf.value[slots(h)].astype(np.float64), prefix_starts(row, b.num_rows)
            bag = [(h[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            total = np.array([x.sum() for _, x in bag])
            found = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                here = tuple(group[:3, s].tolist())
                if not group[3, s]:
                    if here != name:
                        name, ids, lab, sig, held, heavy = here, [], lab[:0], own[:0], [], heavy[:0]
                    ids, held = ids + v[s:e], held + bag[s:e]
                    lab, sig, heavy = np.append(lab, label[s:e]), np.concatenate([sig, own[s:e]]), np.append(heavy, total[s:e])
                    continue
                if here != name:
                    continue
                step = max(1, (1 << 18) // len(lab))
                for x in range(s, e, step):
                    y = min(e, x + step)
                    same = agreement(own[x:y], sig, here[0] & 15)
                    same[label[x:y, None] == lab[None, :]] = 0
                    # weights in common are at most those of the lighter text
                    same[np.minimum(total[x:y, None], heavy) < (threshold - 1e-9) * np.maximum(total[x:y, None], heavy)] = 0
                    r, l = np.nonzero(same >= least)
                    for k in np.argsort(-same[r, l], kind="stable").tolist():  # those that agree most come first: what they join needs no more pairs
                        i, j = x + int(r[k]), int(l[k])
                        if label[i] == lab[j]:
                            continue
                        (hi, wi), (hj, wj) = bag[i], held[j]
                        p = np.minimum(np.searchsorted(hj, hi), len(hj) - 1)
                        common = np.minimum(wi, wj[p])[hj[p] == hi].sum()
                        similarity = common / (total[i] + heavy[j] - common)
                        if similarity >= threshold:
                            found.append((v[i], ids[j], float(similarity)))
                            gone = label[i]
                            label[label == gone], lab[lab == gone] = lab[j], lab[j]
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return dealt.mapInArrow(meet, "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, estimate: float = 0.6) -> DataFrame:
    """doc_id, class_id (least id of its class), text_rep (least id of its equal texts), class_size, n_links (verified links of its text; within a class that is already joined they are not looked for), class_key.

    One row for each row of `docs`.
    """
    return classified(docs, threshold, estimate).drop("v")


def classified(docs: DataFrame, threshold: float = 0.8, estimate: float = 0.6) -> DataFrame:
    """The rows of `near_duplicates`, with v (digest of the text)."""
    texts = keyed_texts(docs)
    df = document_frequencies(texts)
    n_docs = docs.count()
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(df, n_docs))
    signed = cut(signatures(texts, idf))
    vertices = cut(signed.groupBy("v").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    found = cut(links(texts, vertices, idf, threshold, estimate))
    labels = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n_links"))
    marked = cut(vertices.select("v", "rep", "copies").join(labels.hint("merge"), "v", "left").join(degree.hint("merge"), "v", "left").withColumn("label", F.coalesce("label", "v")))
    classes = marked.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    marked = cut(hot_join(marked, classes, "label").select("v", "rep", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.hex("label").alias("class_key")))
    return hot_join(signed.select("doc_id", "v"), marked, "v").select("doc_id", "class_id", F.col("rep").alias("text_rep"), "class_size", "n_links", "class_key", "v")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each class, columns as they were, whatever their names.

    The row of the class's least id stays, a null id last, and among texts of that id the one of the least digest; of
    rows with equal id and text one. Rows that share an id but no class all stay. An empty table stays empty.
    """
    classes = cut(classified(docs, **options).select("doc_id", "class_key", "v"))
    first = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("m"))
    first = first.select(F.col("m.doc_id").alias("first"), F.col("m.v").alias("v"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), digest(plain_text()).alias("digest"))
    kept = rows.join(first.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("v")), "left_semi")
    if classes.groupBy("doc_id", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["own", "digest"])  # equal id and text: the same class
    return kept.select("row.*")
