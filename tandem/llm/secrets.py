"""Operator 9: secret scans with a battery of randomness tests.

Fixed patterns give the base spans. Besides them, every run of 16 or more characters of
an encoding alphabet that mixes digits, capital and small letters is a candidate. Its
encoding is inferred (hex, base32, base64) and three tests run on its symbols:

* chi-squared uniformity over the encoding's alphabet; the statistic rises with the
  number of pairs of equal symbols, whose law at short lengths is Poisson,
* runs: changes between digits, capital and small letters along the symbols,
* lag-1 serial correlation of the symbols' places in the alphabet.

Each statistic is judged twice. As random: a candidate must not be rejected by any test,
at a level split over the tests. As ordinary: the p-value that the corpus's own long
words, of the same class of lengths, look as random by this test, from the statistic's
mean and spread over all of them (words with more than three changes are left out). The three are combined (Fisher), and a
Benjamini-Hochberg bound per class of lengths, over all candidates of the corpus, holds
the expected share of false discoveries at `fdr`. The bound is found on a fixed grid of
p-values, rounded upwards, so it never collects candidates.

Null texts are empty. Whole texts are scanned, however long. Rows are found again by id
and text: rows of equal id and text give equal rows, and neither a common id nor a null
one is a common key. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import cut
from tandem.llm.textkit import Words, sub_batches

# Fixed values of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
GRID = 200  # steps of the p-value grid, each a quarter of a power of ten


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def encoding_of(token: str) -> tuple[str, str] | None:
    """Inferred encoding and the symbols to test; None where no two of digits, capital and small letters meet."""
    body = token.rstrip("=")
    if len({kind_of(c) for c in body} - {3}) < 2:
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex", body.lower()
    if re.fullmatch(r"[A-Z2-7]+", body):
        return "base32", body
    return "base64", body.replace("-", "+").replace("_", "/")


def statistics(kind: str, symbols: str) -> tuple[float, float, float]:
    """Per pair of symbols, the share of equal ones (the chi-squared statistic is n * ((n - 1) * share + 1) * m / n - n); changes per step; serial correlation."""
    n, places = len(symbols), [ALPHABETS[kind].find(c) for c in symbols]
    counts = np.bincount(np.array(places) + 1)
    x = np.maximum(np.array(places, float), 0)
    d = x - x.mean()
    kinds = [k for k in map(kind_of, symbols) if k < 3]  # marks between words are no change
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    spread = float((d * d).sum())
    return float((counts * (counts - 1)).sum()) / (n * (n - 1)), changes / max(1, len(kinds) - 1), float((d[1:] * d[:-1]).sum()) / spread if spread else 1.0


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def random_p(kind: str, n: int, equal: float, changes: float, serial: float) -> float:
    """The least of the three tests' p-values if the symbols were drawn at random from the alphabet."""
    m, pairs = len(ALPHABETS[kind]), n * (n - 1) / 2
    seen, mean = round(equal * pairs), pairs / m
    term, below = math.exp(-mean), 0.0
    for k in range(seen):
        below += term
        term *= mean / (k + 1)
    shares = [s / min(m, 62) for s in {"hex": (10, 6), "base32": (6, 26), "base64": (10, 26, 26)}[kind]]
    rate = 1 - sum(s * s for s in shares)
    p_runs = math.erfc(abs(changes - rate) * math.sqrt((n - 1) / (2 * rate * (1 - rate))))
    return min(max(0.0, 1 - below) if mean < 700 else upper_normal((seen - mean) / math.sqrt(mean)), p_runs, math.erfc(abs(serial + 1 / n) * math.sqrt(n / 2)))


def ordinary_p(n: int, equal: float, changes: float, serial: float, nulls: list[float]) -> float:
    """How likely an ordinary word passes the three tests as well: few equal pairs, many changes, little correlation. nulls: mean and spread of the three."""
    ps = [upper_normal((nulls[0] - equal) / nulls[1]), upper_normal((changes - 0.5 / n - nulls[2]) / nulls[3])]
    far, z = abs(serial + 1 / n), (nulls[4] + 1 / n) / nulls[5]
    ps.append(max(0.0, upper_normal(-far / nulls[5] - z) - upper_normal(far / nulls[5] - z)))
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-x) * (1 + x + x * x / 2)


TOKENS = "array<struct<start:long,end:long,encoding:string,n:long,equal:double,changes:double,serial:double>>"
TOKEN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("n", pa.int64()), ("equal", pa.float64()), ("changes", pa.float64()), ("serial", pa.float64())]))
SPANS = "array<struct<kind:string,start:long,end:long>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SUMS = 7  # of long words: number, then sum and sum of squares of each statistic
CLASSES = 8  # classes of lengths of ordinary words, by powers of two
ORDINARY = 3  # changes in an ordinary word at most: capitals, a number at the end, camel case
LEAST = (0.0, 0.02, 0.05, 0.08, -1.0, 0.1)  # of the means and spreads of the three statistics: no corpus makes ordinary words look narrower


def word_sums(words: Words) -> list[float]:
    """Sums of the three statistics over a batch's ordinary words, for each class of lengths: 12 to 63 ASCII letters and digits with at most ORDINARY changes."""
    size = words.end - words.start
    long_ = np.flatnonzero((size >= 12) & (size < 64))
    place, kind = np.full(256, -1), np.full(256, 3)
    for i, c in enumerate(ALPHABETS["base64"][:62]):
        place[ord(c)], kind[ord(c)] = i, kind_of(c)
    out = np.zeros((CLASSES, SUMS))
    if len(long_):
        n = size[long_]
        begin, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        at = np.repeat(words.start[long_] - begin, n) + np.arange(n.sum())
        x, k = place[words.data[at]], kind[words.data[at]]
        plain = np.minimum.reduceat(x, begin) >= 0
        to_end = np.repeat(begin + n, n) - np.arange(len(x))
        pairs = np.zeros(len(n))
        for gap in range(1, int(n.max())):
            a = np.flatnonzero(to_end > gap)
            pairs += np.bincount(of[a], x[a] == x[a + gap], len(n))
        inner = np.flatnonzero(of[1:] == of[:-1])
        changes = np.bincount(of[inner], k[inner] != k[inner + 1], len(n))
        plain &= changes <= ORDINARY
        changes = changes / (n - 1)
        d = x - np.repeat(np.add.reduceat(x, begin) / n, n)
        spread = np.add.reduceat(d * d, begin)
        serial = np.where(spread > 0, np.bincount(of[inner], d[inner] * d[inner + 1], len(n)) / np.maximum(spread, 1e-9), 1.0)
        where = np.minimum(np.log2(n).astype(int), CLASSES - 1)[plain]
        cols = [np.ones(len(n))]
        for v in (pairs / (n * (n - 1) / 2), changes, serial):
            cols += [v, v * v]
        for i, v in enumerate(cols):
            out[:, i] = np.bincount(where, v[plain], CLASSES)
    return out.reshape(-1).tolist()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, base (spans), tokens (candidates with their statistics), and sums (of the statistics of long words)."""

    def spans(batches):
        token = re.compile(TOKEN)
        for b in sub_batches(batches):
            texts = b.column(2)
            base, tokens = [], []
            sums = [word_sums(Words(texts)), *[None] * (len(texts) - 1)]  # of the batch, in its first row
            for t in texts.to_pylist():
                base.append([{"kind": k, "start": s, "end": e} for s, k, e in base_spans(t)])
                found = []
                for m in token.finditer(t):
                    if (inferred := encoding_of(m[0])) and len(inferred[1]) >= 16:
                        kind, symbols = inferred
                        equal, changes, serial = statistics(kind, symbols)
                        found.append({"start": m.start(), "end": m.end(), "encoding": kind, "n": len(symbols), "equal": equal, "changes": changes, "serial": serial})
                tokens.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, SPAN_TYPE), pa.array(tokens, TOKEN_TYPE), pa.array(sums, pa.list_(pa.float64()))], names=["doc_id", "text_id", "base", "tokens", "sums"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(spans, f"doc_id long, text_id long, base {SPANS}, tokens {TOKENS}, sums array<double>")


def nulls_of(scanned: DataFrame) -> DataFrame:
    """One row per class of lengths: nulls, mean and spread of the three statistics over the corpus's ordinary long words; classes with few words take the figures of all words."""
    sums = scanned.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))  # CLASSES * SUMS rows
    per = sums.groupBy(F.floor(F.col("at") / SUMS).alias("c")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") % SUMS).alias("k"), "x"))).alias("m"))
    s = [F.coalesce(F.col("m")[i], F.lit(0.0)).alias(f"s{i}") for i in range(SUMS)]
    per = per.select("c", *s)
    all_ = per.agg(*(F.sum(f"s{i}").alias(f"a{i}") for i in range(SUMS)))

    def figure(p: str, k: int):
        n, x, xx = F.col(f"{p}0"), F.col(f"{p}{2 * k + 1}"), F.col(f"{p}{2 * k + 2}")
        mean = F.coalesce(F.try_divide(x, n), F.lit((0.065, 0.05, 0.0)[k]))  # where the corpus has no long words at all
        return F.greatest(mean, F.lit(LEAST[2 * k])), F.greatest(F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(xx, n), F.lit(0.0)) - F.pow(mean, 2))), F.lit(LEAST[2 * k + 1]))

    own, whole = ([x for k in range(3) for x in figure(p, k)] for p in "sa")
    rows = per.crossJoin(F.broadcast(all_))  # a single row
    return rows.select("c", F.when(F.col("s0") >= 30, F.array(*own)).otherwise(F.array(*whole)).alias("nulls"))


def scores(scanned: DataFrame, random_level: float = 0.001) -> DataFrame:
    """One row per candidate that passes for random: doc_id, text_id, start, end, encoding, n, step (of the p-value grid), length_class."""
    nulls = nulls_of(scanned)

    @F.pandas_udf("double")
    def by_chance(encoding, n, equal, changes, serial):  # noqa: ANN001
        import pandas as pd

        return pd.Series([random_p(*row) for row in zip(encoding, n, equal, changes, serial, strict=True)], dtype=float)

    @F.pandas_udf("long")
    def step(n, equal, changes, serial, nulls):  # noqa: ANN001
        import pandas as pd

        p = [ordinary_p(*row) for row in zip(n, equal, changes, serial, nulls, strict=True)]
        return pd.Series([min(GRID, int(-4 * math.log10(max(x, 1e-300)))) for x in p], dtype="int64")

    found = scanned.select("doc_id", "text_id", F.explode("tokens").alias("t")).select("doc_id", "text_id", "t.*")
    found = found.where(by_chance("encoding", "n", "equal", "changes", "serial") >= random_level / 3).withColumn("length_class", F.floor(F.log2("n")))
    rated = found.join(F.broadcast(nulls), F.least("length_class", F.lit(CLASSES - 1)) == F.col("c"))  # at most CLASSES rows
    return rated.select("doc_id", "text_id", "start", "end", "encoding", "n", step("n", "equal", "changes", "serial", "nulls").alias("step"), "length_class")


def discoveries(scored: DataFrame, fdr: float = 0.01) -> DataFrame:
    """The candidates within the Benjamini-Hochberg bound of their length class. A class has at most GRID + 1 steps."""
    steps = scored.groupBy("length_class", "step").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("length_class").orderBy(F.desc("step"))
    everyone = Window.partitionBy("length_class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = steps.select("length_class", "step", F.sum("n").over(best).alias("rank"), F.sum("n").over(everyone).alias("m"))
    bound = ranked.where(F.pow(F.lit(10.0), -F.col("step") / 4) <= F.lit(fdr) * F.col("rank") / F.col("m")).groupBy("length_class").agg(F.min("step").alias("bound"))
    return scored.join(F.broadcast(bound), "length_class").where(F.col("step") >= F.col("bound"))  # one row per power of two of a length


def find_secrets(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """doc_id, base and random: arrays of spans (kind, start, end; code points), and randomly looking strings outside the base spans."""
    scanned = cut(scan(docs))
    found = discoveries(scores(scanned), fdr).groupBy(F.col("doc_id").alias("d"), F.col("text_id").alias("x")).agg(F.collect_set(F.struct(F.lit("random").alias("kind"), "start", "end")).alias("random"))
    rows = scanned.select("doc_id", "text_id", "base").join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_id") == F.col("x")), "left")
    own = F.expr("filter(coalesce(random, array()), x -> not exists(base, y -> y.start < x.end and x.start < y.end))")
    return rows.select("doc_id", "base", F.coalesce(F.array_sort(own), F.array().cast(SPANS)).alias("random"))


def digest(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def secret_digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts, base_sha256 and spans, sorted by start, then kind."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    ordered = F.expr(
        "transform(array_sort(transform(concat(base, random), s -> struct(s.start as a, array_position(array('assign','access','hex','random'), s.kind) as b, s.kind as kind, s.start as start, s.end as end))), s -> struct(s.kind as kind, s.start as start, s.end as end))"
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(ordered).alias("spans"), F.size("random").cast("long").alias("n_random"))


def sha256_of(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
