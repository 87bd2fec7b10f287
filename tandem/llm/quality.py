"""Operator 10: host-level quality rules.

Each document is measured against a few rules. Their failures are summed by host (the
`source` column), each host's failure rate is shrunk by a beta prior fitted to all hosts
by moments, and the host's verdict is joined back: a document goes if it fails a base
rule, or if its host's shrunk rate is above `host_limit`.

Null texts hold no words and fail; a null host is a host of its own. Very long texts are
measured whole. Equal rows get equal verdicts. An empty table gives no rows. Extra
columns are kept by `clean` and ignored by `measure`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import cut, hot_join
from tandem.llm.textkit import Words, buffers, mix_int, sub_batches

BLANKS = "\t\n\x0b\x0c\r "
MEASURES = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
BROADCAST_HOSTS = 50_000


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true bytes in each text."""
    head = np.concatenate([[0], np.cumsum(mask)])
    return head[off[1:]] - head[off[:-1]]


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Words of each text that lie in a run of `n` words found twice or more in it."""
    runs = np.maximum(words.count - n + 1, 0)
    row = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(words.first[:-1], runs)
    h, key = words.hashes(), np.zeros(len(row), np.uint64)
    for k in range(n):
        key = (key ^ h[at + k]) * np.uint64(mix_int(k + 7) | 1)
        key ^= key >> np.uint64(29)
    bits = np.uint64(64 - (len(runs) - 1).bit_length()) if len(runs) > 1 else np.uint64(64)  # of the hash: all 64 for a text of its own batch, as long ones are
    if bits < 64:
        key = (row.astype(np.uint64) << bits) | (key >> (np.uint64(64) - bits))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(row), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, bool)
    for k in range(n):
        covered[at[twice] + k] = True
    head = np.concatenate([[0], np.cumsum(covered[:-1])])
    return head[words.first[1:]] - head[words.first[:-1]]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""

    def batches_measured(batches):
        symbol = np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        for b in sub_batches(batches):
            texts = b.column(2)
            words = Words(texts)
            off, data = buffers(texts)
            heads = (data & 0xC0) != 0x80
            inside = ~np.isin(data, np.frombuffer(BLANKS.encode(), np.uint8))
            lines = []
            for t in texts.to_pylist():
                own = [x for x in t.split("\n") if x.strip(BLANKS)]
                lines.append(len(own) - len(set(own)))
            cols = [words.count, per_text(heads & inside, off), per_text(symbol[data], off), np.array(lines), repeated_words(words)]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=[f.split()[0] for f in MEASURES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(batches_measured, MEASURES)


def rules(measured: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds base_failed and rule_failed: base rules, or symbols for over a tenth of the characters, or over half of the words in odd lengths."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    odd = (10 * F.col("n_symbols") > F.col("word_chars")) | (F.col("word_chars") > 20 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("rule_failed", base | odd)


def host_verdicts(ruled: DataFrame, host_limit: float = 0.6) -> DataFrame:
    """source, host_docs, host_failed, host_rate (shrunk), host_kept. One row per host.

    The beta prior has the hosts' mean failure rate m and a strength from the variance v
    of their rates beyond binomial noise: m(1-m)/v - 1, held between 1 and 1,000.
    """
    hosts = ruled.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_docs")).alias("h"))
    noise = F.col("m") * (1 - F.col("m"))
    extra = F.col("v") - noise * F.col("h")
    strength = F.when(extra > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), noise / extra - 1))).otherwise(F.lit(1000.0))
    prior = prior.select("m", strength.alias("k"))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("k")) / (F.col("host_docs") + F.col("k"))
    one = hosts.crossJoin(F.broadcast(prior))  # the prior is a single row
    return one.select("source", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= host_limit).alias("host_kept"))


def host_key(source: str):
    """A key of the source that is never null: `-` for a null one, `+` and its name for others."""
    return F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))


def with_host(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Joined on host: all hosts broadcast where they are few (checked), else only the common ones."""
    return rows.join(F.broadcast(hosts), "host") if hosts.count() <= BROADCAST_HOSTS else hot_join(rows, hosts, "host")


def quality_rules(docs: DataFrame, host_limit: float = 0.6) -> DataFrame:
    """Measures, base_failed, host_rate and kept for each row of `docs`."""
    ruled = cut(rules(measure(docs)))
    hosts = cut(host_verdicts(ruled, host_limit).select(host_key("source").alias("host"), "host_rate", "host_kept"))
    rows = with_host(ruled.withColumn("host", host_key("source")), hosts)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.round("host_rate", 6).alias("host_rate"), "source",
    )


def clean(docs: DataFrame, host_limit: float = 0.6) -> DataFrame:
    """`docs` without the rows that the rules reject, columns as they were, whatever their names.

    Hosts are judged first; then each row is measured again where it lies, so that no
    text is shuffled and rows that share an id are judged by their own text. Null texts
    go, as they hold too few words. An empty table stays empty.
    """
    hosts = cut(host_verdicts(rules(measure(docs)), host_limit).select(host_key("source").alias("host"), "host_kept"))

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        found = []
        for b in sub_batches(iter([pa.record_batch([texts.cast(pa.string())], names=["text"])])):
            words = Words(b.column(0))
            found.append((words.count >= 50) & (100 * repeated_words(words) <= 50 * words.count))
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    rows = docs.select(F.struct("*").alias("row"), host_key("source").alias("host"))
    rows = rows.where(passes(F.coalesce("row.text", F.lit(""))))
    if hosts.count() > BROADCAST_HOSTS:
        rows = cut(rows)  # measured once, as it is read several times
    return with_host(rows, hosts).where("host_kept").select("row.*")


QUALITY_SQL = r"""
WITH words AS (
  SELECT rowid_, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, source, coalesce(text, '') AS text FROM documents)
), runs AS (
  SELECT rowid_, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT rowid_, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), twice AS (
  SELECT rowid_, i FROM (SELECT rowid_, i, count(*) OVER (PARTITION BY rowid_, g) AS n FROM runs) WHERE n >= 2
), repeated AS (
  SELECT rowid_, count(DISTINCT j) AS n FROM (SELECT rowid_, unnest([i, i+1, i+2]) AS j FROM twice) GROUP BY rowid_
), lines AS (
  SELECT rowid_, count(*) - count(DISTINCT l) AS n
  FROM (SELECT rowid_, unnest(string_split(text, chr(10))) AS l FROM words)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rowid_
), measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeated r USING (rowid_) LEFT JOIN lines l USING (rowid_)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars OR word_chars > 20 * n_words OR word_chars < 2 * n_words AS rule_failed
  FROM measured
), hosts AS (
  SELECT source, count(*) AS d, sum(rule_failed::INT) AS f FROM ruled GROUP BY source
), prior AS (
  SELECT avg(f / d) AS m, var_pop(f / d) - avg(f / d) * (1 - avg(f / d)) * avg(1 / d) AS extra FROM hosts
), rated AS (
  SELECT source, (f + m * k) / (d + k) AS rate
  FROM hosts, (SELECT m, CASE WHEN extra > 0 THEN greatest(1, least(1000, m * (1 - m) / extra - 1)) ELSE 1000 END AS k FROM prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.6 AS kept, round(rate, 6) AS host_rate, r.source
FROM ruled r JOIN rated h ON r.source IS NOT DISTINCT FROM h.source
"""
