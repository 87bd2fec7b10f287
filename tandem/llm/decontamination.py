"""Operator 13: documents that hold passages of benchmark items, by a prefix-filtered set join. DataFrame functions only.

A window is a set of word shingles in fixed places (three words each; of a shorter item, all
its words). It is contained in a stretch of a document only if every shingle is, so with the
shingles ordered by rarity a prefix of one, the rarest, is necessary: documents meet windows on
that shingle alone. How rare shingles are is counted over all documents; a window with a shingle
that no document holds is left out. A place of a document that holds the rarest shingle of some
window is written with the few words around it, which bound all windows through it; positional
and length bounds place the window there, and its words are compared with the document's own.
The benchmark's tables are broadcast in blocks of a counted size, one after the other; keys pass
over the documents, windows over the places. So no document is shuffled, no shingle, however
common, is a hot key, and no row but a document's own carries all its words: a task holds one
document and its places, an executor one block.

Null texts have no words; an item without words has no window. An item shorter than ten words is
one window. Very long texts are read whole, one row at a time. Rows that share an id are judged
each by its own text, repeated rows alike. Items that share an id count once; null item ids
count as one item, listed as an empty string. Empty tables give no rows, or no hits. Columns
other than doc_id, text and item_id are not read, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandem.llm.common import cut, hot_join

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
BLOCK_ROWS = 400_000
ROW_BYTES = 128
OCCURRENCE = "row_key string, start int, end int, window_id string"


def words_of(text: str) -> Column:
    """Words of a text whose letters A to Z are lower-cased, other letters as they are."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN), "")


def blocks(df: DataFrame, by: str, most: int = BLOCK_ROWS, *, long: str | None = None) -> list[DataFrame]:
    """`df` dealt by a hash of `by` into parts of at most `most` rows each, by count: doubled until they are. `by` must tell rows apart. A row counts once more for each ROW_BYTES of the column `long`; one that is too long stands alone."""
    counted = F.lit(1) if long is None else F.lit(1) + F.ceil(F.octet_length(long) / ROW_BYTES)
    n = -(-(df.agg(F.sum(counted)).first()[0] or 0) // most)
    while n > 1:
        dealt = df.withColumn("_block", F.pmod(F.xxhash64(F.lit(n), by), F.lit(n)))
        sums = dealt.groupBy("_block").agg(F.sum(counted).alias("counted"), F.count(F.lit(1)).alias("rows"))
        if sums.where((F.col("counted") > most) & (F.col("rows") > 1)).isEmpty():
            return [dealt.where(F.col("_block") == i).drop("_block") for i in range(n)]
        n *= 2
    return [df][:n]


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """item, window_id, window: every distinct run of `size` item words; all words of a shorter item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of("text").alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    found = items.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("window")).distinct()
    return found.select("item", F.sha2(F.concat_ws(" ", "window"), 256).alias("window_id"), "window")


def shingle_key(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(F.col(words), at + k) for k in range(size)))


def window_shingles(windows: DataFrame) -> DataFrame:
    """window_id, shingle_size, offset, key: the shingles of each of the distinct `windows`."""
    one = windows.select("window_id", "window", F.least(F.lit(SHINGLE), F.size("window")).alias("shingle_size"))
    placed = one.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("window") - F.col("shingle_size"))))
    keys = [F.when(F.col("shingle_size") == s, shingle_key("window", F.col("offset"), s)) for s in range(1, SHINGLE + 1)]
    return placed.select("window_id", "shingle_size", "offset", F.coalesce(*keys).alias("key"))


def document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, row_key, words, pos, last, key: one row per word of a document and shingle size; one with a null pos where there are no words. `last` marks one row of each document."""
    words = docs.select("doc_id", "row_key", words_of("text").alias("words"))
    at = words.select("*", F.posexplode_outer("words").alias("pos", "_word")).withColumn("last", F.coalesce(F.col("pos") + 1 == F.size("words"), F.lit(True)))
    held = lambda s: F.when(F.col("pos") + s <= F.size("words"), shingle_key("words", F.col("pos"), s))
    if len(sizes) == 1:
        return at.select("doc_id", "row_key", "words", "pos", "last", held(sizes[0]).alias("key"))
    each = F.explode(F.array(*(F.struct((F.col("last") & F.lit(s == sizes[0])).alias("last"), held(s).alias("key")) for s in sizes)))
    return at.select("doc_id", "row_key", "words", "pos", each.alias("x")).select("doc_id", "row_key", "words", "pos", "x.last", "x.key")


def documents_met(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_words of each row of `docs`; key, for each place where a document holds a shingle of the benchmark)."""
    rows, parts = document_shingles(docs, sizes), []
    for i, b in enumerate(blocks(cut(shingles.select("key").distinct()), "key")):
        keys = F.broadcast(b.withColumn("hit", F.lit(True)))
        if i:
            parts.append(cut(rows.join(keys, "key").select("key", "hit")))
            continue
        own = [F.when(F.col("last"), c).alias(n) for n, c in (("doc_id", F.col("doc_id")), ("row_key", F.col("row_key")), ("n_words", F.size("words").cast("long")))]
        parts.append(cut(rows.join(keys, "key", "left").where("hit or last").select(*own, "last", "key", "hit")))
    return parts[0].where("last").select("doc_id", "row_key", "n_words"), reduce(DataFrame.unionByName, (p.where("hit").select("key") for p in parts))


def necessary_prefixes(windows: DataFrame, shingles: DataFrame, frequency: DataFrame) -> DataFrame:
    """window_id, window (its words as one text), length, offset, key: each window's rarest shingle, ties to the first; windows that hold a shingle of no document are left out."""
    rare = F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "offset", "key"))
    kept = hot_join(shingles, frequency, "key").groupBy("window_id").agg(rare.alias("x")).where("x.rows > 0")
    return kept.join(windows.hint("merge"), "window_id").select("window_id", F.concat_ws(" ", "window").alias("window"), F.size("window").alias("length"), "x.offset", "x.key")


def places(docs: DataFrame, keys: DataFrame, sizes: list[int], size: int) -> list[DataFrame]:
    """row_key, n_words, pos, key, first, near: every place where a document holds one of the `keys`, with the words `near` it from the word `first` on, as far as a window of `size` words reaches."""
    first, found = F.greatest(F.col("pos") - (size - 1), F.lit(0)), []
    for b in blocks(keys, "key"):
        near = F.slice("words", first + 1, 2 * size - 1)
        found.append(cut(document_shingles(docs, sizes).join(F.broadcast(b), "key").select("row_key", F.size("words").alias("n_words"), "pos", "key", first.alias("first"), near.alias("near"))))
    return found


def occurrences(docs: DataFrame, prefixes: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """row_key, start, end, window_id: every place of a document where a window of at most `size` words stands, word for word."""
    parts = blocks(prefixes, "window_id", long="window")
    if not parts:
        return docs.sparkSession.createDataFrame([], OCCURRENCE)
    at = reduce(DataFrame.unionByName, places(docs, cut(prefixes.select("key").distinct()), sizes, size))
    start, length = F.col("pos") - F.col("offset"), F.col("length")
    bounds = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.concat_ws(" ", F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, length)) == F.col("window")
    found = [cut(at.join(F.broadcast(b), "key").where(bounds & same).select("row_key", start.alias("start"), (start + length).alias("end"), "window_id")) for b in parts]
    return reduce(DataFrame.unionByName, found).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, row_key, n_words of each row of `docs`; row_key, start, end, window_id of every occurrence; item, window_id). `docs` holds doc_id, row_key and text."""
    windows = cut(windows_of(benchmark, size))
    single = cut(windows.select("window_id", "window").distinct())
    shingles = cut(window_shingles(single))
    sizes = sorted(r[0] for r in shingles.select("shingle_size").distinct().collect())  # SHINGLE values at most
    items = windows.select("item", "window_id")
    if not sizes:
        base = docs.select("doc_id", "row_key", F.size(words_of("text")).cast("long").alias("n_words"))
        return cut(base), docs.sparkSession.createDataFrame([], OCCURRENCE), items
    base, met = documents_met(docs, shingles, sizes)
    frequency = cut(met.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    prefixes = cut(necessary_prefixes(single, shingles, frequency))
    return base, cut(occurrences(docs, prefixes, sizes, size)), items


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both, as ids may repeat or be null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(text, 256)).alias("row_key"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (their ids, sorted as strings): one row for each row of `docs`."""
    own = with_keys(docs)
    base, hits, items = overlaps(own, benchmark, size)
    earlier = F.max("end").over(Window.partitionBy("row_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(earlier, F.lit(0))), F.lit(0))
    covered = hits.select("row_key", "start", "end").distinct().withColumn("fresh", fresh).groupBy("row_key").agg(F.sum("fresh").alias("n_hit"))
    met = cut(hits.select("row_key", "window_id").distinct())
    named = [cut(met.join(F.broadcast(b), "window_id").select("row_key", "item")) for b in blocks(items.withColumn("_id", F.concat_ws(":", "item", "window_id")), "_id", long="_id")]
    if named:
        held = reduce(DataFrame.unionByName, named).groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
        summary = covered.join(held.hint("merge"), "row_key")
    else:
        summary = covered.withColumn("items", F.array().cast("array<string>"))
    out = hot_join(base, cut(summary), "row_key")
    n_hit, held = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), F.sha2(F.array_join(held, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), held.alias("items"),
    )


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (
  SELECT r, i, n, item_id FROM places JOIN win USING (n, g)
), covered AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), held AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN held USING (r)
"""
