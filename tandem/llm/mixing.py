"""Operator 6: mixing sources to target weights, in DataFrame operations only.

Targets follow the sources' weights, and no source is used more than `most` times: what
a full source cannot take is shared again among the others (a water level over sorted
ratios, in closed form). Documents then get hash-random keys. Keys are uniform, so equal
ranges of them are the range sort: each source is cut into ranges of about
`range_rows` documents, sums run inside a range, and the totals of the ranges before it
are added. A document whose words cross its source's budget is taken in part, so every
budget is met exactly; sources with a target above their size repeat whole epochs.

A null source is a source, and comes last. A null text has size 0. The key of a row is a
hash of its id and text, so a common or null id is no hot key; rows with equal id and text
tie and are interchangeable. Sources without words get target 0. Extra columns are
ignored, or kept as they are by `mixed_documents`, whatever their names. Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import WORD, cut, hot_join

BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame, *others: str, seed: int = 20240601) -> DataFrame:
    """doc_id, source, size (words), key (hash-random), and `others`."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    return docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), key.alias("key"), *others)


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n_docs, source_size, weight, target. One row per source; windows run over sources, never documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_name)
    per = per.withColumn("nth", nth).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - before) / open_weight)
    level = F.max(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level"))).over(everyone)
    return per.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap"))).select("source", "n_docs", "source_size", "weight", "target")


def taken_words(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, range_rows: int) -> DataFrame:
    """`sized` (a written table) with source_size, target and taken: the words of each row that the mix takes, repeats counted."""
    host = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-"))  # a key of the source that is never null
    plan = cut(targets(sized, weights, share, most).withColumn("host", host)).select(
        "host", "source_size", "target",
        F.ceil(F.col("n_docs") / range_rows).alias("ranges"),
        F.round("target").cast("long").alias("budget"),
    )
    named = sized.withColumn("host", host)
    rows = named.join(F.broadcast(plan), "host") if plan.count() <= BROADCAST_SOURCES else hot_join(named, plan, "host")
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32))))
    inside = Window.partitionBy("host", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    earlier = Window.partitionBy("host").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("host", "range").agg(F.sum("size").alias("n")).select("host", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.join(offsets.hint("merge"), ["host", "range"])
    epochs = F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("source_size"))), F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("start") - F.col("offset")))
    return rows.select(*sized.columns, "source_size", "target", taken.cast("long").alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20240601, range_rows: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: the words of each document that the mix takes, repeats counted."""
    found = taken_words(cut(sizes(docs, seed=seed)), weights, share, most, range_rows)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20240601, range_rows: int = 4096) -> DataFrame:
    """The documents of the mix with the columns of `docs`, whatever their names: a row taken k times whole comes k times, a part of it as its first words.

    The rows are written once with a number each, and what the mix takes is joined back by it, so rows that share an
    id, or have none, are taken each by itself. Texts without words are not taken. An empty table stays empty.
    """
    own = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("nth")))
    sized = cut(sizes(own.select("row.doc_id", "row.source", "row.text", "nth"), "nth", seed=seed))
    found = taken_words(sized, weights, share, most, range_rows).where("taken > 0").select("nth", "size", "taken")
    rows = own.join(found.hint("merge"), "nth")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    rows = rows.select("row", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))).alias("part"))
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest("part", F.lit(1))), " ")
    rows = rows.select("row", "part", F.when(F.col("part") > 0, first).otherwise(F.col("row.text")).alias("text"))
    new = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.col("part") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return rows.select(new.alias("row")).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('20240601|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS nth FROM per
), caps AS (
  SELECT *, [5.0, 2.0, 1.0][(nth - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM weighed
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
), plan AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN level < cap / weight THEN level END) OVER ()), cap) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, d.source, round(p.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (coalesce(budget // nullif(source_size, 0), 0) * size
   + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - start)))::BIGINT AS taken, source
FROM placed
"""
