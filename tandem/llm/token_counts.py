"""Operator 1: exact token counts through a length histogram.

Documents are aggregated by encoded length, so what is kept grows with the number of
different lengths and not with the corpus. Suffix sums over that histogram answer, for
every context limit, how many documents fit, the quantile the limit stands for, and how
many tokens remain when longer documents are truncated at it.

Nulls and empty texts have length 0 and are counted. Repeated rows count as often as
they occur. An empty table gives an empty histogram. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import cut, doc_text
from tandem.llm.textkit import sub_batches
from tandem.llm.tokens import encoder, vocabulary_dir

STRIPE = 1024


def length_histogram(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """n_tokens, n_docs: documents per exact encoded length."""
    folder = folder or vocabulary_dir()

    def count(batches):
        enc = encoder(folder)
        for b in sub_batches(batches, 4 << 20, 20_000):
            _, n = enc.encode(b.column(0))
            seen = np.bincount(n)
            at = np.flatnonzero(seen)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["n_tokens", "n_docs"])

    part = doc_text(docs).select("text").mapInArrow(count, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """One row per length present, read as a context limit.

    n_docs and tokens of exactly that length; docs_within and docs_longer; quantile, the
    share of documents within the limit; tokens_within, of documents that fit; and
    truncated_total, the tokens left when each longer document is cut at the limit.
    Two-level sums: inside stripes of 1,024 lengths, then over the stripes' totals.
    """
    rows = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / STRIPE).alias("stripe"))
    above = Window.orderBy(F.desc("stripe")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stripes = (
        rows.groupBy("stripe").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("stripe", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"))
    )
    longer = Window.partitionBy("stripe").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{c}_in": F.coalesce(F.sum(v).over(longer), F.lit(0)) for c, v in (("d", "n_docs"), ("t", "tokens"))})
    out = out.join(stripes.hint("merge"), "stripe")
    d, t = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return out.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "tokens",
        d.alias("docs_longer"), (F.col("d_all") - d).alias("docs_within"),
        ((F.col("d_all") - d) / F.col("d_all")).alias("quantile"),
        (F.col("t_all") - t).alias("tokens_within"),
        (F.col("t_all") - t + d * F.col("n_tokens")).alias("truncated_total"),
        F.col("t_all").alias("total_tokens"),
    )


def token_counts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    return context_limits(cut(length_histogram(docs, folder)))  # written once: each text is encoded once


def at_limits(limits: DataFrame, wanted: list[int]) -> DataFrame:
    """Totals for any limits, present as a length or not: the answer of the largest length below, moved up.

    limit, docs_within, docs_longer, truncated_total. `wanted` is a short list of the caller.
    """
    below = F.struct("context_limit", "docs_within", "docs_longer", "tokens_within")
    one = limits.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), *(F.max(F.when(F.col("context_limit") <= int(x), below)).alias(f"b{i}") for i, x in enumerate(wanted)))
    each = F.explode(F.array(*(F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(f"b{i}").alias("b")) for i, x in enumerate(wanted))))
    best = one.select("docs", each.alias("x")).select("docs", "x.limit", "x.b")
    longer = F.coalesce(F.col("b.docs_longer"), F.col("docs"))
    return best.select("limit", F.coalesce("b.docs_within", F.lit(0)).alias("docs_within"), longer.alias("docs_longer"), (F.coalesce("b.tokens_within", F.lit(0)) + longer * F.col("limit")).alias("truncated_total"))
