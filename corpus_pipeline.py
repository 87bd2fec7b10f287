"""A corpus pipeline of five operators: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows
are written as Parquet to the shared folder and read again. Empty tables pass through all
stages, and extra columns stay as they are up to the last one, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import mixing, near_dedup, packing, pii, quality
from tandem.llm.common import cut, table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: their own text passes, and so does their host. Null texts go; rows that share an id are judged each by its own text."""
    return quality.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of the least id (a null id last). Rows that share an id but no class all stay; texts without words are one class."""
    return near_dedup.deduplicated(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that reveal it masked. Null texts stay null; rows that share an id are masked each by its own text."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: one taken k times comes k times, one at its source's budget as its first words. Texts without words are not taken; a null source is a source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences. Null texts consist of the end id; rows are packed as often as they occur."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_clean),
    ("near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # signatures, corpus co-occurrence and BPE ids have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
