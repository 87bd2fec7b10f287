"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as an empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary folder if the session is local (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "tandem-checkpoints")
    return f"{root.rstrip('/')}/tandem-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(col: Column, mod: int) -> Column:
    """crc32 of a value as text, modulo `mod`: the documented split of the learning operators."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def salted_join(big: DataFrame, small: DataFrame, key: str, by: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """`big` joined with `small` (unique per `key`, and much smaller): a common key of `big` is dealt over `salts` tasks by the columns `by`."""
    left = big.withColumn("join_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    right = small.withColumn("join_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right.hint("merge"), [key, "join_salt"], how).drop("join_salt")


def hot_join(big: DataFrame, small: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join of `big` with `small` (unique per `key`): keys with over 1/share of the rows, fewer than `share` by counting, are broadcast, the others merged."""
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    total = big.count()
    hot = cut(counts.where(F.col("key_rows") * share > total).select(key))
    marked = big.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    common = small.join(F.broadcast(hot), key, "left_semi")
    rare = marked.where("is_hot is null").join(small.hint("merge"), key, "left")
    return marked.where("is_hot").join(F.broadcast(common), key, "left").unionByName(rare).drop("is_hot")


def bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A fixed 2**bits-bit map of the long column `key`: at most 2**(bits-6) rows reach the driver, whatever the size of `df`."""
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the map (no false negatives)."""
    slot = keys & np.uint64(len(bits) * 64 - 1)
    return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
