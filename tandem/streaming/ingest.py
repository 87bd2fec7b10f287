"""Incremental ingestion of runs and verdicts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources.sinks import append_pending


def read_runs_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_per_key(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first record of each key; state is dropped once the watermark has passed it by `delay`."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ingest_runs_stream(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str, key: str, time: str, delay: str = "1 day"):
    """Drains the files that are there into a Parquet sink, first record per key; a restart resumes at the checkpoint."""
    stream = first_per_key(read_runs_stream(spark, path, schema), key, time, delay)
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_runs_once(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str, key: str, order: list[str], files_per_trigger: int = 1):
    """Drains the files that are there into a sink with a commit record per batch: the first record of each key ever, without a watermark.

    A trigger that is run again after a failure, its batch committed or not, leaves each key once. Batches are named by
    the stream's checkpoint and number.
    """

    def write(batch: DataFrame, nth: int) -> None:
        append_pending(batch, sink, key, f"{checkpoint}#{nth}", order)

    stream = read_runs_stream(spark, path, schema, files_per_trigger)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdict_join_stream(generations: DataFrame, verdicts: DataFrame, key: str, answer: str) -> DataFrame:
    """Generations with their verdict (static or streaming side): an empty answer is wrong by rule and needs none."""
    empty = F.trim(F.coalesce(F.col(answer), F.lit(""))) == ""
    both = generations.join(verdicts.withColumnRenamed(key, "_v"), F.col(key) == F.col("_v"), "left").drop("_v")
    return both.withColumn("verdict", F.when(empty, F.lit(False)).otherwise(F.col("correct"))).where(F.col("verdict").isNotNull()).drop("correct")


def verdict_join_streams(generations: DataFrame, verdicts: DataFrame, key: str, answer: str, time: str, verdict_time: str, within: str = "30 days") -> DataFrame:
    """The same with both sides streaming: verdicts may come before or after their generation within an interval, which bounds the state."""
    g, v = generations.withWatermark(time, within), verdicts.withColumnRenamed(key, "_v").withWatermark(verdict_time, within)
    near = (F.col(key) == F.col("_v")) & (F.col(verdict_time) >= F.col(time) - F.expr(f"INTERVAL {within}")) & (F.col(verdict_time) <= F.col(time) + F.expr(f"INTERVAL {within}"))
    empty = F.trim(F.coalesce(F.col(answer), F.lit(""))) == ""
    return g.where(~empty).join(v, near).withColumn("verdict", F.col("correct")).drop("_v", "correct")


def live_unit_counts(stream: DataFrame, by: list[str], outcome: str) -> DataFrame:
    """Runs and correct runs per group, kept current."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col(outcome).cast("long")).alias("correct"))


def drain_counts(counts: DataFrame, sink: str, checkpoint: str) -> None:
    """Runs a stream of counts over what is there; each trigger writes the groups that it changed, as Parquet below `sink`, in a folder of its own that a repeated trigger writes anew."""

    def write(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={nth}")

    counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_counts(spark: SparkSession, sink: str, by: list[str]) -> DataFrame:
    """The newest row of each group that `drain_counts` wrote."""
    rows = spark.read.parquet(sink)
    values = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*by, "x.*")
