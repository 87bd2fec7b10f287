"""Appending to a JSON-lines sink exactly once: every batch has a commit record, and only committed files are read.

A batch is written to a folder of its own attempt, then committed by moving a small record to
`_commits/<number>.json`, which fails if that number is taken. A writer that dies before that
leaves files that nobody reads; one that finds its number taken looks at what the others have
committed and begins anew; a batch that is retried after its commit is not written again. The
move is atomic where the file system renames atomically.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.keys import null_safe_join


class CommitLog:
    """The commit records of a sink, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self.path(f"{path.rstrip('/')}/_commits")
        self.files = self.folder.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def read(self) -> list[dict]:
        """All records by number. They are driver metadata: one per batch."""
        if not self.files.exists(self.folder):
            return []
        names = sorted(s.getPath().getName() for s in self.files.listStatus(self.folder))
        return [json.loads(self._text(n)) for n in names if n.endswith(".json") and n[0] not in "._"]

    def _text(self, name: str) -> str:
        stream = self.files.open(self.path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def add(self, number: int, record: dict) -> bool:
        """Commits `record` as the `number`-th; False if another has that number."""
        self.files.mkdirs(self.folder)
        temporary, final = self.path(f"{self.folder}/.{uuid.uuid4().hex}"), self.path(f"{self.folder}/{number:012d}.json")
        stream = self.files.create(temporary, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.getFileSystem(self.conf).getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(temporary, final, none)
        except Exception as e:
            self.files.delete(temporary, False)
            if "FileAlreadyExists" in str(e) or self.files.exists(final):
                return False
            raise
        return True


def read_sink(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of all committed batches; none of a sink that is not there yet."""
    folders = [f"{path.rstrip('/')}/{r['folder']}" for r in CommitLog(spark, path).read() if r["rows"]]
    return spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)


def first_of_each(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """One row per key, the first by `order` (all columns, if none); NULL is a key."""
    by = order or [F.to_json(F.struct(*rows.columns))]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*by)).alias("_x")).select("_x.*")


def append_pending(tasks: DataFrame, path: str, key: str, batch: str | None = None, order: list[str | Column] | None = None) -> int:
    """Appends the tasks whose key the sink does not hold yet, one row per key; how many keys it then holds.

    `batch` names the batch: under a name that is committed already nothing is written. NULL is a key like any other. Of
    a key repeated in one batch the first row by `order` counts.
    """
    spark, log = tasks.sparkSession, CommitLog(tasks.sparkSession, path)
    batch = batch or uuid.uuid4().hex
    while True:
        done = log.read()
        if any(r["batch"] == batch for r in done):
            break
        held = read_sink(spark, path, tasks.schema).select(key).distinct()
        fresh = null_safe_join(first_of_each(tasks, key, order or []), held, [key], "left_anti") if done else first_of_each(tasks, key, order or [])
        folder = f"batch-{uuid.uuid4().hex}"
        fresh.write.json(f"{path.rstrip('/')}/{folder}")
        written = spark.read.schema(tasks.schema).json(f"{path.rstrip('/')}/{folder}")
        seen = written.agg(F.count(F.lit(1)).alias("rows"), F.min(F.col(key).cast("string")).alias("least"), F.max(F.col(key).cast("string")).alias("greatest")).first()
        if log.add(len(done), {"batch": batch, "folder": folder, **seen.asDict()}):
            break
    return sum(r["rows"] for r in log.read())
