"""A table of messages that takes each once, with the progress of every session.

Messages lie in buckets of their session's hash and in folders of their batch's number. A batch reads the ids of its own buckets
only, writes its own folder, and writes a row of progress for each session that it touches; done twice, it writes the same
again. Every few batches the folders are put together, bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.operators import messages
from transcript_lake.streaming import jobs

BUCKETS, EVERY = 256, 32
COUNTS = ["total", "user", "assistant"]


class MessageStore:
    """folder: where the tables live. A message's id is its session's and its own; of rows with one id, the first stays."""

    def __init__(self, folder: str, buckets: int = BUCKETS, every: int = EVERY) -> None:
        self.folder, self.buckets, self.every = folder.rstrip("/"), buckets, every

    def _paths(self, table: str, before: int, apart: bool = False) -> list[str]:
        """The folders that hold all batches before one: what was put together, and the batches since. apart: as they are before
        those are put together too."""
        upto = (before - apart) // self.every * self.every
        return [f"{self.folder}/{table}/upto={upto}"] * bool(upto) + [f"{self.folder}/{table}/batch={k}" for k in range(upto, before)]

    def _read(self, spark: SparkSession, table: str, before: int, like: DataFrame, within: list[int] | None = None, apart: bool = False) -> DataFrame:
        """A table as of the batches before one; of the given buckets, whose folders alone are read."""
        out = spark.createDataFrame([], like.schema)
        for path in self._paths(table, before, apart):
            rows = spark.read.schema(like.schema).parquet(path)
            out = out.unionByName(rows if within is None else rows.where(F.col("bucket").isin(within)))
        return out

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of (session_id, message_id, role, ts, seq, content); rows that repeat an id, in it or before it, go."""
        spark = batch.sparkSession
        rows = batch.select("session_id", "message_id", "role", "ts", "seq", "content").withColumns({"id": F.concat_ws("_", "session_id", "message_id"), "bucket": F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int")})
        first = Window.partitionBy("bucket", "id").orderBy("seq", "content")
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        within = [r.bucket for r in rows.select("bucket").distinct().collect()]  # no more than there are buckets
        known = self._read(spark, "messages", number, rows, within).select("bucket", "id")
        self._write(rows.join(known, ["bucket", "id"], "left_anti").select(*rows.columns), "messages", number)
        new = spark.read.schema(rows.schema).parquet(f"{self.folder}/messages/batch={number}")
        role = lambda r: F.count_if(F.col("role") == r)
        come = new.groupBy("bucket", "session_id").agg(F.count("*").alias("total"), role("user").alias("user"), role("assistant").alias("assistant"), F.max("seq").alias("last_seq"), F.max_by("message_id", "seq").alias("last_message_id"))
        shape = come.withColumn("number", F.lit(number))
        before = self.latest(self._read(spark, "progress", number, shape, within)).drop("number")
        both = before.join(come.select("bucket", "session_id"), ["bucket", "session_id"], "left_semi").unionByName(come)
        merged = both.groupBy("bucket", "session_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("last_seq").alias("last_seq"), F.max_by("last_message_id", "last_seq").alias("last_message_id"))
        self._write(merged.withColumn("number", F.lit(number)).select(*shape.columns), "progress", number)
        if (number + 1) % self.every == 0:
            self._write(self._read(spark, "messages", number + 1, rows, apart=True), "messages", number + 1, "upto")
            self._write(self.latest(self._read(spark, "progress", number + 1, shape, apart=True)).select(*shape.columns), "progress", number + 1, "upto")

    def _write(self, rows: DataFrame, table: str, number: int, kind: str = "batch") -> None:
        """A bucket's rows in one task, so that it has one file a folder; an empty table has none, and its folder."""
        path = f"{self.folder}/{table}/{kind}={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    @staticmethod
    def latest(progress: DataFrame) -> DataFrame:
        newest = Window.partitionBy("bucket", "session_id").orderBy(F.desc("number"))
        return progress.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")

    def messages(self, spark: SparkSession, number: int) -> DataFrame:
        """All messages as of a batch."""
        schema = "session_id string, message_id string, role string, ts timestamp, seq bigint, content string, id string, bucket int"
        return self._read(spark, "messages", number + 1, spark.createDataFrame([], schema))

    def progress(self, spark: SparkSession, number: int) -> DataFrame:
        """A row a session as of a batch: how many messages, by role, the last one's place and id."""
        schema = "bucket int, session_id string, total bigint, user bigint, assistant bigint, last_seq bigint, last_message_id string, number int"
        return self.latest(self._read(spark, "progress", number + 1, spark.createDataFrame([], schema))).drop("bucket", "number")


def extract(store: MessageStore) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over tailed lines: their messages into the store."""

    def add(batch: DataFrame, number: int) -> None:
        store.add(messages.messages(jobs.normalised(batch)), number)

    return add
