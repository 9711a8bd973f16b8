"""Streaming jobs over growing logs. The batch operators stay the truth; streams keep tables current.

A watermark only bounds state: rows later than it are left to the next batch run.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.functions.text import agent_id, provider_of
from transcript_lake.operators import messages
from transcript_lake.sources import claude, codex, opencode, pi
from transcript_lake.sources.line_source import files_below
from transcript_lake.streaming.tail_source import TailSource

WATERMARK = "24 hours"

#: Message files of a fragment store that one batch takes.
FRAGMENTS = 1000
RUNNING_FOR = timedelta(minutes=2)
RECENT = timedelta(minutes=5)
SOURCES = {"claude": claude, "codex": codex, "pi": pi}


def tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file_path, generation, offset, line) of the logs below path as they grow; new files and folders are found as they come."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).options(**options).load()


def tagged(lines: DataFrame) -> DataFrame:
    """Lines of a workflow's journal and agents as one stream, with the agent that wrote each."""
    return lines.withColumn("agent_id", agent_id(F.col("file_path")))


def normalised(lines: DataFrame) -> DataFrame:
    """A batch of tailed lines as entries, each runtime's by its own rules; unknown ones as claude's;
    opencode's are no lines, and come by fragment_entries. Calls and results are rows of their own; calls.held_calls joins them."""
    rows = lines.withColumns({"line_no": F.col("offset"), "_provider": provider_of(F.col("file_path"))})
    out = None
    for name, source in SOURCES.items():
        part = source.entries(rows.where(F.col("_provider") == name))
        out = part if out is None else out.unionByName(part)
    return out


def current(lines: DataFrame) -> DataFrame:
    """Of a table of tailed lines, those of each file's last generation, each once."""
    last = F.max("generation").over(Window.partitionBy("file_path"))
    return lines.withColumn("_g", last).where("generation = _g").drop("_g").dropDuplicates(["file_path", "offset"])


def land(lines: DataFrame, table: str, checkpoint: str, every: str = "2 seconds"):
    """Appends tailed lines to a Parquet table by file, at least once; current() takes repeats and old generations out."""
    return lines.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append").start()


def store_messages(target: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends messages whose id (session and message) the table lacks, so that a batch done twice adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("id", F.concat_ws("_", "session_id", "message_id")).dropDuplicates(["id"])
        try:
            known = spark.read.parquet(target).select("id")
            new = new.join(known, "id", "left_anti")
        except Exception as e:  # the first batch: no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    return add


def extract_messages(target: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over tailed lines: their messages into the table."""
    store = store_messages(target)

    def add(batch: DataFrame, number: int) -> None:
        found = messages.messages(normalised(batch))
        store(found.select("session_id", "message_id", "role", "ts", "seq", "content"), number)

    return add


def streaming_dedup(usage: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Usage rows of a stream without replays of one message and request; rows without a message id pass. State lasts for the watermark."""
    key = F.when(F.coalesce("message_id", F.lit("")) == "", F.concat_ws(":", "file_path", "line_no")).otherwise(F.concat_ws(":", "message_id", "request_id"))
    return usage.withColumn("_key", key).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def session_status(entries: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """Per session: running if its file grew in the last two minutes or a tool is in flight, else idle. files: session_id, modified_at."""
    parts = entries.select("session_id", "seq", F.explode("parts").alias("p"))
    calls = parts.where("p.type = 'tool_call'").select("session_id", "seq", F.col("p.tool_call_id").alias("call_id"), F.col("p.name").alias("name"))
    results = parts.where("p.type = 'tool_result'").select("session_id", "seq", F.col("p.tool_call_id").alias("call_id"))
    flying = messages.in_flight_tool(calls, results).select("session_id", "in_flight_tool")
    rows = files.groupBy("session_id").agg(F.max("modified_at").alias("modified_at")).join(flying, "session_id", "left")
    fresh = F.lit(now) - F.col("modified_at") < F.lit(RUNNING_FOR)
    return rows.withColumn("state", F.when(fresh | F.col("in_flight_tool").isNotNull(), "running").otherwise("idle"))


def active_sessions(lines: DataFrame, sessions: DataFrame, now: datetime) -> DataFrame:
    """Rows of a stream whose session runs, or was completed in the last five minutes."""
    live = sessions.where((F.col("status") == "running") | ((F.col("status") == "completed") & (F.col("ended_at") > F.lit(now - RECENT))))
    return lines.join(live.select("session_id").distinct(), "session_id", "left_semi")


def new_fragments(spark: SparkSession, storage: str, schema: str, watermark: str = WATERMARK, most: int = FRAGMENTS) -> DataFrame:
    """Message files of a fragment store as they come, each id once, at most so many a batch."""
    rows = spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "msg_*.json").option("maxFilesPerTrigger", most).json(f"{storage}/message")
    return rows.withColumns({"ts": F.timestamp_millis("time.created"), "file_path": F.col("_metadata.file_path")}).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])


def fragment_entries(storage: str, report: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over new_fragments of the opencode runtime: reports their entries, with the parts that are there by then.
    Only the batch's own part folders are read; their names, no more than FRAGMENTS, are all that comes to the driver. seq is
    the message's time in milliseconds, as a batch does not know the session's others."""

    def add(batch: DataFrame, number: int) -> None:
        ids = [r.id for r in batch.select("id").distinct().collect() if "/" not in r.id]
        folders = [f"{storage}/part/{i}" for i in ids if next(files_below(f"{storage}/part/{i}", "*.json"), None)]
        report(opencode.entries(batch, opencode.parts_in(batch.sparkSession, folders)).withColumn("seq", F.unix_millis("ts")))

    return add
