"""Fragment stores of the opencode runtime: one JSON file a session, message and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.functions.text import filled, patch_title
from transcript_lake.functions.usage import zero
from transcript_lake.sources.jsonl import entry_rows, part, usage_rows
from transcript_lake.sources.line_source import FragmentSource

SESSION = "id string, projectID string, directory string, title string, time struct<created: bigint, updated: bigint>"
MESSAGE = "id string, sessionID string, role string, providerID string, modelID string, cost double, time struct<created: bigint, completed: bigint>, tokens struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>"
PART = "id string, sessionID string, messageID string, type string, text string, callID string, tool string, state struct<status: string, output: string, title: string, input: variant, metadata: struct<diff: string>>, hash string, files array<string>"


def fragments(spark: SparkSession, storage: str, kind: str, schema: str) -> DataFrame:
    """The files of storage/kind; one that cannot be read gives a row without id, which goes. A folder that is not there has none.
    Folders are listed where they are read, so a file a message asks neither for a task a file nor for a list of all in the driver."""
    spark.dataSource.register(FragmentSource)
    files = spark.read.format("fragments").option("path", f"{storage}/{kind}").load()
    return files.select(F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("j"), "file_path").where("j.id is not null").select("j.*", "file_path")


def parts_in(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The parts in the given folders, as fragments gives those of all."""
    if not folders:
        return spark.createDataFrame([], f"{PART}, file_path string")
    read = spark.read.schema(PART).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json")
    return read.json(folders).withColumn("file_path", F.col("_metadata.file_path")).where("id is not null")


def store(spark: SparkSession, storage: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, parts)."""
    return tuple(fragments(spark, storage, k, s) for k, s in (("session", SESSION), ("message", MESSAGE), ("part", PART)))


def session_catalogue(sessions: DataFrame) -> DataFrame:
    """Sessions with their project path (the directory, else the project's id) and start."""
    return sessions.select(F.col("id").alias("session_id"), F.coalesce(filled(F.col("directory")), "projectID").alias("project"), "title", F.timestamp_millis("time.created").alias("started_at"), F.timestamp_millis("time.updated").alias("updated_at"), F.col("file_path").alias("path"))


def usage_entries(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """A row for each message with input or output tokens. Only a cost above 0 is the log's own."""
    t = F.col("tokens")
    rows = messages.where((zero(t["input"]) > 0) | (zero(t["output"]) > 0)).join(session_catalogue(sessions).select("session_id", "project"), F.col("sessionID") == F.col("session_id"), "left")
    model = F.concat_ws("/", filled(F.col("providerID")), filled(F.col("modelID")))
    return usage_rows(rows.select(
        F.lit("opencode").alias("provider"), "file_path", F.lit(0).cast("long").alias("line_no"), "project", F.col("sessionID").alias("session_id"), F.col("id").alias("message_id"), F.lit("").alias("request_id"), F.lit(False).alias("is_sidechain"), model.alias("model"), F.timestamp_millis("time.created").alias("ts"),
        zero(t["input"]).alias("input"), zero(t["output"]).alias("output"), zero(t["cache"]["write"]).alias("cache_write_5m"), F.lit(0).cast("long").alias("cache_write_1h"), zero(t["cache"]["read"]).alias("cache_read"), zero(t["reasoning"]).alias("reasoning"), F.when(F.col("cost") > 0, F.col("cost")).alias("native_cost"),
    ))


def transcript(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages with their parts by id, and their place in the session by time."""
    from pyspark.sql import Window

    mine = parts.groupBy("messageID").agg(F.array_sort(F.collect_list(F.struct("id", "type", "text", "callID", "tool", F.struct(F.col("state.status").alias("status"), F.col("state.output").alias("output"), F.col("state.title").alias("title"), F.to_json("state.input").alias("input"), F.col("state.metadata.diff").alias("diff")).alias("state"), "hash", "files"))).alias("ps"))
    rows = messages.join(mine, messages["id"] == mine["messageID"], "left")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("sessionID").orderBy("time.created", "id")).cast("long"))


def entries(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages as entries: text, tool calls with their results, patches as calls of `patch`. Step marks go, and messages without parts."""
    rows = transcript(messages, parts)
    kept = F.filter("ps", lambda p: p["type"].isin("text", "tool", "patch"))
    tool = lambda p: part(type=F.lit("tool_call"), tool_call_id=p["callID"], name=p["tool"], input=F.try_parse_json(p["state"]["input"]), status=p["state"]["status"], output=p["state"]["output"], title=p["state"]["title"], diff=p["state"]["diff"], is_error=p["state"]["status"] == "error")
    patch = lambda p: part(type=F.lit("tool_call"), tool_call_id=p["id"], name=F.lit("patch"), status=F.lit("completed"), title=patch_title(p["files"], p["hash"]))
    made = F.transform(kept, lambda p: F.when(p["type"] == "text", part(type=F.lit("text"), text=p["text"])).when(p["type"] == "tool", tool(p)).otherwise(patch(p)))
    t = F.col("tokens")
    counted = F.when((zero(t["input"]) > 0) | (zero(t["output"]) > 0), F.struct(zero(t["input"]).alias("input"), zero(t["output"]).alias("output"), zero(t["reasoning"]).alias("reasoning"), zero(t["cache"]["read"]).alias("cache_read"), zero(t["cache"]["write"]).alias("cache_write"), F.col("cost").alias("cost")))
    return entry_rows(rows.where(F.size(kept) > 0).select(F.lit("opencode").alias("provider"), "file_path", F.col("sessionID").alias("session_id"), "seq", F.lit("message").alias("type"), F.col("id").alias("uuid"), F.col("id").alias("message_id"), "role", F.timestamp_millis("time.created").alias("ts"), F.lit(False).alias("is_sidechain"), made.alias("parts"), counted.alias("tokens")))
