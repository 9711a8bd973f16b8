"""Workflow runs: a journal and agents' transcripts in each run's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_lake.functions.text import agent_id, base_name
from transcript_lake.sources.jsonl import entry_rows, parsed, part

LINE = "type string, key string, agentId string, result variant"


def _run_id():
    return F.regexp_extract("file_path", r"/(wf_[^/]+)/[^/]*$", 1)


def journal(lines: DataFrame) -> DataFrame:
    """started and result events of journals; other types are left out."""
    rows = parsed(lines.where(base_name(F.col("file_path")) == "journal.jsonl"), LINE).where("j.type in ('started', 'result')")
    return rows.select(_run_id().alias("run_id"), "file_path", "line_no", F.col("j.type").alias("type"), F.col("j.key").alias("key"), F.col("j.agentId").alias("agent_id"), F.col("j.result").alias("result"))


def scoreboard(events: DataFrame) -> DataFrame:
    """Per run and agent: whether it started, and its last result."""
    last = F.max_by(F.to_json("result"), F.when(F.col("type") == "result", F.col("line_no")))
    return events.groupBy("run_id", "agent_id").agg(F.bool_or(F.col("type") == "started").alias("started"), last.alias("result"))


def runs(lines: DataFrame) -> DataFrame:
    """(run_id, agent_id, started, result, transcript): agents of the journal and of transcripts; either may lack the other."""
    files = lines.where(base_name(F.col("file_path")) != "journal.jsonl").select(_run_id().alias("run_id"), agent_id(F.col("file_path")).alias("agent_id"), F.col("file_path").alias("transcript")).where("run_id <> '' and agent_id is not null").distinct()
    return scoreboard(journal(lines)).join(files, ["run_id", "agent_id"], "full_outer").withColumn("started", F.coalesce("started", F.lit(False)))


def entries(lines: DataFrame) -> DataFrame:
    """Journal events as system entries."""
    rows = journal(lines)
    text = F.concat(F.lit("workflow agent "), F.coalesce("agent_id", F.lit("")), F.lit(" "), "type", F.lit(" (key "), F.coalesce("key", F.lit("")), F.lit(")"), F.when(F.col("result").isNotNull(), F.concat(F.lit("\n"), F.to_json("result"))).otherwise(""))
    return entry_rows(rows.select(F.lit("journal").alias("provider"), "file_path", F.col("run_id").alias("session_id"), F.col("line_no").alias("seq"), "type", F.lit("system").alias("role"), F.lit(True).alias("is_sidechain"), "agent_id", F.array(part(type=F.lit("text"), text=text)).alias("parts")))
