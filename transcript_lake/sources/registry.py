"""Session registries and archives: one metadata.json a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.functions.text import base_name, filled
from transcript_lake.sources.jsonl import instant

METADATA = "session_id string, claude_session_id string, provider string, native_session_id string, working_directory string, plan_name string, job_file_path string, status string, pid int, started_at string, attempt_id string, transcript_path string"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A row for each metadata.json below path that can be read and names a session; native_id is the runtime's own id."""
    rows = spark.read.schema(METADATA).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(path)
    native = F.coalesce(filled(F.col("native_session_id")), filled(F.col("claude_session_id")), "session_id")
    return rows.where("session_id is not null").withColumns({"native_id": native, "started_at": instant(F.col("started_at")), "file_path": F.col("_metadata.file_path")})


def archived(spark: SparkSession, path: str) -> DataFrame:
    """Archived sessions whose transcript is there: a file of the archive's folder, or the path in the metadata."""
    rows = registry(spark, path).withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ""))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path")
    here = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("path").alias("found")).groupBy("folder").agg(F.min("found").alias("found"))
    out = rows.join(here, "folder", "left").withColumn("path", F.coalesce("found", filled(F.col("transcript_path"))))
    return out.where(F.col("path").isNotNull()).drop("found")


def with_transcript(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Registry rows whose transcript is among files (file_path), compared by name."""
    named = files.select(base_name(F.col("file_path")).alias("_name")).distinct()
    return rows.join(named, base_name(F.col("transcript_path")) == F.col("_name"), "left_semi")
