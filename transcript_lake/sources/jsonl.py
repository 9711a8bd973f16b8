"""Logs of one JSON object a line, as tables of raw lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.functions.text import base_name
from transcript_lake.operators.common import BROADCAST_ROWS
from transcript_lake.operators.rollup import PROVIDERS
from transcript_lake.sources.line_source import SPLIT_BYTES, LineSource, files_below

#: Lines longer than this are rejected, whichever source they come from.
MAX_LINE_BYTES = 16 * 1024 * 1024


def raw_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl", split_bytes: int = SPLIT_BYTES, log: Column | None = None) -> DataFrame:
    """(file_path, modified_at, line_no, line) of all files below path, numbered from 0 in each file. Files larger than
    split_bytes are read by several tasks; for those alone, a first pass counts the lines of each range, and its prefix sums
    are joined on. A missing folder has no lines.

    log: an expression of file_path that tells which files are one log, cut into files as it was written. Its lines are numbered through,
    files in the order of their paths; only the last may grow meanwhile."""
    spark.dataSource.register(LineSource)
    options = {"path": path, "pattern": pattern, "splitBytes": split_bytes}
    lines = spark.read.format("lines").options(**options).load()
    ranges = [-(-size // split_bytes) for _, size, _ in files_below(path, pattern) if size]
    wanted = sum(ranges) - (0 if log is not None else len(ranges))
    if not wanted:
        return lines.select("file_path", "modified_at", F.col("nth").alias("line_no"), "line")
    counts = spark.read.format("lines").options(**options, counts=True, **({} if log is None else {"countLast": True})).load()
    # a range's first number is the sum of those before it
    if log is None:
        before = Window.partitionBy("file_path").orderBy("range_start")
        firsts = counts.select("file_path", (F.col("range_start") + split_bytes).alias("range_start"), F.sum("lines").over(before).alias("first"))
    else:
        before = Window.partitionBy(log).orderBy("file_path", "range_start").rowsBetween(Window.unboundedPreceding, -1)
        firsts = counts.select("file_path", "range_start", F.sum("lines").over(before).alias("first"))
    firsts = F.broadcast(firsts) if wanted <= BROADCAST_ROWS else firsts  # one row a range
    numbered = lines.join(firsts, ["file_path", "range_start"], "left")
    return numbered.select("file_path", "modified_at", (F.col("nth") + F.coalesce("first", F.lit(0))).alias("line_no"), "line")


def head_lines(spark: SparkSession, path: str, n: int, pattern: str = "*.jsonl") -> DataFrame:
    """raw_lines of the first n lines of each file, of which no more is read than holds them."""
    spark.dataSource.register(LineSource)
    lines = spark.read.format("lines").option("path", path).option("pattern", pattern).option("headLines", n).load()
    return lines.select("file_path", "modified_at", F.col("nth").alias("line_no"), "line")


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw_lines without workflow journals."""
    return raw_lines(spark, path).where(base_name(F.col("file_path")) != "journal.jsonl")


def readable() -> Column:
    """Whether a line can be a record: not blank, not over-long, and an object once parsed."""
    return (F.octet_length("line") <= MAX_LINE_BYTES) & F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Per file, how many lines that are not blank could not be read; they never stop a job."""
    return lines.where((F.trim("line") != "") & ~readable()).groupBy("file_path").agg(F.count("*").alias("rejected"))


def parsed(lines: DataFrame, schema: str, hint: str | None = None) -> DataFrame:
    """lines with j, the record of the schema; lines that lack the hint are left out before they are parsed."""
    rows = lines if hint is None else lines.where(F.col("line").contains(hint))
    return rows.where(readable()).withColumn("j", F.from_json("line", schema, {"mode": "PERMISSIVE"}))


def instant(text: Column) -> Column:
    """RFC 3339 text as a timestamp; null where it is none."""
    return F.try_to_timestamp(text)


PART = "struct<type: string, text: string, tool_call_id: string, name: string, input: variant, status: string, output: string, title: string, diff: string, is_error: boolean>"
ENTRY = ["provider", "file_path", "session_id", "seq", "type", "uuid", "message_id", "role", "ts", "is_sidechain", "agent_id", "prompt_id", "custom_type", "parts", "tokens"]
TOKENS = "struct<input: bigint, output: bigint, reasoning: bigint, cache_read: bigint, cache_write: bigint, cost: double>"
USAGE = ["provider", "file_path", "line_no", "project", "session_id", "agent_id", "message_id", "request_id", "is_sidechain", "model", "ts", "input", "output", "cache_write_5m", "cache_write_1h", "cache_read", "reasoning", "native_cost"]


def part(**fields: Column) -> Column:
    """A part with the given fields, the others null."""
    types = {"type": "string", "text": "string", "tool_call_id": "string", "name": "string", "input": "variant", "status": "string", "output": "string", "title": "string", "diff": "string", "is_error": "boolean"}
    return F.struct(*[(fields[k] if k in fields else F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def shaped(df: DataFrame, columns: list[str], defaults: dict[str, str]) -> DataFrame:
    """df with exactly these columns; the missing ones null, of the type in defaults or string."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(defaults.get(c, "string")).alias(c) for c in columns])


def entry_rows(df: DataFrame) -> DataFrame:
    return shaped(df, ENTRY, {"seq": "bigint", "ts": "timestamp", "is_sidechain": "boolean", "parts": f"array<{PART}>", "tokens": TOKENS})


def usage_rows(df: DataFrame) -> DataFrame:
    longs = dict.fromkeys(["input", "output", "cache_write_5m", "cache_write_1h", "cache_read", "reasoning", "line_no"], "bigint")
    return shaped(df, USAGE, longs | {"is_sidechain": "boolean", "ts": "timestamp", "native_cost": "double"})


def scan_order(provider: Column, path: Column, line_no: Column) -> Column:
    """A key that orders rows as they are scanned: runtimes by rank, then paths, then lines. It is compared where rows meet, so
    nothing is ever ranked over all of them."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in enumerate(PROVIDERS) for x in kv[::-1]]), provider)
    return F.struct(rank.alias("rank"), path.alias("path"), line_no.alias("line"))


def arrival(usage: DataFrame) -> DataFrame:
    """usage with arrival, its key in the order of the scan."""
    return usage.withColumn("arrival", scan_order(F.col("provider"), F.col("file_path"), F.col("line_no")))
