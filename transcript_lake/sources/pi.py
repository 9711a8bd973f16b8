"""Session trees of the pi runtime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.functions.text import tree_session_id
from transcript_lake.functions.usage import zero
from transcript_lake.sources.jsonl import PART, entry_rows, instant, parsed, part, usage_rows

USAGE = "struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint, reasoning: bigint, cost: struct<total: double>>"
LINE = f"type string, id string, parentId string, timestamp string, cwd string, display boolean, customType string, content variant, data variant, message struct<role: string, model: string, stopReason: string, toolCallId: string, toolName: string, isError: boolean, content: variant, usage: {USAGE}>"
BLOCK = "array<struct<type: string, text: string, thinking: string, id: string, name: string, arguments: variant>>"


def rows(lines: DataFrame) -> DataFrame:
    """Parsed lines with the session id and directory of the file's header on each; without a header, and in a
    stream, where no row knows the header's, the name tells the id."""
    if lines.isStreaming:
        return parsed(lines, LINE).withColumns({"session_id": tree_session_id(F.col("file_path")), "cwd": F.lit(None).cast("string")})
    whole = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = parsed(lines, LINE)
    header = lambda f: F.last(F.when(F.col("j.type") == "session", F.col(f"j.{f}")), ignorenulls=True).over(whole)
    return out.withColumns({"session_id": F.coalesce(header("id"), tree_session_id(F.col("file_path"))), "cwd": header("cwd")})


def usage_entries(lines: DataFrame) -> DataFrame:
    """A row for each assistant message with usage, whatever its branch. The log's own cost counts, even 0."""
    r = rows(lines).where("j.type = 'message' and j.message.role = 'assistant' and j.message.usage is not null")
    u = F.col("j.message.usage")
    return usage_rows(r.select(
        F.lit("pi").alias("provider"), "file_path", "line_no", F.col("cwd").alias("project"), "session_id", F.lit("").alias("message_id"), F.lit("").alias("request_id"), F.lit(False).alias("is_sidechain"), F.col("j.message.model").alias("model"), instant(F.col("j.timestamp")).alias("ts"),
        zero(u["input"]).alias("input"), zero(u["output"]).alias("output"), zero(u["cacheWrite"]).alias("cache_write_5m"), F.lit(0).cast("long").alias("cache_write_1h"), zero(u["cacheRead"]).alias("cache_read"), F.lit(0).cast("long").alias("reasoning"), F.coalesce(u["cost"]["total"], F.lit(0.0)).alias("native_cost"),
    ))


def tree_rows(lines: DataFrame) -> DataFrame:
    """(session_id, file_path, seq, type, id, parent_id, custom_type, data_json, model, tokens): the tree's rows as operators.tree reads them."""
    u = F.col("j.message.usage")
    return rows(lines).select("session_id", "file_path", F.col("line_no").alias("seq"), F.col("j.type").alias("type"), F.col("j.id").alias("id"), F.col("j.parentId").alias("parent_id"), F.col("j.customType").alias("custom_type"), F.to_json("j.data").alias("data_json"), F.col("j.message.model").alias("model"), zero(u["input"]).alias("input"), zero(u["output"]).alias("output"), zero(u["cacheRead"]).alias("cache_read"), zero(u["cacheWrite"]).alias("cache_write_5m"), u["cost"]["total"].alias("native_cost"))


def entries(lines: DataFrame) -> DataFrame:
    """User, assistant and tool-result messages, and injected ones as user turns with their custom type unless hidden."""
    r = rows(lines)
    injected = F.col("j.type") == "custom_message"
    content = F.when(injected, F.col("j.content")).otherwise(F.col("j.message.content"))
    blocks = F.filter(F.try_variant_get(content, "$", BLOCK), lambda b: b["type"].isin("text", "thinking", "toolCall"))
    kind = lambda b: F.when(b["type"] == "thinking", "reasoning").when(b["type"] == "toolCall", "tool_call").otherwise("text")
    parts = F.transform(blocks, lambda b: part(type=kind(b), text=F.coalesce(b["text"], b["thinking"]), tool_call_id=b["id"], name=b["name"], input=b["arguments"]))
    plain = F.when(F.schema_of_variant(content) == "STRING", F.array(part(type=F.lit("text"), text=F.try_variant_get(content, "$", "string"))))
    said = F.coalesce(plain, parts, F.array().cast(f"array<{PART}>"))
    m = F.col("j.message")
    result = F.array(part(type=F.lit("tool_result"), tool_call_id=m["toolCallId"], name=m["toolName"], output=F.array_join(F.transform(F.filter(said, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"), is_error=F.coalesce(m["isError"], F.lit(False))))
    u = m["usage"]
    tokens = F.when(u.isNotNull(), F.struct(zero(u["input"]).alias("input"), zero(u["output"]).alias("output"), zero(u["reasoning"]).alias("reasoning"), zero(u["cacheRead"]).alias("cache_read"), zero(u["cacheWrite"]).alias("cache_write"), u["cost"]["total"].alias("cost")))
    kept = r.where((injected & F.coalesce("j.display", F.lit(True))) | ((F.col("j.type") == "message") & m["role"].isin("user", "assistant", "toolResult")))
    return entry_rows(kept.select(
        F.lit("pi").alias("provider"), "file_path", "session_id", F.col("line_no").alias("seq"), F.col("j.type").alias("type"), F.col("j.id").alias("uuid"), F.col("j.id").alias("message_id"), F.when(injected | (m["role"] == "toolResult"), "user").otherwise(m["role"]).alias("role"), instant(F.col("j.timestamp")).alias("ts"), F.lit(False).alias("is_sidechain"),
        F.when(injected, F.coalesce("j.customType", F.lit(""))).alias("custom_type"), F.when(m["role"] == "toolResult", result).otherwise(said).alias("parts"), tokens.alias("tokens"),
    ))
