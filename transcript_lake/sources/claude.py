"""Logs of the claude runtime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_lake.functions.text import agent_id, filled, session_parts
from transcript_lake.functions.usage import cache_creation_split, zero
from transcript_lake.sources.jsonl import ENTRY, entry_rows, instant, parsed, part, usage_rows

USAGE = "struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint, cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>>"
LINE = f"type string, sessionId string, uuid string, requestId string, agentId string, promptId string, cwd string, isSidechain boolean, timestamp string, costUSD double, message struct<id: string, role: string, model: string, content: variant, usage: {USAGE}>"
BLOCK = "array<struct<type: string, text: string, thinking: string, id: string, name: string, input: variant, tool_use_id: string, content: variant, is_error: boolean>>"


def usage_entries(lines: DataFrame) -> DataFrame:
    """A row for each line whose message has usage."""
    rows = parsed(lines, LINE, '"usage"').where("j.message.usage is not null")
    u, place = F.col("j.message.usage"), session_parts(F.col("file_path"))
    five, hour = cache_creation_split(u["cache_creation_input_tokens"], u["cache_creation"])
    return usage_rows(rows.select(
        F.lit("claude").alias("provider"), "file_path", "line_no", place["project"].alias("project"), place["session_id"].alias("session_id"), agent_id(F.col("file_path")).alias("agent_id"),
        F.coalesce("j.message.id", F.lit("")).alias("message_id"), F.coalesce("j.requestId", F.lit("")).alias("request_id"), F.coalesce("j.isSidechain", F.lit(False)).alias("is_sidechain"), F.col("j.message.model").alias("model"), instant(F.col("j.timestamp")).alias("ts"),
        zero(u["input_tokens"]).alias("input"), zero(u["output_tokens"]).alias("output"), five.alias("cache_write_5m"), hour.alias("cache_write_1h"), zero(u["cache_read_input_tokens"]).alias("cache_read"), F.lit(0).cast("long").alias("reasoning"), F.col("j.costUSD").alias("native_cost"),
    ))


def entries(lines: DataFrame) -> DataFrame:
    """User and assistant lines with their parts: text, reasoning, tool_call, tool_result. Content may be a string or blocks; what a tool returned other than as a string is ''."""
    rows = parsed(lines, LINE).where("j.type in ('user', 'assistant')")
    content = F.col("j.message.content")
    said = F.try_variant_get(content, "$", "string")
    blocks = F.filter(F.try_variant_get(content, "$", BLOCK), lambda b: b["type"].isin("text", "thinking", "tool_use", "tool_result"))
    kind = lambda b: F.when(b["type"] == "thinking", "reasoning").when(b["type"] == "tool_use", "tool_call").otherwise(b["type"])
    is_result = lambda b: b["type"] == "tool_result"
    output = lambda b: F.when(is_result(b), F.when(F.schema_of_variant(b["content"]) == "STRING", F.try_variant_get(b["content"], "$", "string")).otherwise(F.lit("")))
    parts = F.transform(blocks, lambda b: part(type=kind(b), text=F.coalesce(b["text"], b["thinking"]), tool_call_id=F.coalesce(b["id"], b["tool_use_id"]), name=b["name"], input=b["input"], output=F.coalesce(output(b), F.when(is_result(b), F.lit(""))), is_error=F.when(is_result(b), F.coalesce(b["is_error"], F.lit(False)))))
    plain = F.when(F.schema_of_variant(content) == "STRING", F.array(part(type=F.lit("text"), text=said)))
    return entry_rows(rows.select(
        F.lit("claude").alias("provider"), "file_path", F.coalesce("j.sessionId", session_parts(F.col("file_path"))["session_id"]).alias("session_id"), F.col("line_no").alias("seq"), F.col("j.type").alias("type"), F.col("j.uuid").alias("uuid"), F.col("j.message.id").alias("message_id"),
        F.coalesce("j.message.role", "j.type").alias("role"), instant(F.col("j.timestamp")).alias("ts"), F.coalesce("j.isSidechain", F.lit(False)).alias("is_sidechain"), F.col("j.agentId").alias("agent_id"), F.col("j.promptId").alias("prompt_id"), F.coalesce(plain, parts, F.array().cast(f"array<{_part_type()}>")).alias("parts"),
    ))


def header_lines(lines: DataFrame) -> DataFrame:
    """(file_path, line_no, cwd, session_id, ts, text) of lines, as catalog.header_facts and inner_session_ids take them."""
    content = F.col("j.message.content")
    texts = F.array_join(F.transform(F.filter(F.try_variant_get(content, "$", BLOCK), lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    said = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(texts)
    return parsed(lines, LINE).select("file_path", "line_no", filled(F.col("j.cwd")).alias("cwd"), filled(F.col("j.sessionId")).alias("session_id"), instant(F.col("j.timestamp")).alias("ts"), F.coalesce(said, F.lit("")).alias("text"))


def _part_type() -> str:
    from transcript_lake.sources.jsonl import PART

    return PART


def merged_results(rows: DataFrame) -> DataFrame:
    """rows with each call's output and is_error from its first result in the session, and without the entries of results alone."""
    from transcript_lake.operators.messages import with_results

    each = rows.select("session_id", "seq", F.posexplode("parts").alias("k", "p"))
    calls = each.where("p.type = 'tool_call'").select("session_id", "seq", F.col("p.tool_call_id").alias("call_id"))
    results = each.where("p.type = 'tool_result'").select("session_id", "seq", F.col("p.tool_call_id").alias("call_id"), F.col("p.output").alias("output"), F.col("p.is_error").alias("is_error"))
    found = with_results(calls.distinct(), results).where("has_result").groupBy("session_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("call_id", F.struct("output", "is_error")))).alias("_r"))
    out = rows.join(found, ["session_id", "seq"], "left")
    filled = F.transform("parts", lambda p: F.when((p["type"] == "tool_call") & F.map_contains_key(F.coalesce("_r", F.create_map().cast("map<string, struct<output: string, is_error: boolean>>")), F.coalesce(p["tool_call_id"], F.lit(""))), p.withField("output", F.col("_r")[p["tool_call_id"]]["output"]).withField("is_error", F.col("_r")[p["tool_call_id"]]["is_error"]).withField("status", F.lit("completed"))).otherwise(p))
    alone = (F.size("parts") > 0) & F.forall("parts", lambda p: p["type"] == "tool_result")
    return out.withColumn("parts", filled).where(~alone).select(*ENTRY)
