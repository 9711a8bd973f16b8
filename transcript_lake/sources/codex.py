"""Rollouts of the codex runtime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcript_lake.functions.text import filled, rollout_session_id
from transcript_lake.functions.usage import zero
from transcript_lake.operators.codex import carry_forward, cumulative_delta, final_value
from transcript_lake.sources.jsonl import PART, entry_rows, instant, parsed, part, usage_rows

COUNTS = "struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint, total_tokens: bigint>"
PAYLOAD = (
    f"struct<id: string, cwd: string, model: string, type: string, role: string, name: string, message: string, text: string, arguments: string, call_id: string, output: string, content: array<struct<type: string, text: string>>, "
    f"info: struct<total_token_usage: {COUNTS}, last_token_usage: {COUNTS}, model_context_window: bigint>, total_token_usage: {COUNTS}, last_token_usage: {COUNTS}>"
)
LINE = f"timestamp string, type string, payload {PAYLOAD}"
UNKNOWN_MODEL = "codex/unknown"
CLASSES = ["input", "output", "cache_read"]


def split(counts: Column) -> Column:
    """Cached input is taken out of input, which does not fall below 0."""
    cached, given = zero(counts["cached_input_tokens"]), zero(counts["input_tokens"])
    return F.when(counts.isNotNull(), F.struct(F.greatest(given - cached, F.lit(0).cast("long")).alias("input"), zero(counts["output_tokens"]).alias("output"), cached.alias("cache_read"), zero(counts["reasoning_output_tokens"]).alias("reasoning")))


def _envelopes(lines: DataFrame) -> DataFrame:
    p = F.col("j.payload")
    rows = parsed(lines, LINE)
    counted = (F.col("j.type") == "event_msg") & (p["type"] == "token_count")
    return rows.select(
        "file_path", "line_no", instant(F.col("j.timestamp")).alias("ts"), F.col("j.type").alias("type"), p.alias("p"),
        F.when(F.col("j.type") == "session_meta", filled(p["id"])).alias("session_id"), F.when(F.col("j.type") == "session_meta", filled(p["cwd"])).alias("project"), F.when(F.col("j.type") == "turn_context", filled(p["model"])).alias("model"),
        F.when(counted, split(F.coalesce(p["info"]["total_token_usage"], p["total_token_usage"]))).alias("total"), F.when(counted, split(F.coalesce(p["info"]["last_token_usage"], p["last_token_usage"]))).alias("last"), p["info"]["model_context_window"].alias("context_window"),
    )


def token_counts(lines: DataFrame) -> DataFrame:
    """Token counts in file order, with the model and session in effect; a count without figures is none."""
    rows = final_value(carry_forward(_envelopes(lines), ["model", "session_id"]), ["project"])
    return rows.where("total is not null")


def usage_entries(lines: DataFrame) -> DataFrame:
    """A row for each rise of the cumulative counts. Message ids are empty: these rows are never replays."""
    rows = cumulative_delta(token_counts(lines), CLASSES)
    return usage_rows(rows.select(
        F.lit("codex").alias("provider"), "file_path", "line_no", "project", F.coalesce("session_id", rollout_session_id(F.col("file_path"))).alias("session_id"), F.lit("").alias("message_id"), F.lit("").alias("request_id"), F.lit(False).alias("is_sidechain"),
        F.coalesce("model", F.lit(UNKNOWN_MODEL)).alias("model"), "ts", "input", "output", "cache_read", *[F.lit(0).cast("long").alias(c) for c in ("cache_write_5m", "cache_write_1h", "reasoning")],
    ))


def entries(lines: DataFrame) -> DataFrame:
    """Agent messages, reasoning, user messages, calls and results; token counts as entries without parts. Messages that only
    set the environment are left out; arguments that are no JSON are kept as text. In a stream, where no row knows those before
    it, the session is that of the file's name."""
    rows = _envelopes(lines)
    rows = rows.withColumn("session_id", F.lit(None).cast("string")) if lines.isStreaming else carry_forward(rows, ["session_id"])
    p, kind = F.col("p"), F.concat_ws(".", "type", "p.type")
    arguments = F.coalesce(F.try_parse_json(p["arguments"]), F.parse_json(F.to_json(F.struct(F.nullif(p["arguments"], F.lit("")).alias("arguments")))))
    texts = F.transform(F.filter(p["content"], lambda c: c["type"].isin("input_text", "output_text") & (F.coalesce(c["text"], F.lit("")) != "")), lambda c: part(type=F.lit("text"), text=c["text"]))
    exit_code = F.try_variant_get(F.try_parse_json(p["output"]), "$.metadata.exit_code", "int")
    none = F.array().cast(f"array<{PART}>")
    parts = (
        F.when(kind == "event_msg.agent_reasoning", F.array(part(type=F.lit("reasoning"), text=p["text"])))
        .when(kind == "event_msg.agent_message", F.array(part(type=F.lit("text"), text=p["message"])))
        .when(kind == "event_msg.token_count", none)
        .when(kind == "response_item.message", texts)
        .when(kind == "response_item.function_call", F.array(part(type=F.lit("tool_call"), tool_call_id=p["call_id"], name=p["name"], input=arguments)))
        .when(kind == "response_item.function_call_output", F.array(part(type=F.lit("tool_result"), tool_call_id=p["call_id"], output=F.coalesce(F.try_variant_get(F.try_parse_json(p["output"]), "$.output", "string"), F.lit("")), is_error=F.coalesce(exit_code != 0, F.lit(False)))))
    )
    role = F.when(kind == "response_item.message", F.coalesce(F.nullif(p["role"], F.lit("")), F.lit("user"))).otherwise("assistant")
    setting = (kind == "response_item.message") & (F.coalesce(p["role"] == "assistant", F.lit(False)) | F.exists(F.coalesce(p["content"], F.array().cast("array<struct<type: string, text: string>>")), lambda c: F.coalesce(c["text"], F.lit("")).contains("<environment_context>")))
    last = F.col("last")
    tokens = F.when(last.isNotNull(), F.struct(last["input"].alias("input"), last["output"].alias("output"), last["reasoning"].alias("reasoning"), last["cache_read"].alias("cache_read"), F.lit(None).cast("bigint").alias("cache_write"), F.lit(None).cast("double").alias("cost")))
    return entry_rows(rows.where(parts.isNotNull() & ~setting & F.when(kind == "event_msg.token_count", last.isNotNull()).otherwise((F.size(parts) > 0) & ~F.exists(parts, lambda x: (x["type"] != "tool_call") & x["text"].isNull() & x["tool_call_id"].isNull()))).select(
        F.lit("codex").alias("provider"), "file_path", F.coalesce("session_id", rollout_session_id(F.col("file_path"))).alias("session_id"), F.col("line_no").alias("seq"), "type", role.alias("role"), "ts", F.lit(False).alias("is_sidechain"), parts.alias("parts"), tokens.alias("tokens"),
    ))
