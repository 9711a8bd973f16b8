"""Roll-ups of usage entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcript_lake.functions.text import agent_label, rfc3339_millis
from transcript_lake.functions.usage import CLASSES, context_tokens, total_tokens, zero

SESSION = ["provider", "project", "session_id"]
PROVIDERS = ("claude", "codex", "opencode", "pi")


def since(entries: DataFrame, moment) -> DataFrame:
    """Rows at or after moment, and rows without a time. Goes before dedup."""
    return entries.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(moment)))


def only_providers(entries: DataFrame, providers: Sequence[str] = ()) -> DataFrame:
    """Rows of the given providers; of all, if none is given. An unknown name is an error."""
    unknown = set(providers) - set(PROVIDERS)
    if unknown:
        raise ValueError(f"unknown providers: {', '.join(sorted(unknown))}")
    return entries.where(F.col("provider").isin(*providers)) if providers else entries


def sums() -> list[Column]:
    return [*[F.sum(zero(c)).alias(c) for c in CLASSES], F.sum(total_tokens()).alias("total_tokens"), F.count("*").alias("messages")]


def costs(entries: DataFrame) -> list[Column]:
    if "cost" not in entries.columns:
        return []
    return [F.sum("cost").alias("cost"), F.coalesce(F.bool_or(F.col("missing_model").isNotNull()), F.lit(False)).alias("missing_pricing")]


def session_usage(entries: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Per session: sums, cost, messages, peak context, first and last activity, sorted models. Sessions without tokens go unless kept."""
    out = entries.groupBy(*SESSION).agg(
        *sums(), *costs(entries), F.max(context_tokens()).alias("peak_context"), F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"),
        F.array_sort(F.collect_set(F.nullif("model", F.lit("")))).alias("models"),
    )
    return out if keep_empty else out.where("total_tokens > 0")


def by_activity(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy("last_activity", *SESSION)


def model_usage(entries: DataFrame) -> DataFrame:
    """Per session and model, of rows that name one."""
    return entries.where(F.coalesce("model", F.lit("")) != "").groupBy(*SESSION, "model").agg(*sums(), *costs(entries))


def agent_usage(entries: DataFrame) -> DataFrame:
    """Per session and agent; an agent's model is the one seen first. Needs agent_id, or file_path to tell it from."""
    rows = entries if "agent_id" in entries.columns else entries.withColumn("agent_id", agent_label(F.col("file_path")))
    rows = rows.where("agent_id is not null")
    return rows.groupBy(*SESSION, "agent_id").agg(*sums(), *costs(rows), F.min_by("model", "arrival").alias("model"))


def usage_totals(entries: DataFrame) -> DataFrame:
    """One row over all entries, sessions without tokens included."""
    return entries.agg(*sums(), *costs(entries))


def usage_with_total(entries: DataFrame) -> DataFrame:
    """Sessions and the grand total in one pass; the total's keys are null and is_total is true."""
    rows = entries.groupingSets([[F.col(c) for c in SESSION], []], *SESSION).agg(*sums(), *costs(entries), F.grouping_id().alias("_g"))
    return rows.withColumn("is_total", F.col("_g") > 0).where("is_total or total_tokens > 0").drop("_g")


def token_stats(entries: DataFrame, key: str = "file_path", order: str = "line_no") -> DataFrame:
    """Per file, without dedup: sums, and the last row's context, cache read and output."""
    last = lambda c: F.max_by(c, order)
    return entries.groupBy(key).agg(
        F.count("*").alias("messages"), F.sum(context_tokens()).alias("input_tokens"), F.sum(zero("output")).alias("output_tokens"),
        last(context_tokens()).alias("latest_context"), last(zero("cache_read")).alias("latest_cache_read"), last(zero("output")).alias("latest_output"),
    )


def cumulative_stats(counts: DataFrame, key: str = "file_path", order: str = "line_no") -> DataFrame:
    """Per file of cumulative counts: the last total and the last turn's own figures. counts: structs total and last, context_window."""
    return counts.groupBy(key).agg(F.count("*").alias("messages"), F.max_by("total", order).alias("total"), F.max_by("last", order).alias("latest"), F.max_by("context_window", order).alias("context_window"))


def transcript_totals(entries: DataFrame) -> DataFrame:
    """Per file, sums of its responses, replays taken out within the file only."""
    from transcript_lake.operators.dedup import dedup

    own = F.when(F.coalesce("message_id", F.lit("")) == "", F.lit("")).otherwise(F.concat_ws("\x1f", "file_path", "message_id"))
    return dedup(entries.withColumn("message_id", own)).groupBy("file_path").agg(*sums())


def by_inner_session(entries: DataFrame, inner: DataFrame) -> DataFrame:
    """entries under the session that their file names inside (catalog.inner_session_ids), so that agents' and workflows' files
    count with their parent; the project is then the parent file's, the one whose name is the session."""
    named = entries.join(inner, "file_path", "left").withColumn("session_id", F.coalesce("parent_session_id", "session_id")).drop("parent_session_id")
    parents = named.where(F.col("file_path").endswith(F.concat(F.lit("/"), F.col("session_id"), F.lit(".jsonl")))).groupBy("session_id").agg(F.min("project").alias("_project"))
    return named.join(parents, "session_id", "left").withColumn("project", F.coalesce("_project", "project")).drop("_project")


def by_cost(models: DataFrame) -> DataFrame:
    return models.orderBy(F.desc("cost"), "model")


def first_provider_with_usage(sessions: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """Of a session id's rows in several providers, those of the first provider that has billable usage; claude comes first."""
    from pyspark.sql import Window

    ranks = ranks or {p: i for i, p in enumerate(PROVIDERS)}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("provider"))
    rows = sessions.where("total_tokens > 0").withColumn("_rank", rank)
    return rows.withColumn("_best", F.min("_rank").over(Window.partitionBy("session_id"))).where("_rank = _best").drop("_rank", "_best")


def report(sessions: DataFrame, models: DataFrame) -> DataFrame:
    """Sessions in the fixed document shape of the report: camelCase names, breakdown by model name, empty lists instead of nulls."""
    figures = lambda: [F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"), (F.col("cache_write_5m") + F.col("cache_write_1h")).alias("cacheCreationTokens"), F.col("cache_read").alias("cacheReadTokens")]
    nested = models.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct(F.col("model").alias("modelName"), *figures(), F.col("cost")))).alias("modelBreakdowns"))
    rows = sessions.join(nested, SESSION, "left")
    empty = F.array().cast(nested.schema["modelBreakdowns"].dataType)
    return rows.select(
        F.col("session_id").alias("sessionId"), F.col("project").alias("projectPath"), *figures(), F.col("total_tokens").alias("totalTokens"), F.col("cost").alias("totalCost"),
        rfc3339_millis(F.col("last_activity")).alias("lastActivity"), F.coalesce("models", F.array().cast("array<string>")).alias("modelsUsed"), F.coalesce("modelBreakdowns", empty).alias("modelBreakdowns"),
    )
