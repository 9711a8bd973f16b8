"""Flat text messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "seq"]


def messages(entries: DataFrame) -> DataFrame:
    """The text parts of each entry, joined by newlines; entries without text go. role defaults to the type, the id to type_uuid."""
    texts = F.transform(F.filter("parts", lambda p: (p["type"] == "text") & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: p["text"])
    rows = entries.withColumn("content", F.array_join(texts, "\n")).where("content <> ''")
    return rows.withColumns({
        "role": F.coalesce(F.nullif("role", F.lit("")), F.col("type")),
        "message_id": F.coalesce(F.nullif("message_id", F.lit("")), F.concat_ws("_", "type", "uuid")),
    })


def with_role(rows: DataFrame, role: str | None = None, contains: str | None = None) -> DataFrame:
    out = rows if role is None else rows.where(F.col("role") == role)
    return out if contains is None else out.where(F.col("content").contains(contains))


def tail(rows: DataFrame, n: int = 10, key: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """The last n rows of each session, in order."""
    order = order or ORDER
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")


def message_stats(rows: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("role") == "user").alias("user"), F.count_if(F.col("role") == "assistant").alias("assistant"))


def summary_due(rows: DataFrame, every: int, key: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """The rows at which a session has had `every` more messages than at the summary before."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ORDER)))
    return rows.withColumn("nth", nth).where(F.col("nth") % every == 0)


def budget_window(rows: DataFrame, last: int, max_tokens: int, key: str = "session_id", order: list[str] | None = None, text: str = "content") -> DataFrame:
    """The last messages of a session, from the first of them until their length would pass three characters a token."""
    order = order or ORDER
    used = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tail(rows, last, key, order).withColumn("used", used).where(F.col("used") <= 3 * max_tokens)


def line_range(rows: DataFrame, start: int, end: int = -1, column: str = "line_no") -> DataFrame:
    """Rows from start on, before end; end -1: to the last."""
    out = rows.where(F.col(column) >= start)
    return out if end < 0 else out.where(F.col(column) < end)


def job_slices(jobs: DataFrame, key: str = "session_id", line: str = "line_index") -> DataFrame:
    """Each job's lines: from its own to that of the next job (null: to the end)."""
    return jobs.withColumn("end_line", F.lead(line).over(Window.partitionBy(key).orderBy(line)))


def job_lines(rows: DataFrame, jobs: DataFrame, key: str = "session_id") -> DataFrame:
    """The rows of each job's slice."""
    cut = job_slices(jobs, key)
    return rows.join(cut, key).where((F.col("line_no") >= F.col("line_index")) & (F.col("end_line").isNull() | (F.col("line_no") < F.col("end_line"))))


def in_flight_tool(calls: DataFrame, results: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session, the latest call that no later row answers. calls: key, seq, call_id, name; results: key, seq, call_id."""
    answered = results.select(key, "call_id", F.col("seq").alias("_result"))
    open_ = calls.join(answered, (calls[key] == answered[key]) & (calls["call_id"] == answered["call_id"]) & (answered["_result"] > calls["seq"]), "left_anti")
    return open_.groupBy(key).agg(F.max_by("name", "seq").alias("in_flight_tool"), F.max("seq").alias("seq"))


def with_results(calls: DataFrame, results: DataFrame, key: str = "session_id", later_only: bool = False) -> DataFrame:
    """calls with the output and is_error of their first result (after the call, if later_only). A result is found by call id within the session."""
    found = results.select(key, "call_id", F.col("seq").alias("_result"), "output", "is_error")
    both = calls.join(found, [key, "call_id"], "left")
    if later_only:
        keep = F.col("_result").isNull() | (F.col("_result") >= F.col("seq"))
        both = both.withColumns({c: F.when(keep, F.col(c)) for c in ("output", "is_error", "_result")})
    first = Window.partitionBy(key, "seq", "call_id").orderBy(F.asc_nulls_last("_result"))
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("has_result", F.col("_result").isNotNull()).drop("_n", "_result")
