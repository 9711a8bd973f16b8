"""Outlines of sessions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transcript_lake.functions.text import first_line, prose_summary, result_status, tool_summary
from transcript_lake.operators.messages import with_results


def outline(entries: DataFrame) -> DataFrame:
    """Rows (session_id, seq, sub_seq, level, kind, title, status). A user entry is a prompt, or a notice if it was injected. An agent's
    entry has its prose (assistant), headings below that, then tools and reasoning. A tool's status is that of its result, found
    by call id in this or a later entry; entries that only bring results of known calls have no row."""
    each = entries.select("session_id", "seq", F.posexplode("parts").alias("k", "p"))
    calls = each.where("p.type = 'tool_call'").select("session_id", "seq", "k", F.col("p.tool_call_id").alias("call_id"), F.col("p.name").alias("name"), F.col("p.input").alias("input"), F.col("p.status").alias("own"), F.col("p.title").alias("own_title"), F.col("p.output").alias("own_output"))
    results = each.where("p.type = 'tool_result'").select("session_id", "seq", F.col("p.tool_call_id").alias("call_id"), F.col("p.output").alias("output"), F.coalesce("p.is_error", F.lit(False)).alias("is_error"))
    known = results.join(calls.select("session_id", "call_id", F.col("seq").alias("_call")), ["session_id", "call_id"]).where("seq >= _call").select("session_id", "seq").distinct()
    only = entries.where((F.size("parts") > 0) & F.forall("parts", lambda p: p["type"] == "tool_result")).select("session_id", "seq").join(known, ["session_id", "seq"])
    kept = entries.join(only, ["session_id", "seq"], "left_anti")
    texts = F.transform(F.filter("parts", lambda p: (p["type"] == "text") & (F.trim(F.coalesce(p["text"], F.lit(""))) != "")), lambda p: p["text"])
    said = kept.withColumn("text", F.trim(F.array_join(texts, "\n")))
    row = lambda df, sub, level, kind, title, status=None: df.select("session_id", "seq", sub.cast("long").alias("sub_seq"), level.cast("int").alias("level"), kind.alias("kind"), title.alias("title"), (F.lit(None) if status is None else status).cast("string").alias("status"))
    prompts = row(said.where("role = 'user'"), F.lit(0), F.lit(1), F.when(F.coalesce("custom_type", F.lit("")) != "", "notice").otherwise("prompt"), F.coalesce(F.nullif(first_line(F.col("text")), F.lit("")), F.lit("User prompt")))
    agent = said.where("role <> 'user'").withColumn("marks", F.regexp_extract_all(F.concat(F.lit("\n"), F.regexp_replace("text", r"(?s)```.*?(```|\z)", "")), F.lit(r"\n(#{1,6} +[^\n]+)"), F.lit(1)))
    agent = agent.withColumn("root", prose_summary(F.col("text"), F.transform("marks", lambda m: F.regexp_replace(m, "^#+ +", ""))))
    roots = row(agent.where("root is not null"), F.lit(0), F.lit(1), F.lit("assistant"), F.col("root"))
    lines = agent.select("session_id", "seq", F.col("root").isNotNull().alias("rooted"), F.posexplode("marks").alias("k", "mark"))
    headings = row(lines, F.col("k") + 1, F.when(F.col("rooted"), F.length(F.regexp_extract("mark", "^(#+)", 1)) + 1).otherwise(1), F.lit("heading"), F.regexp_replace("mark", "^#+ +", ""))
    agents = agent.select("session_id", "seq")
    done = with_results(calls, results, later_only=True).join(agents, ["session_id", "seq"], "left_semi")
    tools = row(done, F.lit(1_000_000) + F.col("k"), F.lit(1), F.lit("tool"), tool_summary(F.col("name"), F.col("input"), F.col("own_title")), result_status(F.col("own"), F.col("has_result"), F.coalesce("is_error", F.lit(False)), F.col("own_output")))
    thoughts = each.where("p.type = 'reasoning' and trim(coalesce(p.text, '')) <> ''").join(agents, ["session_id", "seq"], "left_semi")
    reasoning = row(thoughts, F.lit(2_000_000) + F.col("k"), F.lit(1), F.lit("reasoning"), first_line(F.col("p.text")))
    return prompts.unionByName(roots).unionByName(headings).unionByName(tools).unionByName(reasoning)


def with_folds(items: DataFrame) -> DataFrame:
    """Outline rows with has_kids and descendants, the run of deeper rows that follows. level is never null.
    One walk over a session's rows from their end, with the rows not yet passed by a row as high on a stack."""

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("seq", "ascending"), ("sub_seq", "ascending")])
        levels = rows.column("level").to_pylist()
        runs, stack = [0] * len(levels), []
        for i in range(len(levels) - 1, -1, -1):
            while stack and levels[stack[-1]] > levels[i]:
                stack.pop()
            runs[i] = (stack[-1] if stack else len(levels)) - i - 1
            stack.append(i)
        return rows.append_column("has_kids", pa.array([n > 0 for n in runs], pa.bool_())).append_column("descendants", pa.array(runs, pa.int64()))

    schema = T.StructType([*items.schema.fields, T.StructField("has_kids", T.BooleanType()), T.StructField("descendants", T.LongType())])
    return items.groupBy("session_id").applyInArrow(fold, schema)


def activity_label(entries: DataFrame) -> DataFrame:
    """entries with activity: what their last part shows is going on."""
    last = F.element_at(F.concat(F.array(F.lit(None).cast(dict(entries.dtypes)["parts"][6:-1])), F.col("parts")), -1)
    named = F.coalesce(last["name"], F.lit("")) != ""
    label = (
        F.when(last["type"] == "tool_call", F.when(named, F.concat(F.lit("tool: "), last["name"])).otherwise("calling tool")).when(last["type"] == "tool_result", "processing tool result").when(last["type"] == "reasoning", "thinking")
        .when(last["type"].isNull(), "").when(F.col("role") == "assistant", "responding").otherwise("reading input")
    )
    return entries.withColumn("activity", label)
