"""Process metrics of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.functions.text import edits_churn, first_filled, line_churn

# What each runtime's file tools are called, and how their arguments are spelled.
# provider, tool, kind, path keys, old-text keys, new-text keys, key of a list of edits
RULES = [
    ("claude", "read", "read", ["file_path"], [], [], None),
    ("claude", "grep", "read", ["path"], [], [], None),
    ("claude", "edit", "edit", ["file_path"], ["old_string"], ["new_string"], None),
    ("claude", "write", "edit", ["file_path"], [], [], None),
    ("claude", "multiedit", "edit", ["file_path"], ["old_string"], ["new_string"], "edits"),
    ("claude", "notebookedit", "edit", ["notebook_path", "file_path"], [], [], None),
    ("pi", "read", "read", ["path"], [], [], None),
    ("pi", "grep", "read", ["path"], [], [], None),
    ("pi", "find", "read", ["path"], [], [], None),
    ("pi", "ls", "read", ["path"], [], [], None),
    ("pi", "edit", "edit", ["path"], [], [], None),
    ("pi", "write", "edit", ["path"], [], [], None),
]
RULED = sorted({r[0] for r in RULES})


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "provider string, tool string, kind string, path_keys array<string>, old_keys array<string>, new_keys array<string>, edits_key string")


def tool_calls(entries: DataFrame) -> DataFrame:
    """The tool_call parts of entries off the sidechain."""
    main = entries.where(~F.coalesce("is_sidechain", F.lit(False)))
    return main.select("provider", "session_id", "seq", F.explode("parts").alias("p")).where("p.type = 'tool_call'").select("provider", "session_id", "seq", F.col("p.tool_call_id").alias("call_id"), F.col("p.name").alias("name"), F.col("p.input").alias("input"))


def _edit(old: list[str], new: list[str]):
    return lambda e: F.struct(first_filled(e, old).alias("old"), first_filled(e, new).alias("new"))


def file_touches(calls: DataFrame) -> DataFrame:
    """calls of the file tools with path, kind (read or edit), added and removed lines. Providers without rules have none.

    Rules are in the code, so paths and churn are chosen by expressions: one pass over calls, and nothing is joined."""
    path, kind, churn = [], [], [F.struct(F.lit(None).cast("long").alias("added"), F.lit(None).cast("long").alias("removed"))]
    for provider, tool, kind_, paths, old, new, edits in RULES:
        here = (F.lower("provider") == provider) & (F.lower("name") == tool)
        path.append(F.when(here, first_filled(F.col("input"), paths)))
        kind.append(F.when(here, F.lit(kind_)))
        if old:
            change = line_churn(first_filled(F.col("input"), old), first_filled(F.col("input"), new))
            if edits:
                each = F.try_variant_get("input", f"$.{edits}", "array<variant>")
                change = F.when(F.size(each) > 0, edits_churn(F.transform(each, _edit(old, new)))).otherwise(change)
            churn.insert(0, F.when(here, change))
    rows = calls.withColumns({"path": F.coalesce(*path), "kind": F.coalesce(*kind)}).where("path is not null").withColumn("_churn", F.coalesce(*churn))
    return rows.withColumns({"added": F.coalesce("_churn.added", F.lit(0)), "removed": F.coalesce("_churn.removed", F.lit(0))}).drop("_churn")


def process_metrics(entries: DataFrame) -> DataFrame:
    """Per session: tool_calls, distinct_tools, turns (user entries with text), wall_seconds (null without times), files touched
    and edited with their sorted paths, churn. Sidechains are left out. For providers without file rules the files are null and named in unsupported."""
    main = entries.where(~F.coalesce("is_sidechain", F.lit(False)))
    spoken = F.exists("parts", lambda p: (p["type"] == "text") & (F.trim(F.coalesce(p["text"], F.lit(""))) != ""))
    base = main.groupBy("provider", "session_id").agg(
        F.sum(F.size(F.filter("parts", lambda p: p["type"] == "tool_call"))).alias("tool_calls"),
        F.count_if((F.col("role") == "user") & spoken).alias("turns"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("wall_seconds"),
    )
    calls = tool_calls(entries)
    names = calls.where("coalesce(name, '') <> ''").groupBy("provider", "session_id").agg(F.countDistinct("name").alias("distinct_tools"))
    files = file_touches(calls).groupBy("provider", "session_id").agg(
        F.array_sort(F.collect_set("path")).alias("touched"), F.array_sort(F.collect_set(F.when(F.col("kind") == "edit", F.col("path")))).alias("edited"), F.sum("added").alias("added"), F.sum("removed").alias("removed")
    )
    ruled = F.lower("provider").isin(*RULED)
    none = F.array().cast("array<string>")
    out = base.join(names, ["provider", "session_id"], "left").join(files, ["provider", "session_id"], "left").withColumn("distinct_tools", F.coalesce("distinct_tools", F.lit(0)))
    out = out.withColumns({"touched": F.when(ruled, F.coalesce("touched", none)), "edited": F.when(ruled, F.coalesce("edited", none)), "added": F.when(ruled, F.coalesce("added", F.lit(0))), "removed": F.when(ruled, F.coalesce("removed", F.lit(0)))})
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return out.withColumns({"files_touched": count("touched"), "files_edited": count("edited"), "unsupported": F.when(ruled, none).otherwise(F.array(F.lit("files_touched"), F.lit("files_edited")))})


def off_bundle_reads(reads: DataFrame, manifests: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session of manifests (key, manifest array): how many reads (key, path) are of paths outside it. Without a manifest null; with an empty one, all.
    Paths are compared as they come; bundle_path cleans them."""
    listed = manifests.select(key, F.explode("manifest").alias("path")).distinct()
    outside = reads.join(listed, [key, "path"], "left_anti").groupBy(key).agg(F.count("*").alias("_n"))
    return manifests.join(outside, key, "left").withColumn("off_bundle_reads", F.when(F.col("manifest").isNotNull(), F.coalesce("_n", F.lit(0)).cast("double"))).drop("_n")
