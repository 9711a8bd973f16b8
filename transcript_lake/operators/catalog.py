"""The catalogue of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.functions.text import base_name, plan_job


def latest_attempts(registry: DataFrame, key: str = "native_id") -> DataFrame:
    """One registry row a session: one with an attempt id first, then the latest start, then the greatest attempt id."""
    best = Window.partitionBy(key).orderBy((F.coalesce("attempt_id", F.lit("")) == "").cast("int"), F.desc_nulls_last("started_at"), F.desc_nulls_last("attempt_id"))
    return registry.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def without_subagents(logs: DataFrame, path: str = "path") -> DataFrame:
    return logs.where(~base_name(F.col(path)).rlike("^agent-"))


def catalogue(logs: DataFrame, registry: DataFrame, archive: DataFrame, others: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Sessions by session_id: a log's row, in which the registry's values win over the archive's and these over the log's own;
    then the registry's sessions without a log, archived ones that are in neither, and others. `origin` tells which."""
    columns = columns or [c for c in logs.columns if c != "session_id"]
    latest = latest_attempts(registry, "session_id")
    named = lambda df, p: df.select("session_id", *[F.col(c).alias(f"{p}{c}") for c in columns if c in df.columns], F.lit(True).alias(f"{p}in"))
    both = logs.join(named(latest, "_r"), "session_id", "left").join(named(archive, "_a"), "session_id", "left")
    pick = lambda c: F.coalesce(*[F.col(f"{p}{c}") for p, df in (("_r", latest), ("_a", archive)) if c in df.columns], F.col(c)).alias(c)
    origin = F.when(F.col("_rin").isNotNull(), "registry").when(F.col("_ain").isNotNull(), "archive").otherwise("log")
    parts = [both.select("session_id", *map(pick, columns), origin.alias("origin"))]
    more = [(latest, "registry only"), (archive, "archive only"), *([(others, "other")] if others is not None else [])]
    seen = logs.select("session_id")
    for df, name in more:
        parts.append(df.join(seen, "session_id", "left_anti").select("session_id", *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns], F.lit(name).alias("origin")))
        seen = seen.union(df.select("session_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(sessions: DataFrame, text: str) -> DataFrame:
    """Sessions whose project, worktree, or any job's plan or name holds the text, whatever its case."""
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return sessions.where(has(F.col("project")) | has(F.col("worktree")) | F.exists(F.coalesce("jobs", F.array().cast("array<struct<plan: string, job: string, line_index: bigint>>")), lambda j: has(j["plan"]) | has(j["job"])))


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc_nulls_last("started_at"), "session_id")


def header_facts(lines: DataFrame, first: int = 100) -> DataFrame:
    """Per file, from its first lines: the first cwd, session id and time, and its jobs (plan, job) at the line where each is first named."""
    head = lines.where(F.col("line_no") < first)
    facts = head.groupBy("file_path").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in ("cwd", "session_id", "ts")])
    named = head.withColumn("_j", plan_job(F.col("text"))).where("_j is not null").groupBy("file_path", "_j").agg(F.min("line_no").alias("line_index"))
    jobs = named.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "_j"))), lambda x: F.struct(x["_j"]["plan"].alias("plan"), x["_j"]["job"].alias("job"), x["line_index"].alias("line_index"))).alias("jobs"))
    return facts.join(jobs, "file_path", "left")


def inner_session_ids(lines: DataFrame, first: int = 50) -> DataFrame:
    """Per file, the first session id in its first lines: a subagent's file names its parent's session."""
    return lines.where((F.col("line_no") < first) & (F.coalesce("session_id", F.lit("")) != "")).groupBy("file_path").agg(F.min_by("session_id", "line_no").alias("parent_session_id"))


def newest_transcript(files: DataFrame, after=None) -> DataFrame:
    """Per provider and working directory, the newest transcript by its first time, or where it has none by the file's, if later than after."""
    when = F.coalesce("first_ts", "modified_at")
    rows = files if after is None else files.where(when > F.lit(after))
    return rows.groupBy("provider", "workdir").agg(F.max_by("file_path", F.struct(when, F.col("file_path"))).alias("file_path"), F.max(when).alias("at"))


def job_files(files: DataFrame) -> DataFrame:
    """(plan_dir, job_id, file_path) from the id in the first 40 lines of job files (file_path, text)."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 41), "\n")
    found = F.regexp_extract(head, r"(?m)^\s*id:\s*[\"']?([^\"'\s]+)", 1)
    return files.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("plan_dir"), found.alias("job_id"), "file_path").where("job_id <> ''")


def resolve(specs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each spec (a path, a session id, plan/job, or a job's file) with its session: by the kind of match in this order, then sessions with a path, then the newest.
    sessions: session_id, path, started_at, jobs."""
    jobs = sessions.select("session_id", F.explode("jobs").alias("j")).select("session_id", F.concat_ws("/", "j.plan", "j.job").alias("spec"), "j.job")
    ways = [sessions.select(F.col("path").alias("spec"), "session_id", F.lit(0).alias("way")), sessions.select(F.col("session_id").alias("spec"), "session_id", F.lit(1).alias("way")), jobs.select("spec", "session_id", F.lit(2).alias("way"))]
    keyed = ways[0].union(ways[1]).union(ways[2])
    direct = specs.select("spec").distinct().join(keyed, "spec")
    tails = specs.select("spec", F.array_join(F.slice(F.split("spec", "/"), -2, 2), "/").alias("tail")).where("spec like '%/%/%'").distinct()
    by_file = tails.join(jobs.select(F.col("spec").alias("tail"), "session_id"), "tail").select("spec", "session_id", F.lit(3).alias("way"))
    best = Window.partitionBy("spec").orderBy("way", F.col("path").isNull().cast("int"), F.desc_nulls_last("started_at"), "session_id")
    return direct.unionByName(by_file).join(sessions, "session_id").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
