"""String, path and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
METRIC_KEY = r"^[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*$"


def filled(c: Column) -> Column:
    """null for an empty string."""
    return F.nullif(c, F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def session_parts(path: Column) -> Column:
    """struct(session_id, project) of a log's path, by what is below the first projects folder (all of it, if there is none):
    project/file.jsonl; …/session/subagents/file; else the folder that holds the file is the session and those above are the project."""
    rest = F.split(F.regexp_replace(path, "^.*?/projects/", ""), "/")
    n, name = F.size(rest), F.regexp_replace(F.element_at(rest, -1), r"\.jsonl$", "")
    upto = lambda k: F.coalesce(filled(F.array_join(F.slice(rest, 1, F.greatest(n - k, F.lit(0))), "/")), F.lit("Unknown Project"))
    plain, below = (n == 2) & F.element_at(rest, -1).endswith(".jsonl"), (n >= 4) & (F.get(rest, n - 2) == "subagents")
    session = F.when(plain, name).when(below, F.get(rest, n - 3)).when(n >= 2, F.get(rest, n - 2)).otherwise("unknown")
    project = F.when(plain, F.get(rest, F.lit(0))).when(below, upto(3)).otherwise(upto(2))
    return F.struct(session.alias("session_id"), project.alias("project"))


def agent_id(path: Column) -> Column:
    return filled(F.regexp_extract(base_name(path), r"^agent-(.*)\.jsonl$", 1))


def project_slug(path: Column) -> Column:
    return filled(F.regexp_extract(path, "/projects/([^/]+)/", 1))


def uuid_in_name(path: Column) -> Column:
    return filled(F.regexp_extract(base_name(path), f"({UUID})", 1))


def agent_label(path: Column) -> Column:
    """An agent's id from its file's name; the session's own transcript is its parent."""
    return F.coalesce(agent_id(path), F.lit("parent"))


def rollout_session_id(path: Column) -> Column:
    """The id at the end of a rollout's name, or the name."""
    name = F.regexp_replace(base_name(path), r"\.jsonl$", "")
    return F.coalesce(filled(F.regexp_extract(name, f"({UUID})$", 1)), name)


def tree_session_id(path: Column) -> Column:
    """The part of the file's name after the first underscore; without one, the name."""
    name = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    return F.when(name.contains("_"), F.regexp_replace(name, "^[^_]*_", "")).otherwise(name)


def folder_for_tree(cwd: Column) -> Column:
    """A working directory as the folder name of tree logs: slashes and colons become hyphens, between double hyphens."""
    return F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(cwd, r"^[/\\]", ""), r"[/\\:]", "-"), F.lit("--"))


def folder_for_chat(cwd: Column) -> Column:
    """A working directory as the folder name of chat logs: slashes become hyphens, and a dot after one too."""
    return F.replace(F.replace(cwd, F.lit("/"), F.lit("-")), F.lit("-."), F.lit("--"))


def provider_of(path: Column) -> Column:
    """The runtime that wrote a log, from its path; claude where nothing tells. Jobs keep pi's sessions with their artifacts."""
    has = path.contains
    return (
        F.when(has("/.codex/") | has("/codex/sessions/"), "codex")
        .when(has("/opencode/storage/"), "opencode")
        .when(has("/.pi/") | has("/pi/agent/sessions/") | (has("/.artifacts/") & has("/sessions/")), "pi")
        .otherwise("claude")
    )


def plan_job(text: Column) -> Column:
    """struct(plan, job) named by a message that tells an agent to read and execute a job file: the first path in it, up to " and"."""
    told = text.contains("Read the file") & text.contains("and execute the agent job")
    path = F.coalesce(filled(F.regexp_extract(text, r"(?s)^[^/]*(/.*?) and", 1)), F.regexp_extract(text, r"(?s)^[^/]*(/[^ ]*) ", 1))
    parts = F.split(path, "/")
    return F.when(told & path.contains("/plans/") & path.endswith(".md"), F.struct(F.element_at(parts, -2).alias("plan"), F.element_at(parts, -1).alias("job")))


def briefing(text: Column) -> Column:
    """struct(plan_dir, plan, job_id) of the first briefing file that a message names."""
    pattern = r"(/[^'\"\s]+/plans/[^/]+)/\.artifacts/([^/]+)/briefing-\d+\.xml"
    folder = F.regexp_extract(text, pattern, 1)
    return F.when(folder != "", F.struct(folder.alias("plan_dir"), base_name(folder).alias("plan"), F.regexp_extract(text, pattern, 2).alias("job_id")))


def rfc3339_millis(ts: Column) -> Column:
    """In UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def lines(text: Column) -> Column:
    """The lines of a text: none of an empty one; one newline at the end ends the last line."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def line_churn(old: Column, new: Column) -> Column:
    """struct(added, removed): lines left on either side when equal lines at the start, then at the end, are taken off."""

    def common(a: Column, b: Column, limit: Column) -> Column:
        """How many leading pairs are equal, limit at most; counting stops with the first that differ."""
        pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        at = F.array_position(pairs, False)
        return F.least(F.when(at > 0, at - 1).otherwise(F.size(pairs)), limit).cast("int")

    def given(a: Column, b: Column) -> Column:
        shorter = F.least(F.size(a), F.size(b))
        front = common(a, b, shorter)
        back = common(F.reverse(a), F.reverse(b), shorter - front)
        return F.struct((F.size(b) - front - back).cast("long").alias("added"), (F.size(a) - front - back).cast("long").alias("removed"))

    both = F.array(F.struct(lines(old).alias("a"), lines(new).alias("b")))
    return F.element_at(F.transform(both, lambda x: given(x["a"], x["b"])), 1)


def edits_churn(edits: Column) -> Column:
    """Churn of an array of struct(old, new), summed."""
    each = F.transform(edits, lambda e: line_churn(e["old"], e["new"]))
    zero = F.struct(F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("removed"))
    return F.aggregate(each, zero, lambda acc, x: F.struct((acc["added"] + x["added"]).alias("added"), (acc["removed"] + x["removed"]).alias("removed")))


def first_filled(variant: Column, keys: list[str]) -> Column:
    """The first non-empty string among an input's spellings of a key."""
    return F.coalesce(*[filled(F.try_variant_get(variant, f"$.{k}", "string")) for k in keys])


def clean_path(path: Column) -> Column:
    """Slashes doubled, `.` and `x/..` taken out, as a path library does."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def bundle_path(path: Column, cwd: Column) -> Column:
    """A path below cwd relative to it, cleaned."""
    clean, root = clean_path(path), clean_path(cwd)
    return F.when(clean.startswith(F.concat(root, F.lit("/"))), clean.substr(F.length(root) + 2, F.length(clean))).otherwise(clean)


def same_model(stamped: Column, observed: Column) -> Column:
    """Names are compared without the provider in front."""
    return F.substring_index(stamped, "/", -1) == F.substring_index(observed, "/", -1)


def config_hash(model: Column, provider: Column, commit: Column, components: Column) -> Column:
    """SHA-256 of the configuration as compact JSON in this order, empty fields left out, components by key."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(components)))
    fields = F.struct(filled(model).alias("model"), filled(provider).alias("provider"), filled(commit).alias("worktree_commit"), F.when(F.size(components) > 0, ordered).alias("components"))
    escaped = F.to_json(fields)
    for sign, code in (("<", "\\\\u003c"), (">", "\\\\u003e"), ("&", "\\\\u0026")):
        escaped = F.regexp_replace(escaped, sign, code)
    return F.sha2(escaped, 256)


def good_metrics(metrics: Column) -> Column:
    """The entries whose key is two snake_case words with a dot between."""
    return F.map_filter(metrics, lambda k, v: k.rlike(METRIC_KEY))


def shortened(text: Column, most: int = 80) -> Column:
    """The first line, cut to most characters."""
    line = F.element_at(F.split(text, "\n"), 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def _capped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def short_path(path: Column) -> Column:
    """A path of over 50 characters and more than three parts, cut to its last two."""
    parts = F.split(path, "/")
    return F.when((F.length(path) > 50) & (F.size(parts) > 3), F.concat(F.lit(".../"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1))).otherwise(path)


def tool_summary(name: Column, variant: Column, title: Column | None = None) -> Column:
    """Name(argument): the tool's name with a capital, and its command, path, pattern, query or url, whichever it has first; else its title."""
    given = lambda k: F.try_variant_get(variant, f"$.{k}", "string")
    is_text = lambda k: F.schema_of_variant(F.try_variant_get(variant, f"$.{k}", "variant")) == "STRING"
    words = F.try_variant_get(variant, "$.command", "array<string>")
    shell = F.when((F.size(words) >= 3) & F.get(words, F.lit(1)).isin("-lc", "-c"), F.get(words, F.lit(2))).otherwise(F.array_join(words, " "))
    argument = (
        F.when(is_text("command"), _capped(F.trim(given("command")), 60)).when(F.size(words) > 0, _capped(F.trim(shell), 60)).when(is_text("file_path"), short_path(given("file_path"))).when(is_text("filePath"), short_path(given("filePath")))
        .when(is_text("pattern"), given("pattern")).when(is_text("query"), _capped(given("query"), 40)).when(is_text("url"), given("url"))
    )
    shown = F.coalesce(filled(argument), filled(title if title is not None else F.lit(None).cast("string")))
    whole = F.when(shown.isNull(), _capital(name)).otherwise(F.concat(_capital(name), F.lit("("), shown, F.lit(")")))
    return F.trim(F.regexp_replace(whole, r"\s+", " "))


def _capital(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name)))


def result_status(status: Column, has_result: Column, is_error: Column, output: Column) -> Column:
    """failed, completed or running: by the result, else by the call's own word for it, else by whether there is output."""
    own = F.lower(status)
    return (
        F.when(has_result, F.when(is_error, "failed").otherwise("completed")).when(own.isin("completed", "complete", "success", "succeeded", "done"), "completed").when(own.isin("failed", "error"), "failed")
        .when(own.isin("pending", "running", "in_progress"), "running").when(F.coalesce(output, F.lit("")) != "", "completed").otherwise("running")
    )


def patch_title(files: Column, hash_: Column) -> Column:
    n = F.greatest(F.size(F.coalesce(files, F.array().cast("array<string>"))), F.lit(0))
    count = F.concat(F.lit("("), n.cast("string"), F.when(n == 1, " file)").otherwise(" files)"))
    return F.concat_ws(" ", F.lit("patch"), filled(F.left(hash_, F.lit(8))), count)


def first_line(text: Column) -> Column:
    """The first line that is not blank, without the marks of a heading; null if there is none."""
    return F.regexp_replace(F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), "^[# ]+", "")


# How lines of code begin that are no prose.
CODE = ("package ", "import ", "func ", "return ", "var ", "const ", "type ")


def prose_summary(text: Column, headings: Column) -> Column:
    """The first line of prose outside code fences, else the first of headings; null if there is neither. Prose has a letter or
    digit and begins with no heading mark, slash, or word of code."""
    prose = lambda x: x.rlike(r"[\p{L}\p{Nd}]") & ~x.startswith("#") & ~x.startswith("/") & ~F.lower(x).rlike("^(" + "|".join(CODE) + ")")

    def step(acc: Column, x: Column) -> Column:
        fence = x.startswith("```")
        return F.struct((acc["fence"] != fence).alias("fence"), F.coalesce(acc["found"], F.when(~fence & ~acc["fence"] & prose(x), x)).alias("found"))

    begin = F.struct(F.lit(False).alias("fence"), F.lit(None).cast("string").alias("found"))
    return F.coalesce(F.aggregate(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), begin, step, lambda acc: acc["found"]), F.get(headings, F.lit(0)))
