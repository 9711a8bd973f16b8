"""Arms of a corpus of session trees, from raw lines to the grouped report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_lake.functions.text import bundle_path, first_filled
from transcript_lake.operators import arms, metrics, tree
from transcript_lake.operators.common import stored
from transcript_lake.sources import pi

#: Between a session and a leaf where both make one key; no id holds it.
BETWEEN = "\x1f"


def lift_arms(lines: DataFrame, all_branches: bool = False, config_type: str = arms.CONFIG_TYPE, metric_type: str = arms.METRIC_TYPE) -> tuple[DataFrame, DataFrame]:
    """(arms, warnings) of the active branch of each session, or of all its branches.

    Lines are parsed and sessions rebuilt once, and kept as tables; stamps, metrics, cost, process metrics and warnings join on (session_id, leaf_id)."""
    rows = stored(pi.tree_rows(lines), "arm-rows")
    nodes = tree.tree_nodes(rows)
    found = stored(tree.branches(nodes, all_branches), "arm-branches")
    on_branch = tree.linearised(found, nodes.select("session_id", "id", "type", "custom_type", "data_json", "model", "input", "output", "cache_read", "cache_write_5m", "native_cost"))
    custom = on_branch.where("type = 'custom'")
    stamps, marks = arms.config_stamps(custom, config_type), arms.metric_stamps(custom, metric_type)
    squeezed = tree.compacted(found, rows)
    models = tree.models_on(on_branch)
    warnings = arms.arm_warnings(custom, stamps, models, squeezed, config_type, metric_type)
    process = process_of_branches(found, pi.entries(lines))
    table = arms.arm_table(found, stamps, marks, tree.arm_cost(on_branch), process, squeezed, warnings)
    return table.join(models, arms.KEY, "left").drop("parts"), warnings


def process_of_branches(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Process metrics with (session_id, leaf_id): a branch's entries are counted as one session's."""
    said = found.select("session_id", "leaf_id", F.col("id").alias("uuid"), "pos").join(entries, ["session_id", "uuid"])
    keyed = said.withColumns({"session_id": F.concat_ws(BETWEEN, "session_id", "leaf_id"), "seq": F.col("pos")})
    parts = F.split("session_id", BETWEEN)
    return metrics.process_metrics(keyed).withColumns({"leaf_id": F.get(parts, F.lit(1)), "session_id": F.get(parts, F.lit(0))})


def bundle_reads(found: DataFrame, entries: DataFrame, stamps: DataFrame, cwd: DataFrame) -> DataFrame:
    """Off-bundle reads of each arm: read calls whose path, seen from the session's directory, is not in the stamped bundle. cwd: (session_id, cwd)."""
    said = found.select("session_id", "leaf_id", F.col("id").alias("uuid")).join(entries, ["session_id", "uuid"])
    calls = said.select("session_id", "leaf_id", F.explode("parts").alias("p")).where("p.type = 'tool_call' and lower(p.name) = 'read'").join(cwd, "session_id")
    key = F.concat_ws(BETWEEN, "session_id", "leaf_id").alias("session_id")
    reads = calls.select(key, bundle_path(first_filled(F.col("p.input"), ["path", "file_path"]), F.col("cwd")).alias("path"))
    listed = stamps.join(cwd, "session_id", "left").select(key, F.transform("bundle_files", lambda f: bundle_path(f, F.col("cwd"))).alias("manifest"))
    parts = F.split("session_id", BETWEEN)
    return metrics.off_bundle_reads(reads, listed).select(F.get(parts, F.lit(0)).alias("session_id"), F.get(parts, F.lit(1)).alias("leaf_id"), "off_bundle_reads")
