"""Branching sessions: forests of entries with a parent each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.operators import paths
from transcript_lake.operators.common import stored


def tree_nodes(rows: DataFrame) -> DataFrame:
    """From (session_id, seq, type, id, parent_id, …): the entries, without the header and rows without an id; of rows with one
    id, the last, which keeps its place in the file's order."""
    latest = Window.partitionBy("session_id", "id").orderBy(F.desc("seq"))
    named = rows.where("coalesce(cast(id as string), '') <> ''")
    if "type" in rows.columns:
        named = named.where("type is null or type <> 'session'")
    return named.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def with_roots(nodes: DataFrame) -> DataFrame:
    """nodes with is_root: no parent, or one that is not there (is_orphan)."""
    parents = nodes.select("session_id", F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    out = nodes.join(parents, ["session_id", "parent_id"], "left")
    named = F.coalesce(F.col("parent_id").cast("string"), F.lit("")) != ""
    return out.withColumns({"is_root": F.col("_there").isNull(), "is_orphan": named & F.col("_there").isNull()}).drop("_there")


def leaves(nodes: DataFrame) -> DataFrame:
    """Entries without children."""
    return nodes.join(nodes.select("session_id", F.col("parent_id").alias("id")).where("id is not null").distinct(), ["session_id", "id"], "left_anti")


def branches(nodes: DataFrame, all_branches: bool = True) -> DataFrame:
    """(session_id, leaf_id, is_active, pos, id): each branch from its root to its leaf. The active branch ends at the last row
    of the file, leaf or not; a walk stops where it meets an entry again. Paths come from chains (operators.paths), whose
    segments say the same in a row for each fork; only sessions whose entries are each other's ancestors are walked whole."""
    placed, turning = paths.chains(nodes)
    runs, forked = paths.segments(placed, all_branches)
    found = paths.along(runs, placed)
    circles = [x for x in (turning, forked) if x is not None]
    if not circles:
        return found
    astray = stored(circles[0].union(circles[-1]).distinct(), "tree-circles")
    return found.join(astray, "session_id", "left_anti").unionByName(walked(nodes.join(astray, "session_id", "left_semi"), all_branches))


def walked(nodes: DataFrame, all_branches: bool = True) -> DataFrame:
    """branches by a walk up from each leaf, for logs that are broken so that entries are each other's ancestors; a session in a task."""
    id_type = dict(nodes.dtypes)["id"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        ids = pdf["id"].tolist()
        parent = {i: (None if pd.isna(p) else p) for i, p in zip(ids, pdf["parent_id"], strict=True)}
        inner = {p for p in parent.values() if p is not None}
        ends = [i for i in ids if i not in inner] if all_branches else []
        if ids[-1] not in ends:
            ends.append(ids[-1])
        out = []
        for end in ends:
            path, seen, at = [], set(), end
            while at is not None and at in parent and at not in seen:
                seen.add(at)
                path.append(at)
                at = parent[at]
            out += [(end, end == ids[-1], k, i) for k, i in enumerate(reversed(path))]
        frame = pd.DataFrame(out, columns=["leaf_id", "is_active", "pos", "id"])
        frame.insert(0, "session_id", pdf["session_id"].iloc[0])
        return frame

    schema = f"session_id {dict(nodes.dtypes)['session_id']}, leaf_id {id_type}, is_active boolean, pos long, id {id_type}"
    return nodes.select("session_id", "seq", "id", "parent_id").groupBy("session_id").applyInPandas(walk, schema)


def forks(branch_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per branch, the deepest entry on it that has several children."""
    children = nodes.where("parent_id is not null").groupBy("session_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("children")).where("children > 1")
    return branch_nodes.join(children, ["session_id", "id"]).groupBy("session_id", "leaf_id").agg(F.max_by("id", "pos").alias("fork_id"))


def arms_below(branch_nodes: DataFrame, fork: DataFrame) -> DataFrame:
    """The parts of branches after the fork of their session; fork: (session_id, fork_id)."""
    at = branch_nodes.join(fork, "session_id").where("id = fork_id").select("session_id", "leaf_id", F.col("pos").alias("_at"))
    return branch_nodes.join(at, ["session_id", "leaf_id"]).where("pos > _at").drop("_at")


def linearised(branch_nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of each branch, in order of pos."""
    return branch_nodes.join(entries, ["session_id", "id"])


def models_on(branch_entries: DataFrame) -> DataFrame:
    """Per branch, its models in the order in which they appear."""
    firsts = branch_entries.where("coalesce(model, '') <> ''").groupBy("session_id", "leaf_id", "model").agg(F.min("pos").alias("pos"))
    return firsts.groupBy("session_id", "leaf_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "model"))), lambda x: x["model"]).alias("models"))


def arm_cost(branch_entries: DataFrame) -> DataFrame:
    """Tokens and the log's own cost, over one branch only."""
    from transcript_lake.functions.usage import CLASSES, zero

    found = [c for c in CLASSES if c in branch_entries.columns]
    cost = [F.sum("native_cost").alias("cost")] if "native_cost" in branch_entries.columns else []
    return branch_entries.groupBy("session_id", "leaf_id").agg(*[F.sum(zero(c)).alias(c) for c in found], *cost)


def custom_entries(branch_nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of type custom on each branch."""
    return linearised(branch_nodes, rows.where("type = 'custom'"))


def compacted(branch_nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Per branch, whether the conversation was compacted on it."""
    return linearised(branch_nodes, rows.select("session_id", "id", "type")).groupBy("session_id", "leaf_id").agg(F.bool_or(F.col("type") == "compaction").alias("compacted"))
