"""Paths of session trees without a session in one task.

Every entry goes on in its last child; entries that go on in each other make a chain, which ends at a leaf. So there are as many
chains as leaves, and a branch is its own chain and the beginnings of a few others, up to the entries where it forks off: a few
ranges instead of every entry again for every leaf. Chains are found by pointer doubling: each round joins an entry with the one
it points to, and it points twice as far after, so a path of a million entries takes twenty joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.operators.common import stored

KEY = ["session_id", "id"]


def _linked(nodes: DataFrame) -> DataFrame:
    """(session_id, id, seq, parent_id, next): the parent, null where it is not there, and the last child."""
    slim = nodes.select("session_id", "id", "seq", "parent_id")
    there = slim.select("session_id", F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    known = slim.join(there, ["session_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("_there"), F.col("parent_id"))).drop("_there")
    last = slim.where("parent_id is not null").groupBy("session_id", F.col("parent_id").alias("id")).agg(F.max_by("id", "seq").alias("next"))
    return known.join(last, KEY, "left")


def chains(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(session_id, id, seq, chain, k, up, upk): each entry with the leaf that ends its chain and its place in the chain from 0;
    up and upk are the chain and place of the entry that the chain forks off, null for a chain that begins at a root. And the
    sessions in which entries are each other's ancestors, or None if there are none; these entries are not in the first table."""
    links = stored(_linked(nodes), "tree-links")
    at = links.select("session_id", "id", F.coalesce("next", "id").alias("to"), F.col("next").isNotNull().cast("long").alias("far"), F.col("next").isNull().alias("done"))
    left, before = links.where("next is not null").count(), None
    while left and left != before:  # as many as before: what is left runs in circles
        to = at.select("session_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        moved = at.where("not done").join(to, ["session_id", "to"]).select("session_id", "id", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done"))
        at = stored(at.where("done").unionByName(moved), "tree-pointers")
        before, left = left, at.where("not done").count()
    turning = at.where("not done").select("session_id").distinct() if left else None
    rows = links.join(at.where("done").select("session_id", "id", F.col("to").alias("chain"), "far"), KEY)
    long = rows.groupBy("session_id", "chain").agg(F.max("far").alias("last"), F.max_by("parent_id", "far").alias("_fork"))
    placed = rows.join(long, ["session_id", "chain"]).withColumn("k", F.col("last") - F.col("far"))
    fork = placed.select("session_id", F.col("id").alias("_fork"), F.col("chain").alias("up"), F.col("k").alias("upk"))
    out = stored(placed.join(fork, ["session_id", "_fork"], "left").select("session_id", "id", "seq", "chain", "k", "up", "upk"), "tree-chains")
    return out, turning


def segments(placed: DataFrame, all_branches: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """From chains: (session_id, leaf_id, is_active, chain, upto, base), a row for each chain that a branch runs along: its
    entries from place 0 to upto, the first of which is at base on the branch. The active branch ends at the last row of the
    file, leaf or not. And the sessions in which chains fork off each other, or None."""
    newest = placed.groupBy("session_id").agg(F.max_by("id", "seq").alias("_last"))
    ends = placed.join(newest, "session_id").where((F.col("id") == F.col("_last")) | ((F.col("id") == F.col("chain")) & F.lit(all_branches)))
    step = ends.select("session_id", F.col("id").alias("leaf_id"), (F.col("id") == F.col("_last")).alias("is_active"), "chain", F.col("k").alias("upto"), F.lit(0).alias("level"), "up", "upk")
    forks = placed.select("session_id", "chain", "up", "upk").distinct()
    step = stored(step, "tree-segments")
    found, level, before, left = [step], 0, None, step.where("up is not null").count()
    while left and left != before:
        level += 1
        above = forks.select("session_id", F.col("chain").alias("up"), F.col("up").alias("_up"), F.col("upk").alias("_upk"))
        step = stored(step.where("up is not null").join(above, ["session_id", "up"]).select("session_id", "leaf_id", "is_active", F.col("up").alias("chain"), F.col("upk").alias("upto"), F.lit(level).alias("level"), F.col("_up").alias("up"), F.col("_upk").alias("upk")), "tree-segments")
        found.append(step)
        before, left = left, step.where("up is not null").count()
    turning = step.where("up is not null").select("session_id").distinct() if left else None
    all_ = found[0]
    for x in found[1:]:
        all_ = all_.unionByName(x)
    above = Window.partitionBy("session_id", "leaf_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("upto") + 1).over(above), F.lit(0))
    return all_.withColumn("base", base).select("session_id", "leaf_id", "is_active", "chain", "upto", "base"), turning


def along(runs: DataFrame, placed: DataFrame) -> DataFrame:
    """(session_id, leaf_id, is_active, pos, id): the entries of each branch."""
    rows = placed.select("session_id", "chain", "k", "id")
    return runs.join(rows, ["session_id", "chain"]).where("k <= upto").select("session_id", "leaf_id", "is_active", (F.col("base") + F.col("k")).alias("pos"), "id")


def sums_along(runs: DataFrame, placed: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(session_id, leaf_id, is_active, columns): sums over each branch, from prefix sums along chains, so an entry that a
    thousand branches share is added once. values: (session_id, id, columns); null counts as 0."""
    so_far = Window.partitionBy("session_id", "chain").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = placed.join(values.select(*KEY, *columns), KEY, "left").select("session_id", "chain", F.col("k").alias("upto"), *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in columns])
    return runs.join(known, ["session_id", "chain", "upto"]).groupBy("session_id", "leaf_id", "is_active").agg(*[F.sum(c).alias(c) for c in columns])


def latest_along(runs: DataFrame, placed: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """(session_id, leaf_id, is_active, pos, column): the value of the last marked entry on each branch, if it has one: of each
    chain the last mark so far, and of a branch's chains the deepest that has one. marks: (session_id, id, column not null)."""
    so_far = Window.partitionBy("session_id", "chain").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = placed.join(marks.select(*KEY, F.col(column).alias("_value")), KEY, "left")
    known = seen.select("session_id", "chain", F.col("k").alias("upto"), F.last(F.when(F.col("_value").isNotNull(), F.struct("k", "_value")), ignorenulls=True).over(so_far).alias("_m"))
    found = runs.join(known, ["session_id", "chain", "upto"]).where("_m is not null")
    best = F.max_by(F.struct((F.col("base") + F.col("_m.k")).alias("pos"), F.col("_m._value").alias(column)), "base")
    return found.groupBy("session_id", "leaf_id", "is_active").agg(best.alias("_b")).select("session_id", "leaf_id", "is_active", "_b.*")
