"""Paths by chains against a walk."""

import random

import pytest
from pyspark.sql import functions as F

from transcript_lake.operators import paths, tree

SCHEMA = "session_id string, seq long, type string, id string, parent_id string"


def forest(seed, n):
    """Sessions of random trees, with several roots, missing parents and a last row that is no leaf."""
    rng, out = random.Random(seed), []
    for s in range(5):
        ids = []
        for k in range(n):
            parent = None if not ids or rng.random() < 0.05 else "gone" if rng.random() < 0.05 else rng.choice(ids[-3:] if s % 2 else ids)
            out.append((f"s{s}", k, "message", f"e{k}", parent))
            ids.append(f"e{k}")
        out.append((f"s{s}", n, "message", "e1", out[-n + 1][4] if s == 3 else None)) if s in (3, 4) else None
    return out


@pytest.mark.parametrize("all_branches", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_like_a_walk(spark, seed, all_branches):
    nodes = tree.tree_nodes(spark.createDataFrame(forest(seed, 40), SCHEMA))
    plain = lambda d: sorted(tuple(r) for r in d.collect())
    assert plain(tree.branches(nodes, all_branches)) == plain(tree.walked(nodes, all_branches))


def test_circles(spark):
    """Sessions with circles are walked; a circle that no leaf leads to shows only if it holds the last row."""
    rows = [("a", 0, "m", "x", "y"), ("a", 1, "m", "y", "x"), ("a", 2, "m", "z", "x"), ("a", 3, "m", "z2", "y"), ("b", 0, "m", "r", None), ("b", 1, "m", "q", "r"), ("c", 0, "m", "r", None), ("c", 1, "m", "x", "x")]
    nodes = spark.createDataFrame(rows, SCHEMA)
    for every in (True, False):
        assert sorted(tuple(r) for r in tree.branches(nodes, every).collect()) == sorted(tuple(r) for r in tree.walked(nodes, every).collect())
    assert tree.branches(nodes.limit(0)).count() == 0


def test_deep_trees_are_linear(spark):
    """A trunk of 3,000 entries with a dead end at each: two rows a branch, where paths would have millions."""
    n = 3000
    trunk = spark.range(n).select(F.lit("s").alias("session_id"), (2 * F.col("id") + 1).alias("seq"), F.lit("m").alias("type"), F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("t"), F.col("id") - 1)).alias("parent_id"))
    ends = spark.range(n - 1).select(F.lit("s").alias("session_id"), (2 * F.col("id") + 2).alias("seq"), F.lit("m").alias("type"), F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit("t"), "id").alias("parent_id"))
    nodes = trunk.union(ends)
    placed, turning = paths.chains(nodes)
    runs, forked = paths.segments(placed)
    assert turning is None and forked is None and runs.count() == n + n - 1
    sums = paths.sums_along(runs, placed, nodes.select("session_id", "id", F.lit(1).alias("one")), ["one"])
    assert {(r.leaf_id, r.one) for r in sums.collect()} == {(f"d{k}", k + 2) for k in range(n - 1)} | {(f"t{n - 1}", n)}
    active, _ = paths.segments(placed, all_branches=False)
    assert paths.along(active, placed).count() == n


def test_sums_and_marks(spark):
    """Against the entries spelled out: sums of a branch, and the last mark on it."""
    nodes = tree.tree_nodes(spark.createDataFrame(forest(5, 30), SCHEMA)).withColumn("v", F.col("seq") % 7)
    placed, _ = paths.chains(nodes)
    runs, _ = paths.segments(placed)
    spelled = tree.linearised(paths.along(runs, placed), nodes.select("session_id", "id", "v"))
    plain = lambda d: sorted(tuple(r) for r in d.collect())
    assert plain(paths.sums_along(runs, placed, nodes, ["v"]).select("session_id", "leaf_id", "v")) == plain(spelled.groupBy("session_id", "leaf_id").agg(F.sum("v")))
    marks = nodes.where("v = 3").select("session_id", "id", F.col("seq").alias("mark"))
    want = spelled.join(marks, ["session_id", "id"]).groupBy("session_id", "leaf_id").agg(F.max("pos"), F.max_by("mark", "pos"))
    assert plain(paths.latest_along(runs, placed, marks, "mark").select("session_id", "leaf_id", "pos", "mark")) == plain(want)
