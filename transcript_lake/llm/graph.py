"""Connected components of a graph of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_lake.llm.common import discard, materialise

#: Links up to which one task finds the components in memory (16 bytes each); checked by a count.
SMALL_LINKS = 1_000_000


def _in_one_task(batches):
    """(node, component) of all links in the batches: labels sink to the least of either end, and to the label's own label."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not found:
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate(side) for side in zip(*found, strict=True)]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            break
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
    for lo in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 100_000]), pa.array(nodes[label[lo : lo + 100_000]])], names=["node", "component"])


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    """From (u, v): (u, v, m) with m the least of u and its v's. The minimum is summed up before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _is_open(edges: DataFrame) -> bool:
    """Whether some node has two least neighbours, or hangs on one that hangs on another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count() > 0


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (node, component), the least node that each node reaches; nodes without links are absent.

    Up to SMALL_LINKS links are one task's work. Beyond, large and small stars alternate: neighbours are hung on the least
    one, first the larger ones, then the smaller, until each hangs on one that hangs on none; that takes about as many
    rounds as the logarithm of the longest path. Each round's edges are written to the shared folder; only whether there
    is more to do comes to the driver."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= SMALL_LINKS:
        found = materialise(edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long"), "components")
        discard(edges)
        return found
    while _is_open(edges):
        large = _min_neighbour(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = _min_neighbour(large)
        hung = low.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(hung.distinct(), "links")
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
