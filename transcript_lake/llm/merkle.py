"""A Merkle manifest of a dataset, with a proof for each row, by cogrouped exchange of subtrees.

Leaves ascend by doc_id within their source; every 16 consecutive nodes become one until one is left, the source's subroot;
subroots, ordered by source, become the root likewise. Nodes are dealt in superblocks of 16**3 nodes, which stand for three levels.
Upwards, each superblock is reduced to one node, and these are the next layer's. Downwards, the nodes of a layer are cogrouped
by superblock with what the layer above knows of it, its outer nodes: one task does the local reduction again, joins each
node's inner siblings with the outer ones, and folds. No task sees more than a few superblocks, whatever a source's size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.llm.common import joined, materialise, table

FANOUT = 16

#: Levels that a superblock stands for.
LEVELS = 3

#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A node's siblings, level by level: its place in its run, and the others' digests.
STEPS = "array<struct<at: int, others: array<string>>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of the fields, each as its UTF-8 length and value, null as "-"."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)), 256)


def reduced(digests: list[str], levels: int | None) -> list[list[str]]:
    """The levels of nodes over digests, themselves first: so many, or until one is left if levels is None."""
    found = [digests]
    while len(found[-1]) > 1 if levels is None else len(found) <= levels:
        below = found[-1]
        found.append([digest(below[k : k + FANOUT]) for k in range(0, len(below), FANOUT)])
    return found


def steps(levels: list[list[str]], k: int) -> list[dict]:
    """The siblings of node k, level by level."""
    out = []
    for nodes in levels[:-1]:
        lo, at = k - k % FANOUT, k % FANOUT
        out.append({"at": at, "others": nodes[lo : lo + at] + nodes[lo + at + 1 : lo + FANOUT]})
        k //= FANOUT
    return out


def folded(leaf: str, path: list[dict]) -> str:
    """What a leaf and the siblings beside it make."""
    for step in path:
        leaf = digest([*step["others"][: step["at"]], leaf, *step["others"][step["at"] :]])
    return leaf


def blocks_of(pdf: pd.DataFrame, levels: int) -> Iterator[tuple[pd.DataFrame, list[list[str]]]]:
    """Each superblock of a group, its nodes in order, with its levels. A tree of one superblock is reduced until one is left."""
    if pdf.empty:
        return
    size = FANOUT**levels
    pdf = pdf.sort_values(["tree", "n"], kind="stable")
    edges = (pdf["tree"].ne(pdf["tree"].shift()) | (pdf["n"] // size).ne(pdf["n"].shift() // size)).to_numpy().nonzero()[0].tolist()
    for lo, hi in zip(edges, [*edges[1:], len(pdf)], strict=True):
        part = pdf.iloc[lo:hi]
        yield part, reduced(part["digest"].tolist(), None if part["total"].iloc[0] <= size else levels)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with n, their place in their tree by the order, and total, the tree's size. Ranges of (tree, order) are dealt to
    partitions, so a hot tree spreads; one row a partition and tree is summed up."""
    ranged = materialise(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "merkle-ranges")
    part = F.shiftright("at", 33)
    runs = ranged.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("tree")
    before = F.sum("rows").over(whole.orderBy("part")) - F.col("rows")
    runs = materialise(runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("total")).withColumn("run", F.struct("tree", "part")).drop("tree", "part"), "merkle-runs")
    return joined(ranged.withColumn("run", F.struct("tree", part.alias("part"))), runs, "run", "inner").withColumn("n", F.col("at") + F.col("shift")).drop("run", "shift", "at")


def dealt(nodes: DataFrame, groups: int, block: Column) -> DataFrame:
    """nodes with super, the group in which their superblock meets; a group holds a few superblocks, each whole."""
    return nodes.withColumn("super", F.pmod(F.xxhash64("tree", block), F.lit(groups)))


def layers(nodes: DataFrame, levels: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """From (tree, n, total, digest): the layers of nodes, each with its number of groups, and (tree, digest) of the roots.
    Each layer has a node for a superblock of the one below, so a hundred billion leaves make four."""

    block = FANOUT**levels

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(part["tree"].iloc[0], part["n"].iloc[0] // block, -(-part["total"].iloc[0] // block), made[-1][0]) for part, made in blocks_of(pdf, levels)]
        return pd.DataFrame(found, columns=["tree", "n", "total", "digest"])

    out, done = [], None
    while True:
        size, most = nodes.agg(F.count("*"), F.max("total")).first()
        groups = max(1, 2 * size // block)
        out.append((nodes, groups))
        above = dealt(nodes, groups, F.floor(F.col("n") / block)).groupBy("super").applyInPandas(up, "tree string, n long, total long, digest string")
        above = materialise(above, "merkle-nodes")
        ended = above.where("total = 1").select("tree", "digest")
        done = ended if done is None else done.union(ended)
        if (most or 0) <= block:
            return out, done
        nodes = above.where("total > 1")


def proven(nodes: DataFrame, groups: int, levels: int, outer: DataFrame, finish, schema: str) -> DataFrame:
    """nodes cogrouped by superblock with outer: (tree, block, path, root), the siblings above the superblock and what is
    above them. finish(part, paths, root) gives the rows of a superblock from its nodes and their whole paths."""

    def down(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {(t, b): (list(p), s, r) for t, b, p, s, r in zip(right["tree"], right["block"], right["path"], right["subroot"], right["root"], strict=True)}
        found = []
        for part, made in blocks_of(left, levels):
            above, subroot, root = known[part["tree"].iloc[0], part["n"].iloc[0] // FANOUT**levels]
            found.append(finish(part, [steps(made, k) + above for k in range(len(part))], subroot, root))
        return pd.concat(found) if found else finish(left, [], None, None)

    left = dealt(nodes, groups, F.floor(F.col("n") / FANOUT**levels)).groupBy("super")
    return left.cogroup(dealt(outer, groups, F.col("block")).groupBy("super")).applyInPandas(down, schema)


OUTER = f"tree string, block long, path {STEPS}, subroot string, root string"


def as_outer(part: pd.DataFrame, paths: list, subroot: str | None, root: str | None) -> pd.DataFrame:
    """A layer's nodes as the superblocks of the layer below."""
    return pd.DataFrame({"tree": part["tree"], "block": part["n"], "path": pd.Series(paths, index=part.index, dtype=object), "subroot": subroot, "root": root})


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source", text: str = "text", every: int = 5, levels: int = LEVELS, proofs: bool = True) -> DataFrame:
    """Per row of docs: doc_id, source, its leaf, its source's subroot, the root, the proof (if proofs: the siblings level by level) and
    proof_sha256 over them, and a check: folded_root, what the proof and a leaf make, which is the row's own or, where every
    divides the CRC-32 of doc_id, one with the text's A-Z in lower case; verified if that is the root.

    Null source: a tree of its own, first. Null doc_id: first in its source, never tampered with. Rows that share source and
    doc_id: by their leaves, so equal rows have neighbouring places. A null field counts as "-". No rows: no rows. Other
    columns are ignored, whatever their names."""
    as_given = [F.col(f"`{c}`") for c in fields]
    lower = [F.translate(F.col(f"`{c}`"), UPPER, LOWER) if c == text else F.col(f"`{c}`") for c in fields]
    hit = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % every == 0, F.lit(False))
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(doc_id).alias("doc_id"), leaf_digest(as_given).alias("digest"), F.when(hit, leaf_digest(lower)).alias("tampered"))
    leaves = materialise(placed(materialise(rows, "merkle-leaves"), ["doc_id", "digest"]), "merkle-placed")
    within, subroots = layers(leaves, levels)
    # the sources make one tree of their own
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = materialise(placed(tops, ["name"]), "merkle-subroots")
    across, roots = layers(tops, levels)
    none = F.array().cast(STEPS)
    outer = roots.select("tree", F.lit(0).cast("long").alias("block"), none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes, groups in reversed(across[1:]):
        outer = materialise(proven(nodes, groups, levels, outer, as_outer, OUTER), "merkle-outer")

    def to_source(part: pd.DataFrame, paths: list, subroot: str | None, root: str | None) -> pd.DataFrame:
        return pd.DataFrame({"tree": part["name"], "block": 0, "path": pd.Series(paths, index=part.index, dtype=object), "subroot": part["digest"], "root": root})

    outer = materialise(proven(*across[0], levels, outer, to_source, OUTER), "merkle-outer")
    # a source of several layers comes in at its own top; one of fewer waits for its layer
    known = outer
    for nodes, groups in reversed(within[1:]):
        tall = nodes.select("tree").distinct()
        here = known.join(tall, "tree", "left_semi")
        known = known.join(tall, "tree", "left_anti").union(materialise(proven(nodes, groups, levels, here, as_outer, OUTER), "merkle-outer"))

    def to_leaf(part: pd.DataFrame, paths: list, subroot: str | None, root: str | None) -> pd.DataFrame:
        ends = [folded(t or d, path) for d, t, path in zip(part["digest"], part["tampered"], paths, strict=True)]
        digests = [digest([x for step in path for x in step["others"]]) for path in paths]
        given = {"proof": pd.Series(paths, index=part.index, dtype=object)} if proofs else {}
        return pd.DataFrame({"tree": part["tree"], "doc_id": part["doc_id"], "leaf": part["digest"], "subroot": subroot, "root": root, "proof_sha256": digests, "folded_root": ends, "verified": [x == root for x in ends]} | given)

    kind = dict(leaves.dtypes)["doc_id"]
    schema = f"tree string, doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{f', proof {STEPS}' if proofs else ''}"
    out = proven(*within[0], levels, known, to_leaf, schema)
    return out.withColumn("source", F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))).drop("tree")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(table(spark, sf_dir, "documents").select(*FIELDS), proofs=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Levels of a source's tree and of the sources' that the SQL spells out: 16**4 leaves a source, 16**3 sources.
_DEEP, _WIDE = 4, 3


def _oracle() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(f"CASE WHEN text IS NULL THEN '-' ELSE strlen({text})::VARCHAR || ':' || {text} END" if c == "text" else field(c) for c in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    sql = [
        "tab AS (SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) r(i)))",
        "d AS (SELECT row_number() OVER () AS r, documents.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) % 5 = 0 AS hit FROM documents, tab)",
        f"h AS (SELECT r, doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, {leaf(low)} AS low, coalesce(hit, FALSE) AS hit FROM d)",
        "base AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS n, leaf AS g, r, doc_id, hit, low, leaf FROM h)",
        "p0 AS (SELECT r, tree, doc_id, leaf, NULL::VARCHAR AS subroot, n AS k, CASE WHEN hit THEN low ELSE leaf END AS f, '' AS proof FROM base)",
        "n0 AS (SELECT tree, n, g FROM base)",
    ]
    # a level's nodes, and every leaf's place, fold and proof so far
    for level in range(_DEEP + _WIDE + 1):
        a, b = level, level + 1
        if level == _DEEP:  # subroots become the leaves of one tree
            sql += [
                f"n{b} AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS n, g, tree AS name FROM n{a})",
                f"p{b} AS (SELECT p.* REPLACE (n{b}.n AS k, n{b}.g AS subroot) FROM p{a} p JOIN n{b} ON p.tree = n{b}.name)",
            ]
            continue
        part = "tree" if level < _DEEP else "''"
        size = f"(SELECT {part} AS tree, count(*) AS m FROM n{a} GROUP BY 1)"
        run = f"p.k // 16 = n.n // 16 AND {'p.tree = n.tree' if level < _DEEP else 'TRUE'}"
        sql += [
            f"n{b} AS (SELECT n.tree, n.n // 16 AS n, CASE WHEN m = 1 THEN min(g) ELSE sha256(string_agg(g, '' ORDER BY n.n)) END AS g FROM n{a} n JOIN {size} USING (tree) GROUP BY n.tree, n.n // 16, m)",
            f"p{b} AS (SELECT r, {', '.join(f'any_value(p.{c}) AS {c}' for c in ('tree', 'doc_id', 'leaf', 'subroot'))}, any_value(k) // 16 AS k, "
            f"CASE WHEN any_value(m) = 1 THEN any_value(f) ELSE sha256(string_agg(CASE WHEN n.n = k THEN f ELSE n.g END, '' ORDER BY n.n)) END AS f, "
            f"any_value(proof) || CASE WHEN any_value(m) = 1 THEN '' ELSE coalesce(string_agg(n.g, '' ORDER BY n.n) FILTER (n.n <> k), '') END AS proof FROM p{a} p JOIN n{a} n ON {run} JOIN {size} s ON s.tree = n.tree GROUP BY r)",
        ]
    last = _DEEP + _WIDE + 1
    return f"WITH {', '.join(sql)} SELECT doc_id, leaf, subroot, n.g AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = n.g AS verified FROM p{last} p, n{last} n"


ORACLE = _oracle()
