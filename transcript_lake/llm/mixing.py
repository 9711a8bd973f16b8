"""Mixing sources to target weights by capped water-filling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.llm.common import WORD, joined, materialise, running_start, table, unused

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"

#: Rows that one window over a slice of a source holds on average, at most.
SLICE_ROWS = 65_536


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source_key, source, size): one row a source with its size and its target.

    Sources above max_epochs times their size are clamped there, and what they leave is shared out again by weight,
    round by round, until none is above. A round is one aggregation over the sources; one row comes to the driver.
    """
    sums = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    ranked = running_start(sums, [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    at = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialise(ranked.select("source_key", "source_size", at.cast("long").alias("weight")), "sources")
    all_size, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_weight, clamped = all_size or 0, all_weight or 1, None
    while True:
        over = F.expr(f"cast({max_epochs} * source_size as decimal(38,0)) * {open_weight} < cast({left} as decimal(38,0)) * weight")
        row = sources.where(over).agg(F.count("*"), F.sum(F.col("source_size") * max_epochs), F.sum("weight")).first()
        if row[0] == clamped or row[0] == 0 or row[2] == all_weight:
            break
        clamped, left, open_weight = row[0], all_size - row[1], all_weight - row[2]
    share = F.lit(left).cast("double") * F.col("weight") / F.lit(open_weight).cast("double")
    return sources.select("source_key", "source_size", F.when(over, F.col("source_size").cast("double") * max_epochs).otherwise(share).alias("target"))


def _keys(doc_id: str, source: str, text: str, seed: str) -> dict[str, Column]:
    return {
        "source_key": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")),
        "order": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))),
        "size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
    }


def _dealt(docs: DataFrame, text: str, doc_id: str, source: str, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """Per row: doc_id, source_key, order, size, its source's size, target and whole copies, and whether it is taken once more."""
    keys = _keys(doc_id, source, text, seed)
    sized = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), *[c.alias(k) for k, c in keys.items()]), "sizes")
    digits, rows = 2, sized.count()
    while rows > SLICE_ROWS * 16**digits:
        digits += 1
    sized = sized.withColumn("slice", F.substring("order", 1, digits))
    per_source = targets(sized, weights, max_epochs)
    slices = sized.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(Window.partitionBy("source_key").orderBy("slice")) - F.col("slice_size")
    slices = slices.withColumn("slice_start", before).join(per_source, "source_key")
    within = Window.partitionBy("source_key", "slice").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = sized.join(slices.drop("slice_size"), ["source_key", "slice"]).withColumn("start", F.col("slice_start") + F.sum("size").over(within) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    return dealt.withColumn("whole", whole.cast("int")).withColumn("again", (F.col("whole") < max_epochs) & (2 * F.col("start") + F.col("size") <= 2 * rest))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, size (words), source_size, target (of its source), copies, taken (words, repeats counted).

    Each document is repeated as often as its source's target holds the source whole. For the rest, documents are put in
    the order of a seeded hash and taken while their middle lies within what is left, so a source ends within half a
    document of its target. Prefix sums run over slices of the hash, so a hot source spreads over many tasks.

    Null text: size 0. Null source: a source of its own, last in order. A source without words: target 0, nothing taken.
    Rows that are equal in all columns are rows of their own. No rows: no rows. Other columns are ignored."""
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("again").cast("int"))
    out = _dealt(docs, text, doc_id, source, weights, max_epochs, seed).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with each row as often as mix takes it; rows without words go.

    The documents taken once more are the first of their source in the seeded order, so the last of them is all that a
    source needs to tell: docs are joined with one row a source and never moved. Equal rows at that last place are all taken."""
    dealt = _dealt(docs, text, doc_id, source, weights, max_epochs, seed)
    last = F.max(F.when(F.col("again"), F.struct("order", "doc_id", "size")))
    source_key, order, size, whole, end, copies, copy = unused(docs, "source_key", "order", "size", "whole", "last", "copies", "copy")
    ends = materialise(dealt.groupBy(F.col("source_key").alias(source_key)).agg(F.max("whole").alias(whole), last.alias(end)), "mix-ends")
    keys = dict(zip((source_key, order, size), _keys(doc_id, source, text, seed).values(), strict=True))
    at = F.struct(F.col(order).alias("order"), F.col(doc_id).alias("doc_id"), F.col(size).alias("size"))
    times = F.when(F.col(size) == 0, 0).otherwise(F.col(whole) + F.coalesce(at <= F.col(end), F.lit(False)).cast("int"))
    out = joined(docs.withColumns(keys), ends, source_key, "inner").withColumn(copies, times).where(F.col(copies) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * s / w, source) AS k,
    coalesce(sum(3 * s) OVER (ORDER BY 3.0 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    sum(w) OVER (ORDER BY 3.0 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(s) OVER () AS t FROM sums),
level AS (SELECT (t - c)::DOUBLE AS num, open::DOUBLE AS den FROM ranked WHERE (t - c) * w <= 3 * s * open ORDER BY k LIMIT 1),
goal AS (SELECT source, s, CASE WHEN 3.0 * s * den < num * w THEN 3.0 * s::DOUBLE ELSE num * w / den END AS target FROM ranked, level),
dealt AS (
  SELECT d.doc_id, d.size, g.s, g.target, CASE WHEN g.s > 0 THEN floor(g.target / g.s) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE size * least(whole + CASE WHEN 2 * start + size <= 2 * (target - whole * s) THEN 1 ELSE 0 END, 3)::BIGINT END AS taken
FROM dealt
"""
