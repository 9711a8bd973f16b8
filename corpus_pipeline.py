"""A training corpus from documents: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm import common, jaccard, mixing, packing, pii, rules

#: Near duplicates share so much of their word shingles of this length.
NEAR_WORDS, NEAR_SIMILARITY = 5, (80, 100)


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with "doc " before the names of its columns, which no operator's column has, and the columns that turn it back."""
    return docs.toDF(*[f"doc {c}" for c in docs.columns]), [F.col(f"`doc {c}`").alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source's verdict is not against them."""
    rows, back = apart(docs)
    return rules.judge(rows, "doc text", "doc source").where("kept").select(*back)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links make: the one of the least doc_id (rows that share it: of the least mark of
    their texts). Documents without words or id stay. Equal rows of a document that stays are one."""
    doc_id, mark, count = common.unused(docs, "kept_id", "kept_mark", "kept_count")
    found = common.materialise(jaccard.jaccard_rows(docs, NEAR_WORDS, NEAR_SIMILARITY).where("component is not null and doc_id is not null"), "near-copies")
    kept = found.where("component_id = doc_id").groupBy("component").agg(F.min("mark").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    kept = common.materialise(kept, "near-copies-kept")  # of rows that share the id that stays; mostly none
    gone = found.where("component_id <> doc_id").select("doc_id", "mark")
    twice = kept.limit(1).count() > 0
    if twice:
        gone = gone.union(found.where("component_id = doc_id").join(kept, "component").where("mark <> least").select("doc_id", "mark"))
    gone = common.materialise(gone.select(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark)).distinct(), "near-copies-gone")
    small = gone.count() <= jaccard.BROADCAST_IDS
    own = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(mark)) & (docs["doc_id"].cast("long") == F.col(doc_id))
    left = docs.join(F.broadcast(gone) if small else gone, own, "left_anti")
    if twice:  # rows with the id and text of one that stays more than once
        again = found.where("component_id = doc_id").join(kept, "component").where("mark = least").groupBy(F.col("doc_id").alias(doc_id), F.col("mark").alias(mark)).agg(F.count("*").alias(count)).where(F.col(count) > 1)
        again = common.materialise(again, "near-copies-again")
        left = left.join(again, own, "left_anti").unionByName(docs.join(again, own).dropDuplicates([doc_id, mark]).select(*docs.columns))
    return left


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    rows, back = apart(docs)
    found = pii.find_pii(rows, "doc text")
    length = F.when(F.size("base") + F.size("added") > 0, F.length("redacted").cast("long")).otherwise(F.col("doc n_chars"))
    return found.withColumn("doc n_chars", length).withColumn("doc text", F.col("redacted")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", keep_good), ("near duplicates", keep_one_of_near), ("personal data", mask_pii), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Personal data and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
