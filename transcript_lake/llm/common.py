"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which the small side of a join is broadcast; checked by a count each time.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where none is set and all tasks run in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*spent: DataFrame) -> None:
    """Deletes what materialise wrote; for tables that nothing reads again. The driver's JVM is asked to collect what is
    unreachable, on which Spark deletes the shuffle files of finished jobs; else they stay until its heap fills."""
    for df in spent:
        jvm = df.sparkSession._jvm  # Hadoop's file systems are reached through the gateway only
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if spent:
        spent[0].sparkSession._jvm.java.lang.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of names that no column of df has, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 32) -> DataFrame:
    """left joined with right, which has one row a key. right is counted: up to BROADCAST_ROWS rows are broadcast.
    Beyond, right is repeated once a salt and left is salted by a hash of its row, so that a hot key spreads over as many tasks."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    (salt,) = unused(left, "salt")
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if "map" not in t and "variant" not in t]), F.lit(salts)).cast("int"))
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(many, [key, salt], how).drop(salt)


def hashed_sample(df: DataFrame, text: str, most: int) -> DataFrame:
    """Distinct values of a text column, about `most` at most, those whose 64-bit hash is low: the rows are counted, the
    hash is held under the share that leaves so many, and copies are dropped. No hash but the sample's is shuffled."""
    rows = df.where(F.col(text).isNotNull())
    n = rows.count()
    least = -(1 << 63)
    limit = least + (1 << 64) * most // max(n, most) - 1
    return rows.where(F.xxhash64(text) <= F.lit(limit)).select(text).dropDuplicates([text])


def running_start(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with column name: the sum of value over all rows before, in the given order (ties: any order among equal keys).
    Ranges of the order are dealt to partitions; one total a partition is all that meets in one task."""
    part, own, first, total = unused(df, "part", "own", "first", "total")
    parts = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).withColumn(own, value), "ranges")
    totals = parts.groupBy(part).agg(F.sum(own).alias(total))
    before = totals.select(part, (F.sum(total).over(Window.orderBy(part)) - F.col(total)).alias(first))
    within = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(own)
    # before has one row a partition of the shuffle
    return parts.join(F.broadcast(before), part).withColumn(name, (within + F.col(first)).cast("long")).drop(part, own, first)
