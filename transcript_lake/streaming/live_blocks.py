"""Live usage blocks from sums kept by batch.

Each batch's rows are summed to cells (operators.blocks) and written to a folder of the batch's own number, so a batch that is
done twice writes the same folder again. A report sums the cells since the last block that began before the horizon; every
few batches the folders are put together, and blocks from before the horizon are written out for good. So a tick reads the kept
hours of the scopes and no row twice, however long the stream has run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.operators import blocks
from transcript_lake.operators.common import small

#: Hours before the latest for which cells are kept; batches that are put together.
KEEP_HOURS, EVERY = 48, 16


class LiveBlocks:
    """folder: where the sums live. scope: columns of the rows, whose types are those of the first batch (none: all rows as one).

    Rows must have lost their replays (jobs.streaming_dedup). Rows more than keep_hours late, of a scope whose blocks of that
    time are closed, are left to the batch operators."""

    def __init__(self, folder: str, scope: list[str] | None = None, hours: float = blocks.HOURS, keep_hours: int = KEEP_HOURS, every: int = EVERY) -> None:
        self.span = int(hours * blocks.MICROS)
        if self.span < blocks.MICROS or keep_hours < 2 * hours:
            raise ValueError("blocks of an hour or more, and cells kept for two spans")
        self.folder, self.scope, self.keep, self.every = folder.rstrip("/"), scope or [], keep_hours, every

    def together(self, number: int) -> int:
        """The last batch that the folders put together before this one's report hold; -1: none."""
        return number // self.every * self.every - 1

    def kept(self, spark: SparkSession, number: int) -> DataFrame:
        """The cells that a report after batch `number` needs."""
        upto = self.together(number)
        paths = [f"{self.folder}/cells/batch={k}" for k in range(upto + 1, number + 1)]
        if upto < 0:
            return blocks.merged_cells(spark.read.parquet(*paths), self.scope)
        base, since = spark.read.parquet(f"{self.folder}/base/upto={upto}"), spark.read.parquet(f"{self.folder}/since/upto={upto}")
        new = spark.read.parquet(*paths)
        return blocks.merged_cells(base.unionByName(self.not_closed(new, since)), self.scope)

    def not_closed(self, found: DataFrame, since: DataFrame) -> DataFrame:
        """Cells without those of closed blocks: since has where each scope's kept cells begin."""
        held = since.select(*[F.col(c).alias(f"_{c}") for c in self.scope], "since")
        same = F.col("lo") < F.col("since")
        for c in self.scope:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return found.join(small(held), same, "left_anti")

    def add(self, batch: DataFrame, number: int) -> None:
        """Sums a batch; after every few, puts the folders together for the batches to come."""
        blocks.cells(batch, self.scope, self.span).write.mode("overwrite").parquet(f"{self.folder}/cells/batch={number}")
        if (number + 1) % self.every == 0:
            self.compact(batch.sparkSession, number)

    def compact(self, spark: SparkSession, number: int) -> None:
        found = self.kept(spark, number)
        horizon = F.lit((found.agg(F.max("hour")).first()[0] or 0) - self.keep * blocks.MICROS)
        made = blocks.blocks_of_cells(found, self.scope, self.span)
        began = F.unix_micros("first_ts")
        since = made.where(~F.col("is_gap") & (F.unix_micros("start_ts") <= horizon)).groupBy(*self.scope).agg(F.max(began).alias("since"))
        since.write.mode("overwrite").parquet(f"{self.folder}/since/upto={number}")
        since = spark.read.parquet(f"{self.folder}/since/upto={number}")
        self.not_closed(found, since).write.mode("overwrite").parquet(f"{self.folder}/base/upto={number}")
        # closed: all before the last block that began before the horizon; a gap goes with the block after it
        at = F.when(F.col("is_gap"), F.unix_micros("end_ts")).otherwise(began)
        held = since.select(*[F.col(c).alias(f"_{c}") for c in self.scope], "since")
        same = F.lit(True)
        for c in self.scope:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        done = made.withColumn("_at", at).join(held, same).where((F.col("_at") < F.col("since")) | (F.col("is_gap") & (F.col("_at") == F.col("since"))))
        done.select(*made.columns).drop("is_active").write.mode("overwrite").parquet(f"{self.folder}/closed/upto={number}")

    def closed(self, spark: SparkSession, number: int) -> DataFrame | None:
        """The blocks and gaps that are closed for good, as of a batch."""
        ends = range(self.every - 1, self.together(number) + 1, self.every)
        return spark.read.parquet(*[f"{self.folder}/closed/upto={k}" for k in ends]) if ends else None

    def report(self, spark: SparkSession, number: int, now: datetime, limit: int = 0) -> DataFrame:
        """block_report of the kept cells after a batch."""
        found = self.kept(spark, number)
        made = blocks.with_burn_rate_of_cells(blocks.blocks_of_cells(found, self.scope, self.span, now), found, self.scope)
        for c in ("tokens_per_minute", "non_cache_per_minute", "cost_per_hour"):
            made = made.withColumn(c, F.when(F.col("is_active"), F.col(c)))
        return blocks.with_projection(made, now, limit)


def watch_blocks(folder: str, report: Callable[[DataFrame], None], scope: list[str] | None = None, hours: float = blocks.HOURS, limit: int = 0, now: Callable[[], datetime] = datetime.utcnow, keep_hours: int = KEEP_HOURS, every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over usage rows without replays: reports the active block of each scope, of all that has come."""
    live = LiveBlocks(folder, scope, hours, keep_hours, every)

    def tick(batch: DataFrame, number: int) -> None:
        live.add(batch, number)
        report(live.report(batch.sparkSession, number, now(), limit).where("is_active"))

    return tick
