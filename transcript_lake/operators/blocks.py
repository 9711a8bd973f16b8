"""Rolling usage blocks.

A block starts at the hour of its first entry; a new one starts when an entry is more than the duration past that start, or
past the entry before. Rows are first summed to cells, of which an hour of a scope has three at most; only cells are walked in
order, and blocks are sums of cells, so rows are read once and a hot scope is no hot key.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.functions.usage import limit_status, total_tokens, zero

HOURS = 5
MICROS = 3_600_000_000


def _micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def cells(entries: DataFrame, scope: list[str], span: int) -> DataFrame:
    """Entries summed to cells of their scope: (hour, part), lo, hi and the sums. An hour has three parts, before, at and after
    span mod one hour into it: a block starts at a full hour and is over span later, so none begins or ends within a cell of a
    span of an hour or more. For shorter spans, each instant of the last part is a cell of its own (at is its time, else null)."""
    us = _micros("ts")
    hour = us - F.pmod(us, F.lit(MICROS))
    off, rest = us - hour, span % MICROS
    part = F.when(off < rest, 0).when(off == rest, 1).otherwise(2)
    at = F.when(part == 2, us) if span < MICROS else F.lit(None).cast("long")
    cost = F.col("cost") if "cost" in entries.columns else F.lit(0.0)
    model = F.col("model") if "model" in entries.columns else F.lit(None).cast("string")
    rows = entries.where("ts is not null").select(
        *scope, us.alias("us"), hour.alias("hour"), part.alias("part"), at.alias("at"), total_tokens().alias("tokens"), (zero("input") + zero("output")).alias("plain"), cost.cast("double").alias("cost"), F.nullif(model, F.lit("")).alias("model")
    )
    return rows.groupBy(*scope, "hour", "part", "at").agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("entries"), F.sum("tokens").alias("tokens"), F.sum("plain").alias("plain"), F.sum("cost").alias("cost"), F.collect_set("model").alias("models")
    )


def merged_cells(parts: DataFrame, scope: list[str]) -> DataFrame:
    """Cells of several tables of cells of one scope and span, as one."""
    sums = [F.sum(c).alias(c) for c in ("entries", "tokens", "plain", "cost")]
    return parts.groupBy(*scope, "hour", "part", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *sums, F.array_distinct(F.flatten(F.collect_list("models"))).alias("models"))


def _starts(found: DataFrame, scope: list[str], span: int) -> DataFrame:
    """(scope, first, start, gap) of each block of cells, in microseconds; gap: the last entry before, where more than span
    passed. A cell opens a block if its first entry does, so the cells of a scope are walked in order, 26,352 a year at most."""
    walk = found.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "hour"))).alias("cells"))
    none = F.lit(None).cast("long")
    empty = F.array().cast("array<struct<first: bigint, start: bigint, gap: bigint>>")

    def step(acc: Column, c: Column) -> Column:
        gap = c["lo"] - acc["last"] > span
        opens = acc["start"].isNull() | gap | (c["lo"] - acc["start"] > span)
        new = F.struct(c["lo"].alias("first"), c["hour"].alias("start"), F.when(gap, acc["last"]).alias("gap"))
        return F.struct(F.when(opens, c["hour"]).otherwise(acc["start"]).alias("start"), c["hi"].alias("last"), F.when(opens, F.concat(acc["blocks"], F.array(new))).otherwise(acc["blocks"]).alias("blocks"))

    begin = F.struct(none.alias("start"), none.alias("last"), empty.alias("blocks"))
    return walk.select(*scope, F.explode(F.aggregate("cells", begin, step, lambda acc: acc["blocks"])).alias("b")).select(*scope, "b.*")


def _starts_of_instants(found: DataFrame, scope: list[str], span: int) -> DataFrame:
    """The same for spans below an hour, of which each cell is a block: a new hour is always more than the span past the one
    before, and what is more than the span into an hour is past its block's end at once. Gaps look back within the hour, and
    from its first cell to the hour before that has any, so only hours are ever put in one order."""
    hours = found.groupBy(*scope, "hour").agg(F.max("hi").alias("_hi"))
    before = F.lag("_hi").over(Window.partitionBy(*scope).orderBy("hour")).alias("_before")
    hours = hours.select(*[F.col(c).alias(f"_{c}") for c in [*scope, "hour"]], before)
    same = F.lit(True)
    for c in [*scope, "hour"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.lag("hi").over(Window.partitionBy(*scope, "hour").orderBy("lo"))
    rows = found.join(hours, same)
    last = F.coalesce(own, F.col("_before"))
    return rows.select(*scope, F.col("lo").alias("first"), F.col("hour").alias("start"), F.when(F.col("lo") - last > span, last).alias("gap"))


def _at_hours(blocks: DataFrame, lo: str, hi: str) -> DataFrame:
    """blocks once for each hour that they touch, so that rows find them by scope and hour however hot a scope is."""
    floor = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(MICROS))
    return blocks.withColumn("_hour", F.explode(F.sequence(floor(lo), floor(hi), F.lit(MICROS))))


def usage_blocks(entries: DataFrame, scope: list[str] | None = None, hours: float = HOURS, now: datetime | None = None) -> DataFrame:
    """Blocks of entries (ts, token classes, model, cost) within each scope (columns; none: all entries as one scope), gaps among them.

    start_ts, end_ts, first_ts, last_ts, entries, total_tokens, non_cache_tokens, cost, models, is_gap, is_active.
    Entries without a time are left out; entries of one instant stay together. With now, the block whose last entry is younger than the duration and that has not ended is active."""
    scope, span = scope or [], int(hours * MICROS)
    return blocks_of_cells(cells(entries, scope, span), scope, span, now)


def blocks_of_cells(found: DataFrame, scope: list[str], span: int, now: datetime | None = None) -> DataFrame:
    """usage_blocks of cells."""
    if span < MICROS:  # parts 0 and 1 of an hour are one block
        whole = merged_cells(found.withColumn("part", F.when(F.col("part") < 2, 0).otherwise(2)), scope)
        found, starts = whole, _starts_of_instants(whole, scope, span)
    else:
        starts = _starts(found, scope, span)
    opened = starts.select(*[F.col(c).alias(f"_{c}") for c in scope], F.struct("first", "start", "gap").alias("_b"), F.col("first").alias("_first"))
    same = F.col("lo") == F.col("_first")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = found.join(opened, same, "left")
    if span >= MICROS:  # a cell belongs to the last block that opened in its scope; cells are few
        marked = marked.withColumn("_b", F.last("_b", ignorenulls=True).over(Window.partitionBy(*scope).orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = marked.select(*scope, "lo", "hi", "entries", "tokens", "plain", "cost", "models", "_b.*").where("start is not null")
    done = marked.groupBy(*scope, "first", "start", "gap").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("entries", "tokens", "plain", "cost")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models")
    )
    stamp = lambda c: F.timestamp_micros(c)
    out = done.select(
        *scope, stamp("start").alias("start_ts"), stamp(F.col("start") + span).alias("end_ts"), stamp("lo").alias("first_ts"), stamp("hi").alias("last_ts"), "entries",
        F.col("tokens").alias("total_tokens"), F.col("plain").alias("non_cache_tokens"), "cost", "models", F.lit(False).alias("is_gap"),
    )
    void = lambda t: F.lit(None).cast(t)
    gaps = starts.where("gap is not null").select(
        *scope, stamp(F.col("gap") + span).alias("start_ts"), stamp("first").alias("end_ts"), void("timestamp").alias("first_ts"), void("timestamp").alias("last_ts"), F.lit(0).cast("long").alias("entries"),
        F.lit(0).cast("long").alias("total_tokens"), F.lit(0).cast("long").alias("non_cache_tokens"), F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("models"), F.lit(True).alias("is_gap"),
    )
    active = F.lit(False)
    if now is not None:
        active = F.coalesce(~F.col("is_gap") & (F.lit(now) - F.col("last_ts") < F.lit(timedelta(microseconds=span))) & (F.lit(now) < F.col("end_ts")), F.lit(False))
    return out.unionByName(gaps).withColumn("is_active", active)


def with_burn_rate(blocks: DataFrame, entries: DataFrame, scope: list[str] | None = None, strict_membership: bool = False) -> DataFrame:
    """blocks with tokens_per_minute, non_cache_per_minute and cost_per_hour, over the entries in [start, end) of the scope,
    which can hold the tail of the block before; with strict_membership, over the block's own. Null where they span no time."""
    scope = scope or []
    rows = entries.where("ts is not null").withColumns({"_us": _micros("ts")}).withColumn("_hour", F.col("_us") - F.pmod("_us", F.lit(MICROS)))
    spans = blocks.where("not is_gap").select(*scope, "start_ts", "first_ts", _micros("first_ts" if strict_membership else "start_ts").alias("_lo"), (_micros("last_ts") if strict_membership else _micros("end_ts") - 1).alias("_hi"))
    hit = rows.join(_at_hours(spans, "_lo", "_hi"), [*scope, "_hour"]).where("_us between _lo and _hi")
    cost = F.sum("cost") if "cost" in entries.columns else F.lit(0.0)
    rates = hit.groupBy(*scope, "start_ts", "first_ts").agg(((F.max("_us") - F.min("_us")) / 60e6).alias("_minutes"), F.sum(total_tokens()).alias("_tokens"), F.sum(zero("input") + zero("output")).alias("_plain"), cost.alias("_cost"))
    per = lambda c, k=1: F.when(F.col("_minutes") > 0, F.col(c) / F.col("_minutes") * k)
    rates = rates.select(*scope, "start_ts", "first_ts", per("_tokens").alias("tokens_per_minute"), per("_plain").alias("non_cache_per_minute"), per("_cost", 60).alias("cost_per_hour"))
    return blocks.join(rates, [*scope, "start_ts", "first_ts"], "left")


def with_burn_rate_of_cells(blocks: DataFrame, found: DataFrame, scope: list[str]) -> DataFrame:
    """with_burn_rate from cells of an hour's span or more, of which each lies in [start, end) as a whole or not at all."""
    spans = blocks.where("not is_gap").select(*scope, "start_ts", "first_ts", _micros("start_ts").alias("_lo"), (_micros("end_ts") - 1).alias("_hi"))
    hit = found.withColumn("_hour", F.col("hour")).join(_at_hours(spans, "_lo", "_hi"), [*scope, "_hour"]).where("lo >= _lo and hi <= _hi")
    rates = hit.groupBy(*scope, "start_ts", "first_ts").agg(((F.max("hi") - F.min("lo")) / 60e6).alias("_minutes"), F.sum("tokens").alias("_tokens"), F.sum("plain").alias("_plain"), F.sum("cost").alias("_cost"))
    per = lambda c, k=1: F.when(F.col("_minutes") > 0, F.col(c) / F.col("_minutes") * k)
    rates = rates.select(*scope, "start_ts", "first_ts", per("_tokens").alias("tokens_per_minute"), per("_plain").alias("non_cache_per_minute"), per("_cost", 60).alias("cost_per_hour"))
    return blocks.join(rates, [*scope, "start_ts", "first_ts"], "left")


def with_projection(blocks: DataFrame, now: datetime, limit: int = 0) -> DataFrame:
    """blocks with, for active ones with a burn rate, remaining_minutes and the tokens and cost that they will end with, and limit_status."""
    minutes = (_micros("end_ts") - _micros(F.lit(now))) / 60e6
    live = F.col("is_active") & F.col("tokens_per_minute").isNotNull()
    out = blocks.withColumns({
        "remaining_minutes": F.when(live, F.round(minutes).cast("long")),
        "projected_tokens": F.when(live, F.round(F.col("total_tokens") + F.col("tokens_per_minute") * minutes).cast("long")),
        "projected_cost": F.when(live, F.round((F.col("cost") + F.col("cost_per_hour") / 60 * minutes) * 100) / 100),
    })
    return out.withColumn("limit_status", limit_status(F.col("total_tokens"), F.col("projected_tokens"), limit))


def block_report(entries: DataFrame, scope: list[str] | None = None, hours: float = HOURS, now: datetime | None = None, limit: int = 0) -> DataFrame:
    """Blocks with burn rate and projection on the active one only."""
    blocks = with_burn_rate(usage_blocks(entries, scope, hours, now), entries, scope)
    for c in ("tokens_per_minute", "non_cache_per_minute", "cost_per_hour"):
        blocks = blocks.withColumn(c, F.when(F.col("is_active"), F.col(c)))
    return with_projection(blocks, now or datetime(1970, 1, 1), limit)
