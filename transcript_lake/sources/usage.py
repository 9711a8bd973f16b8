"""Usage entries of all runtimes, in the order in which their stores are scanned."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from transcript_lake.operators.rollup import PROVIDERS, since
from transcript_lake.sources import claude, codex, jsonl, opencode, pi


def _entries(spark: SparkSession, provider: str, store: str) -> DataFrame:
    if provider == "claude":
        return claude.usage_entries(jsonl.chat_lines(spark, store))
    if provider == "codex":
        return codex.usage_entries(jsonl.raw_lines(spark, store))
    if provider == "pi":
        return pi.usage_entries(jsonl.raw_lines(spark, store))
    sessions, messages, _ = opencode.store(spark, store)
    return opencode.usage_entries(sessions, messages)


def usage_of(spark: SparkSession, stores: dict[str, str], providers: list[str] | None = None, after: datetime | None = None) -> DataFrame:
    """One table of usage entries with arrival, a key of the scan's order, from each runtime's store; stores: runtime to folder.

    providers: those wanted (none: all); an unknown name is an error, also in stores. A store that is not given or not there is
    empty. after: entries of that time or later and those without a time, before replays are taken out. Replays are
    still in; operators.dedup takes them out across all runtimes."""
    unknown = sorted({*stores, *(providers or [])} - set(PROVIDERS))
    if unknown:
        raise ValueError(f"unknown runtimes: {', '.join(unknown)}")
    out = jsonl.usage_rows(spark.createDataFrame([], "line_no bigint"))
    for name in PROVIDERS:
        if name in stores and (not providers or name in providers):
            out = out.unionByName(_entries(spark, name, stores[name]))
    out = since(out, after) if after else out
    return jsonl.arrival(out)
