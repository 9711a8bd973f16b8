"""Tool calls of a stream, each held until its result comes or it has waited long enough.

State is one call's, keyed by session and call id, so a session of any length spreads over the tasks; it is dropped when it has
not been used for a while. The query's checkpoint holds it, so a batch that is done twice gives each row once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a call waits for its result before it is given without one, and how long its state is kept after it was last used.
WAIT_MS, KEEP_MS = 60_000, 24 * 3_600_000

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT = "session_id string, call_id string, kind string, seq bigint, name string, output string, is_error boolean"
CALL = "session_id string, call_id string, seq bigint, name string, output string, is_error boolean, has_result boolean"


def tool_events(entries: DataFrame) -> DataFrame:
    """Calls and results of entries, a row each; a call that carries its output already is both. Those without an id cannot meet and go."""
    parts = entries.select("session_id", "seq", F.explode("parts").alias("p")).where("p.type in ('tool_call', 'tool_result') and coalesce(p.tool_call_id, '') <> ''")
    complete = (F.col("p.type") == "tool_call") & F.col("p.output").isNotNull()
    kinds = F.when(complete, F.array(F.lit("call"), F.lit("result"))).otherwise(F.array(F.when(F.col("p.type") == "tool_call", "call").otherwise("result")))
    return parts.select("session_id", F.col("p.tool_call_id").alias("call_id"), F.explode(kinds).alias("kind"), F.col("seq").cast("bigint").alias("seq"), "p.name", "p.output", F.coalesce("p.is_error", F.lit(False)).alias("is_error"))


class HeldCalls(StatefulProcessor):
    """The calls of one id that wait, and the first result that came. A call goes out when it meets the result; one whose
    timer fires goes out without, and again with the result if that comes later, so a table keeps a call's last row."""

    def __init__(self, wait_ms: int, keep_ms: int) -> None:
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "seq bigint, name string, given boolean", self.keep_ms)
        self.result = handle.getValueState("result", "seq bigint, output string, is_error boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        come = sorted(rows, key=lambda r: r.seq)
        known = self.result.get() if self.result.exists() else None
        if known is None:
            first = next((r for r in come if r.kind == "result"), None)
            if first is not None:
                known = (first.seq, first.output, first.is_error)
                self.result.update(known)
        new = [(r.seq, r.name, False) for r in come if r.kind == "call"]
        if known is None:
            if new:
                self.calls.appendList(new)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            return
        for seq, name, _ in [*self.calls.get(), *new]:
            yield Row(session_id=key[0], call_id=key[1], seq=seq, name=name, output=known[1], is_error=known[2], has_result=True)
        self.calls.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = list(self.calls.get())
        for seq, name, given in held:
            if not given:
                yield Row(session_id=key[0], call_id=key[1], seq=seq, name=name, output=None, is_error=None, has_result=False)
        if held:
            self.calls.put([(seq, name, True) for seq, name, _ in held])

    def close(self) -> None:
        pass


def held_calls(events: DataFrame, wait_ms: int = WAIT_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """The calls of a stream of tool_events with their results, as messages.with_results gives them for a table: each once
    its result is there, or without one after wait_ms. In append mode. The session's state store must be one that keeps timers
    (keep_timers sets it)."""
    return events.groupBy("session_id", "call_id").transformWithState(HeldCalls(wait_ms, keep_ms), CALL, "Append", "ProcessingTime")


def keep_timers(spark: SparkSession) -> None:
    """Sets the session's state store to one that keeps timers, for queries that start from now on."""
    spark.conf.set(PROVIDER, ROCKSDB)


def last_calls(calls: DataFrame) -> DataFrame:
    """Of a table of held_calls, one row a call: the one with the result, if it came."""
    return calls.groupBy("session_id", "seq", "call_id").agg(F.max_by(F.struct("name", "output", "is_error", "has_result"), "has_result").alias("c")).select("session_id", "seq", "call_id", "c.*")
