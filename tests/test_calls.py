"""Calls of a stream against the join of the table."""

import json

import pytest
from pyspark.sql import functions as F

from transcript_lake.operators import messages
from transcript_lake.sources import claude, jsonl
from transcript_lake.streaming import calls, jobs


def said(kind, seq, *parts):
    return json.dumps({"type": kind, "sessionId": "s", "uuid": f"u{seq}", "message": {"id": f"m{seq}", "role": kind, "content": list(parts)}}) + "\n"


def call(i, name="run"):
    return {"type": "tool_use", "id": i, "name": name, "input": {"a": 1}}


def result(i, text, error=False):
    return {"type": "tool_result", "tool_use_id": i, "content": text, "is_error": error}


@pytest.fixture
def stream(spark, tmp_path):
    """stream(wait): starts the job over the folder; step() processes all that is there; table() is what came out."""
    calls.keep_timers(spark)
    (tmp_path / "projects/p").mkdir(parents=True)
    started = []

    def start(wait_ms):
        events = calls.tool_events(jobs.normalised(jobs.tail(spark, str(tmp_path / "projects"))))
        q = calls.held_calls(events, wait_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").outputMode("append").start()
        started.append(q)
        return q

    yield start, tmp_path / "projects/p/s.jsonl", lambda: spark.read.schema(calls.CALL).parquet(str(tmp_path / "out"))
    for q in started:
        q.stop()


def batch(spark, path):
    entries = claude.entries(jsonl.raw_lines(spark, str(path)))
    events = calls.tool_events(entries)
    found = messages.with_results(events.where("kind = 'call'").select("session_id", "seq", "call_id", "name"), events.where("kind = 'result'").select("session_id", "seq", "call_id", "output", "is_error"))
    return sorted((r.call_id, r.name, r.output, r.is_error, r.has_result) for r in found.collect())


def wait_for(q, table, n, seconds=60):
    import time

    for _ in range(seconds * 4):
        if q.exception():
            raise q.exception()
        try:
            rows = table().collect()
        except Exception:
            rows = []
        if len(rows) >= n:
            return rows
        time.sleep(0.25)
    raise AssertionError(f"{len(rows)} rows of {n}")


def test_stream_equals_join(spark, stream):
    start, file, table = stream
    file.write_text(said("assistant", 1, {"type": "text", "text": "hello"}, call("a"), call("b", "read")) + said("user", 2, result("a", "done a")))
    q = start(3_600_000)
    assert [(r.call_id, r.output) for r in wait_for(q, table, 1)] == [("a", "done a")]
    q.stop()
    # the rest comes to a query that starts again: b's state is in the checkpoint
    file.open("a").write(said("user", 3, result("b", "", True), result("a", "again")) + said("assistant", 4, call("c")) + said("user", 5, result("c", "x"), result("z", "of no call")))
    q = start(3_600_000)
    rows = wait_for(q, table, 3)
    assert sorted((r.call_id, r.name, r.output, r.is_error, r.has_result) for r in rows) == batch(spark, file.parent) == [("a", "run", "done a", False, True), ("b", "read", "", True, True), ("c", "run", "x", False, True)]


def test_a_call_without_result_is_flushed(spark, stream):
    """A held call goes out without its result when it has waited; a late result brings it once more, and the last row counts."""
    start, file, table = stream
    file.write_text(said("assistant", 1, call("a"), call("b")))
    q = start(500)
    assert sorted((r.call_id, r.has_result) for r in wait_for(q, table, 2)) == [("a", False), ("b", False)]
    assert sorted(x[:2] + x[4:] for x in batch(spark, file.parent)) == [("a", "run", False), ("b", "run", False)]
    file.open("a").write(said("user", 2, result("a", "late")))
    wait_for(q, table, 3)
    last = calls.last_calls(table()).orderBy("call_id").collect()
    assert [(r.call_id, r.output, r.has_result) for r in last] == [("a", "late", True), ("b", None, False)]
    assert [(r.call_id, r.output) for r in last] == [x[0:3:2] for x in batch(spark, file.parent)]


def test_complete_calls(spark):
    """A call that carries its output is its own result; parts without an id go."""
    part = "struct<type: string, tool_call_id: string, name: string, output: string, is_error: boolean>"
    rows = spark.sql(f"select 's' as session_id, 1L as seq, cast(array(named_struct('type', 'tool_call', 'tool_call_id', 'a', 'name', 'n', 'output', 'o', 'is_error', null), named_struct('type', 'tool_call', 'tool_call_id', null, 'name', 'n', 'output', null, 'is_error', null), named_struct('type', 'text', 'tool_call_id', null, 'name', null, 'output', null, 'is_error', null)) as array<{part}>) as parts")
    assert sorted((r.kind, r.call_id, r.output, r.is_error) for r in calls.tool_events(rows).collect()) == [("call", "a", "o", False), ("result", "a", "o", False)]
    assert calls.tool_events(rows.where(F.lit(False))).count() == 0
