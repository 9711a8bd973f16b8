"""The tailing source and jobs over growing files."""

import json
import os

from transcript_lake.sources import opencode
from transcript_lake.streaming import jobs
from transcript_lake.streaming.tail_source import NumberedReader, TailReader


def line(i):
    return json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "timestamp": "2025-01-01T00:00:00Z", "message": {"id": f"m{i}", "role": "user", "content": f"text {i}"}}) + "\n"


def test_offsets(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("one\ntwo\nthr")
    reader = TailReader({"path": str(tmp_path)})
    start = reader.initialOffset()

    def step(start):
        end = reader.latestOffset()
        return end, [r[1:] for p in reader.partitions(start, end) for r in reader.read(p)]

    at, rows = step(start)
    assert rows == [(0, 0, "one"), (0, 4, "two")]
    f.open("a").write("ee\nfour\n")
    at, rows = step(at)
    assert rows == [(0, 8, "three"), (0, 14, "four")]
    again = TailReader({"path": str(tmp_path)})
    again.state = json.loads(at["files"])
    assert again.partitions(at, again.latestOffset()) == []
    (tmp_path / "wf_1").mkdir()
    (tmp_path / "wf_1/agent-x.jsonl").write_text("new\n")
    at, rows = step(at)
    assert rows == [(0, 0, "new")]
    f.write_text("reset\n")
    at, rows = step(at)
    assert rows == [(1, 0, "reset")]
    late = TailReader({"path": str(tmp_path), "startingoffsets": "latest"})
    assert late.partitions(late.initialOffset(), late.latestOffset()) == []


def test_stream_to_messages(spark, tmp_path):
    logs, out = tmp_path / "projects/p", str(tmp_path / "messages")
    os.makedirs(logs)
    (logs / "s.jsonl").write_text(line(1) + line(2)[:20])

    def run():
        q = jobs.tail(spark, str(tmp_path / "projects")).writeStream.foreachBatch(jobs.extract_messages(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.content for r in spark.read.parquet(out).collect())

    assert run() == ["text 1"]
    (logs / "s.jsonl").open("a").write(line(2)[20:] + line(1))
    assert run() == ["text 1", "text 2"]
    rows = spark.read.parquet(out)
    jobs.store_messages(out)(rows.drop("id"), 0)
    assert spark.read.parquet(out).count() == 2


def test_idle_files_are_not_opened(tmp_path, monkeypatch):
    for k in range(30):
        (tmp_path / f"{k}.jsonl").write_text("a\n")
    for reader in (TailReader({"path": str(tmp_path)}), NumberedReader({"path": str(tmp_path), "statepath": str(tmp_path / "state")})):
        start = reader.latestOffset()
        opened = []
        monkeypatch.setattr(type(reader), "_read", staticmethod(lambda system, path, a, b, opened=opened: opened.append(path) or open(path, "rb").read()[a:b]))
        assert reader.latestOffset() == start and opened == []
        (tmp_path / "7.jsonl").open("a").write("b\n")
        end = reader.latestOffset()
        assert {os.path.basename(p) for p in opened if "state" not in p} == {"7.jsonl"}
        assert [(os.path.basename(r.path), r.start, r.end) for r in reader.partitions(start, end)] == [("7.jsonl", 2, 4)]
        monkeypatch.undo()
        (tmp_path / "7.jsonl").write_text("a\n")


def test_steps(tmp_path, monkeypatch):
    """Offsets are numbers; a reader that starts again goes on, with the generations that files had, and can give any step again."""
    from transcript_lake.streaming import tail_source

    monkeypatch.setattr(tail_source, "SNAPSHOT_EVERY", 2)
    logs, options = tmp_path / "logs", {"path": str(tmp_path / "logs"), "statepath": str(tmp_path / "state"), "maxbytesperfile": "8"}
    logs.mkdir()
    f = logs / "a.jsonl"
    f.write_text("one\ntwo\nthree\nfour\nto")
    reader = NumberedReader(options)
    start = reader.initialOffset()
    assert start == {"step": 0}
    rows = lambda a, b, r=reader: [x[1:] for p in r.partitions(a, b) for x in r.read(p)]
    seen, at = [], start
    for _ in range(4):
        end = reader.latestOffset()
        seen += rows(at, end)
        at = end
    assert seen == [(0, 0, "one"), (0, 4, "two"), (0, 8, "three"), (0, 14, "four")]
    f.write_text("reset\n")
    reset = reader.latestOffset()
    assert rows(at, reset) == [(1, 0, "reset")]
    again = NumberedReader(options)
    f.open("a").write("on\n")
    later = again.latestOffset()
    assert [x[1:] for p in again.partitions(reset, later) for x in again.read(p)] == [(1, 6, "on")]
    assert rows(at, reset, again) == [(1, 0, "reset")] and again.latestOffset() == later
    fresh = {**options, "statepath": str(tmp_path / "other"), "startingoffsets": "latest"}
    late = NumberedReader(fresh)
    assert late.partitions(late.initialOffset(), late.latestOffset()) == []


def test_a_query_goes_on_after_a_reset(spark, tmp_path):
    """A file that is rewritten has a new generation also for a query that starts again."""
    logs, out = tmp_path / "logs", str(tmp_path / "lines")
    logs.mkdir()
    (logs / "s.jsonl").write_text("a\nb\n")

    def run():
        q = jobs.land(jobs.tail(spark, str(logs), statepath=str(tmp_path / "state")), out, str(tmp_path / "check"), "0 seconds")
        q.processAllAvailable()
        q.stop()
        return sorted((r.generation, r.line) for r in jobs.current(spark.read.parquet(out)).collect())

    assert run() == [(0, "a"), (0, "b")]
    (logs / "s.jsonl").write_text("c\n")
    assert run() == [(1, "c")]
    (logs / "s.jsonl").open("a").write("d\n")
    assert run() == [(1, "c"), (1, "d")]


def test_fragments_as_they_come(spark, put, tmp_path):
    """Messages of a fragment store come once each, as entries with the parts that the batch reader gives them."""
    seen, store = [], str(tmp_path / "oc")
    message = lambda k: put(f"oc/message/ses/msg_{k}.json", {"id": f"m{k}", "sessionID": "ses", "role": "assistant", "time": {"created": 1735776000000 + k}, "tokens": {"input": k, "output": 1}})

    def run():
        rows = jobs.new_fragments(spark, store, opencode.MESSAGE)
        q = rows.writeStream.foreachBatch(jobs.fragment_entries(store, lambda d: seen.extend(d.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.message_id, [(p.type, p.text, p.name, p.output) for p in r.parts], r.tokens.input) for r in seen)

    put("oc/part/m1/b.json", {"id": "b", "messageID": "m1", "type": "tool", "callID": "c", "tool": "grep", "state": {"status": "completed", "output": "found"}})
    put("oc/part/m1/a.json", {"id": "a", "messageID": "m1", "type": "text", "text": "hello"})
    message(1)
    assert run() == [("m1", [("text", "hello", None, None), ("tool_call", None, "grep", "found")], 1)]
    put("oc/part/m2/a.json", {"id": "a2", "messageID": "m2", "type": "text", "text": "more"})
    message(2)
    message(3)  # without parts: no entry
    got = run()
    _, messages, parts = opencode.store(spark, store)
    batch = opencode.entries(messages, parts).collect()
    assert got == sorted((r.message_id, [(p.type, p.text, p.name, p.output) for p in r.parts], r.tokens.input) for r in batch)
    assert [x[0] for x in got] == ["m1", "m2"]
