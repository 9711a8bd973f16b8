"""One entry point for the usage of all runtimes."""

import json
from datetime import datetime

import pytest
from pyspark.sql import GroupedData

from transcript_lake.operators.dedup import dedup
from transcript_lake.plans.testdata import write_logs
from transcript_lake.sources import opencode
from transcript_lake.sources.line_source import FragmentReader
from transcript_lake.sources.usage import usage_of


def said(message, ts, n, request="r"):
    return {"type": "assistant", "sessionId": "s", "requestId": request, "timestamp": ts, "message": {"id": message, "model": "m", "usage": {"input_tokens": n, "output_tokens": 1}}}


@pytest.fixture
def stores(put, tmp_path):
    put("claude/p/b.jsonl", said("m1", "2025-01-02T00:00:00Z", 10))
    put("claude/p/a.jsonl", said("m2", "2025-01-01T00:00:00Z", 3), "{torn", said("m1", "2025-01-02T00:00:00Z", 10))
    put("pi/x.jsonl", {"type": "session", "id": "tree", "cwd": "/w"}, {"type": "message", "id": "1", "message": {"role": "assistant", "model": "m", "usage": {"input": 7, "output": 2}}})
    put("oc/message/ses/msg_1.json", {"id": "m1", "sessionID": "ses", "role": "assistant", "providerID": "v", "modelID": "m", "tokens": {"input": 10, "output": 1, "cache": {}}, "time": {"created": 1735776000000}})
    return {"claude": str(tmp_path / "claude"), "pi": str(tmp_path / "pi"), "opencode": str(tmp_path / "oc"), "codex": str(tmp_path / "not/there")}


def test_all_stores_in_order(spark, stores):
    rows = usage_of(spark, stores).orderBy("arrival").collect()
    assert [(r.provider, r.file_path.rsplit("/", 1)[1], r.line_no, r.message_id) for r in rows] == [("claude", "a.jsonl", 0, "m2"), ("claude", "a.jsonl", 2, "m1"), ("claude", "b.jsonl", 0, "m1"), ("opencode", "msg_1.json", 0, "m1"), ("pi", "x.jsonl", 1, "")]


def test_replays_across_files_and_runtimes(spark, stores):
    """Of m1, in two files of one runtime, the row that is scanned first stays; another runtime's has a request of its own."""
    got = dedup(usage_of(spark, stores).repartition(5)).orderBy("position").collect()
    assert [(r.provider, r.file_path.rsplit("/", 1)[1], r.message_id) for r in got] == [("claude", "a.jsonl", "m2"), ("claude", "a.jsonl", "m1"), ("opencode", "msg_1.json", "m1"), ("pi", "x.jsonl", "")]


def test_filters(spark, stores):
    assert {r.provider for r in usage_of(spark, stores, ["pi", "codex"]).collect()} == {"pi"}
    late = usage_of(spark, stores, after=datetime(2025, 1, 1, 12)).collect()
    assert sorted((r.provider, r.message_id) for r in late) == [("claude", "m1"), ("claude", "m1"), ("opencode", "m1"), ("pi", "")]
    assert usage_of(spark, {}).count() == usage_of(spark, {"codex": stores["codex"]}).count() == 0
    for wrong in (lambda: usage_of(spark, stores, ["cursor"]), lambda: usage_of(spark, {"other": "/x"})):
        with pytest.raises(ValueError, match="unknown"):
            wrong()


def test_a_message_file_is_json(tmp_path, spark, stores):
    """A fragment that cannot be read gives no row and stops nothing."""
    (tmp_path / "oc/message/ses/msg_2.json").write_text("{torn")
    assert usage_of(spark, stores, ["opencode"]).count() == 1
    assert json.loads((tmp_path / "oc/message/ses/msg_1.json").read_text())["id"] == "m1"


def test_many_fragments_take_few_tasks_and_no_list_in_the_driver(tmp_path, spark):
    """A file a message is neither a task's worth of overhead nor an entry of a list in the driver; deeper folders and flat files count, too."""
    for k in range(600):
        file = tmp_path / f"oc/message/s{k % 300}/{'deep/' if k % 7 == 0 else ''}m{k}.json"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps({"id": f"m{k}", "sessionID": f"s{k % 300}"}, indent=1))
    (tmp_path / "oc/message/flat.json").write_bytes(b'\xef\xbb\xbf{"id": "flat"}')
    (tmp_path / "oc/message/other.txt").write_text('{"id": "no"}')
    dealt = FragmentReader({"path": str(tmp_path / "oc/message")}).partitions()
    assert len(dealt) == 31 and sum(len(p.folders) for p in dealt) == 300 and sum(len(p.files) for p in dealt) == 1
    found = opencode.fragments(spark, str(tmp_path / "oc"), "message", opencode.MESSAGE)
    assert sorted(r.id for r in found.select("id").collect()) == sorted([f"m{k}" for k in range(600)] + ["flat"])
    assert opencode.fragments(spark, str(tmp_path / "oc"), "none", opencode.PART).count() == 0


def test_logs_are_written_without_a_group_a_file(tmp_path, spark, monkeypatch):
    """Files of one line and of many batches, in order; written again, they are the same."""
    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rows = [(f"d{k}/{k}.json", 0, "é") for k in range(50)] + [("log.jsonl", n, f"line {n}") for n in range(25_000)]
    lines = spark.createDataFrame(rows, "path string, line_no long, line string").repartition(7)
    for _ in range(2):
        write_logs(lines, str(tmp_path))
        assert (tmp_path / "log.jsonl").read_text().splitlines() == [f"line {n}" for n in range(25_000)]
        assert all((tmp_path / f"d{k}/{k}.json").read_text() == "é\n" for k in range(50))
    assert len(list(tmp_path.rglob("*.json*"))) == 51
