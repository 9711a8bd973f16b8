"""The message store against all messages at once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from transcript_lake.streaming import jobs
from transcript_lake.streaming.message_store import MessageStore, extract

SCHEMA = "session_id string, message_id string, role string, ts timestamp, seq bigint, content string"


def rows(seed, n):
    pick = random.Random(seed)
    return [(f"s{pick.randrange(6)}", f"m{pick.randrange(n)}", pick.choice(["user", "assistant", "system"]), None, k, f"text {k}") for k in range(n)]


@pytest.mark.parametrize("every", [2, 100])
def test_like_all_at_once(spark, tmp_path, every):
    """Each id once, by its first row; counts as those of the table; a batch done twice changes nothing."""
    made = rows(1, 90)
    store = MessageStore(str(tmp_path), buckets=4, every=every)
    for number in range(3):
        batch = spark.createDataFrame(made[number * 30 : number * 30 + 30], SCHEMA)
        for _ in range(1 + (number == 1)):
            store.add(batch, number)
    first = {}
    for r in made:
        first.setdefault((r[0], r[1]), r)
    got = sorted((r.session_id, r.message_id, r.content) for r in store.messages(spark, 2).collect())
    assert got == sorted((r[0], r[1], r[5]) for r in first.values())
    count = lambda s, role=None: sum(r[0] == s and role in (None, r[2]) for r in first.values())
    last = {s: max((r for r in first.values() if r[0] == s), key=lambda r: r[4]) for s in {r[0] for r in made}}
    progress = sorted((r.session_id, r.total, r.user, r.assistant, r.last_seq, r.last_message_id) for r in store.progress(spark, 2).collect())
    assert progress == sorted((s, count(s), count(s, "user"), count(s, "assistant"), r[4], r[1]) for s, r in last.items())


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    store = MessageStore(str(tmp_path), buckets=64)
    store.add(spark.createDataFrame(rows(2, 60), SCHEMA), 0)
    one = spark.createDataFrame([("s1", "new", "user", None, 500, "x")], SCHEMA)
    bucket = one.select(F.pmod(F.xxhash64("session_id"), F.lit(64))).first()[0]
    for path in tmp_path.glob("*/batch=0/bucket=*"):
        if path.name != f"bucket={bucket}":  # any read of these would fail
            for f in path.glob("part*"):
                f.write_bytes(b"broken")
    store.add(one, 1)
    assert [r.id for r in spark.read.schema(SCHEMA + ", id string").parquet(str(tmp_path / "messages/batch=1")).collect()] == ["s1_new"]
    store.add(spark.createDataFrame([], SCHEMA), 2)
    assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "messages/batch=2")).count() == 0


def test_a_stream(spark, tmp_path):
    """Lines that come again after a reset add nothing."""
    logs = tmp_path / "projects/p"
    logs.mkdir(parents=True)
    line = lambda i: json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "message": {"id": f"m{i}", "role": "user", "content": f"text {i}"}}) + "\n"
    store, seen = MessageStore(str(tmp_path / "store"), buckets=2), []

    def run():
        def add(batch, number):
            extract(store)(batch, number)
            seen.append(number)

        q = jobs.tail(spark, str(tmp_path / "projects"), statepath=str(tmp_path / "state")).writeStream.foreachBatch(add).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.content for r in store.messages(spark, seen[-1]).collect()), [(r.total, r.user) for r in store.progress(spark, seen[-1]).collect()]

    (logs / "s.jsonl").write_text(line(1) + line(2))
    assert run() == (["text 1", "text 2"], [(2, 2)])
    (logs / "s.jsonl").write_text(line(1))
    assert run() == (["text 1", "text 2"], [(2, 2)])
    (logs / "s.jsonl").open("a").write(line(3))
    assert run() == (["text 1", "text 2", "text 3"], [(3, 3)])
