"""Live blocks against the batch operator."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from transcript_lake.functions import usage
from transcript_lake.operators import blocks
from transcript_lake.streaming import jobs
from transcript_lake.streaming.live_blocks import LiveBlocks, watch_blocks

COLUMNS = ["k", "start_ts", "end_ts", "first_ts", "last_ts", "entries", "total_tokens", "non_cache_tokens", "is_gap"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp, input long, cost double").selectExpr("*", *[f"0L as {c}" for c in usage.CLASSES if c != "input"], "concat('m', input % 3) as model")


def made(seed, n):
    rng, at, out = random.Random(seed), datetime(2025, 1, 1), []
    for _ in range(n):
        at += timedelta(minutes=rng.choice([0, 1, 20, 60, 90, 400]))
        out.append((rng.choice(["a", "b", None]), at - timedelta(minutes=rng.choice([0, 0, 45])), rng.randrange(100), 0.25))
    return out


def plain(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_live_equals_batch(spark, tmp_path):
    """After each batch, also one done twice, closed and live blocks are those of all rows."""
    rows = made(3, 120)
    live = LiveBlocks(str(tmp_path), ["k"], 2.5, keep_hours=8, every=3)
    for number in range(8):
        batch = frame(spark, rows[number * 15 : number * 15 + 15])
        live.add(batch, number)
        if number in (1, 2, 5):
            live.add(batch, number)
        if number in (1, 5, 6, 7):
            so_far = rows[: number * 15 + 15]
            now = so_far[-1][1] + timedelta(minutes=10)
            whole, found = blocks.block_report(frame(spark, so_far), ["k"], 2.5, now), live.report(spark, number, now)
            old = live.closed(spark, number)
            both = found.select(*COLUMNS) if old is None else found.select(*COLUMNS).unionByName(old.select(*COLUMNS))
            assert plain(both) == plain(whole)
            active = lambda d: sorted(((r.k, r.tokens_per_minute, r.cost_per_hour, r.projected_tokens, r.models) for r in d.where("is_active").collect()), key=repr)
            assert active(found) == active(whole)
    # what a report reads does not grow: the kept cells begin at the last block before the horizon
    all_hours = (max(r[1] for r in rows) - min(r[1] for r in rows)) / timedelta(hours=1)
    assert live.kept(spark, 7).agg(F.max("hour") - F.min("hour")).first()[0] < blocks.MICROS * all_hours / 2 and old.count() > 10


def test_a_stream_in_batches(spark, tmp_path):
    """Replays go, and the active block is that of all that has come."""
    seen, now = [], datetime(2025, 1, 1, 3)
    tick = watch_blocks(str(tmp_path / "live"), lambda d: seen.append(d.collect()), now=lambda: now)
    (tmp_path / "in").mkdir()
    line = lambda i, m, n: f'{{"message_id": "{m}", "request_id": "r", "ts": "2025-01-01T02:{i:02}:00Z", "input": {n}}}\n'

    def run():
        rows = spark.readStream.schema("message_id string, request_id string, ts timestamp, input long").json(str(tmp_path / "in"))
        rows = rows.selectExpr("*", "'f' as file_path", "0L as line_no", *[f"0L as {c}" for c in usage.CLASSES if c != "input"], "'m' as model", "0.0D as cost")
        q = jobs.streaming_dedup(rows).writeStream.foreachBatch(tick).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return seen[-1]

    (tmp_path / "in/1.json").write_text(line(0, "a", 10) + line(1, "b", 20) + line(1, "a", 10))
    assert [(r.entries, r.total_tokens) for r in run()] == [(2, 30)]
    (tmp_path / "in/2.json").write_text(line(5, "b", 20) + line(9, "c", 40))
    (got,) = run()
    assert (got.entries, got.total_tokens, got.start_ts, got.projected_tokens) == (3, 70, datetime(2025, 1, 1, 2), round(70 + 70 / 9 * 240))
