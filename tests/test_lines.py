"""Lines of files read by ranges of bytes."""

import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from transcript_lake.plans import queries
from transcript_lake.sources import jsonl
from transcript_lake.sources.line_source import LineReader, cut_lines


def whole(path):
    data = path.read_bytes().decode("utf-8", "replace")
    lines = data.split("\n")
    return lines[:-1] if not lines[-1] else lines


@pytest.mark.parametrize("split", [40, 1000, 10**9])
def test_ranges(spark, tmp_path, split):
    """Whatever the ranges, lines and numbers are those of the whole file."""
    pick = random.Random(4)
    files = {"a.jsonl": "one\ntwo\n\nthree", "p/b.jsonl": "\n\nx\r\n" + "y" * 150 + "\n", "p/empty.jsonl": "", "p/q/c.jsonl": "".join("é日" * pick.randint(0, 40) + "\n" for _ in range(12)), "torn.jsonl": "no end", "end.jsonl": "\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bytes.jsonl").write_bytes(b"\xff\xfe\nok\n")
    (tmp_path / "other.txt").write_text("no\n")
    rows = jsonl.raw_lines(spark, str(tmp_path), split_bytes=split).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        got.setdefault(r.file_path.split(str(tmp_path))[1][1:], []).append((r.line_no, r.line))
    want = {n: list(enumerate(whole(tmp_path / n))) for n in [*files, "bytes.jsonl"]}
    assert got == {n: x for n, x in want.items() if x}
    assert all(r.modified_at is not None and r.file_path.startswith("file://") for r in rows)


def test_a_large_file_takes_many_tasks(spark, tmp_path):
    line = "z" * 99_999 + "\n"
    (tmp_path / "big.jsonl").write_text(line * 400)
    rows = jsonl.raw_lines(spark, str(tmp_path), split_bytes=4_000_000)
    assert rows.select(F.spark_partition_id()).distinct().count() == 10
    assert [r.line_no for r in rows.select("line_no").orderBy("line_no").collect()] == list(range(400))
    assert rows.where(F.length("line") != 99_999).count() == 0


def test_small_files_share_a_task(tmp_path):
    for k in range(50):
        (tmp_path / f"{k}.jsonl").write_text("a\n")
    assert len(LineReader({"path": str(tmp_path)}, False).partitions()) == 1


def test_a_file_that_grows_between_the_passes(tmp_path):
    """Counts of a range hold whatever is appended later."""
    f = tmp_path / "a.jsonl"
    f.write_text("ab\n" * 10)
    read = lambda counts: [b for p in LineReader({"path": str(tmp_path), "splitbytes": "7"}, counts).partitions() for b in LineReader({"path": str(tmp_path), "splitbytes": "7"}, counts).read(p)]
    before = {b["range_start"][0].as_py(): b["lines"][0].as_py() for b in read(True)}
    f.open("a").write("cd\n" * 10)
    lines = {}
    for b in read(False):
        for start, line in zip(b["range_start"].to_pylist(), b["line"].to_pylist(), strict=True):
            lines.setdefault(start, []).append(line)
    assert all(len(lines.get(start, [])) == n for start, n in before.items())


def test_heads(spark, tmp_path, monkeypatch):
    """The first lines of each file, and hardly more bytes than they have."""
    (tmp_path / "long.jsonl").write_text("".join(f"line {k}\n" for k in range(200_000)))
    (tmp_path / "short.jsonl").write_text("a\nb")
    rows = jsonl.head_lines(spark, str(tmp_path), 100).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        got.setdefault(os.path.basename(r.file_path), []).append(r.line)
    assert got == {"long.jsonl": [f"line {k}" for k in range(100)], "short.jsonl": ["a", "b"]}
    reader, taken = LineReader({"path": str(tmp_path), "headlines": "100"}, False), []
    for p in reader.partitions():
        for r in p.ranges:
            data = open(r.path, "rb").read()
            list(reader.lines(lambda at, n, data=data: taken.append(n) or data[at : at + n], r, len(data), ""))
    assert sum(taken) <= 200_000


def test_nothing(spark, tmp_path):
    assert jsonl.raw_lines(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "e.jsonl").write_text("")
    assert jsonl.raw_lines(spark, str(tmp_path)).collect() == []
    one = str(tmp_path / "one.jsonl")
    open(one, "w").write("x\n")
    assert [r.line for r in jsonl.raw_lines(spark, one).collect()] == ["x"]


def test_cut_lines():
    assert cut_lines(b"a\n\nb").to_pylist() == ["a", "", "b"]
    assert cut_lines(b"\xff\n").to_pylist() == ["�"]


def test_small_ranges_share_tasks_and_are_read_once(tmp_path):
    """Neither a task a range nor the bytes of many ranges for each: what is read stays near the file's size."""
    text = "".join("x" * (k % 90) + "\n" for k in range(40_000))
    (tmp_path / "a.jsonl").write_text(text)
    reader, taken, lines = LineReader({"path": str(tmp_path), "splitbytes": "8192"}, False), [], []
    parts = reader.partitions()
    assert len(parts) <= 128 < sum(len(p.ranges) for p in parts)
    data = text.encode()
    for p in parts:
        for r in p.ranges:
            for b in reader.lines(lambda at, n: taken.append(n) or data[at : at + n], r, len(data), ""):
                lines += b["line"].to_pylist()
    assert "".join(f"{x}\n" for x in lines) == text
    assert sum(taken) < 2 * len(data)


@pytest.mark.parametrize("split", [7, 10**9])
def test_files_of_one_log_are_numbered_through(spark, tmp_path, split):
    files = {"a/1.jsonl": "one\ntwo\n", "a/2.jsonl": "", "a/3.jsonl": "three\n\nfour", "b/1.jsonl": "x\n", "b/9.jsonl": "y" * 30 + "\nz\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    log = F.regexp_extract("file_path", "/([ab])/[0-9]", 1)
    rows = jsonl.raw_lines(spark, str(tmp_path), split_bytes=split, log=log).withColumn("log", log).collect()
    assert sorted((r.log, r.line_no, r.line) for r in rows) == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three"), ("a", 3, ""), ("a", 4, "four"), ("b", 0, "x"), ("b", 1, "y" * 30), ("b", 2, "z")]


def test_logs_of_roles_against_sql(spark, tmp_path):
    """No role, roles that no folder could be called, and nulls last, as in SQL; many files a role."""
    turns = [(c, t, role, None if t == 3 else f"{role} {c}\n{t}") for c in [None, *range(40)] for t in (None, 2, 3) for role in (None, "", "user", "a/b%2F+ =é")]
    turns += [(5, 3, "user", x) for x in ("", "zz", "Z")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.raw_log_lines(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(queries.ORACLES["raw_log_lines"]).fetchall()
    assert Counter(map(tuple, got)) == Counter(want)
