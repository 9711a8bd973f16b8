"""Quality rules and mixing: SQL on the driver's tables, edges on small ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from transcript_lake.llm import common, mixing, rules
from transcript_lake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


def repeated(words, k=5):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(k)})


def test_rules(spark):
    texts = ["a b c d e " * 3, "a b c d e f g h i j k l m", None, "", "x\nx\n\n y\nx ", "a a a a a a", "a a a a a", "p q r s t u p q r s t v w p q r s t", "1 # $ 日本 " * 4]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "s", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(words), len("".join(words)), repeated(words)), t
        assert got[i].base_failed == (len(words) < 10 or 100 * repeated(words) > 20 * len(words))
    assert got[4].n_dup_lines == 1 and got[8].n_symbols == 8
    assert rules.judge(docs.limit(0)).count() == 0


def test_hosts(spark):
    """A host whose documents mostly fail takes its clean ones along; others keep theirs."""
    rows = [("bad", i < 90) for i in range(100)] + [(f"h{k}", i < 5) for k in range(20) for i in range(100)] + [("tiny", True)]
    ruled = spark.createDataFrame(rows, "_host string, base_failed boolean")
    assert [r._host for r in rules.host_verdicts(ruled).collect()] == ["bad"]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_join_keeps_all_rows_either_way(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    left = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)))
    right = spark.createDataFrame([("hot", 1), ("k7", 2)], "k string, v int")
    got = common.joined(left, right, "k").collect()
    assert len(got) == 1000 and sum(r.v == 1 for r in got) == 334 and sum(r.v == 2 for r in got) == sum(i % 3 != 0 and i % 50 == 7 for i in range(1000))


def test_mix(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}" if i < 400 else "big", "x") for i in range(900)] + [(1000, None, None, "x"), (1001, "a b", None, "x"), (None, "c d e", "s1", "x"), (5, "w " * 6, "s0", "x"), (5, "w " * 6, "s0", "x"), (1002, "", "zero", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    targets = {(r.source_size, r.target) for r in got}
    assert sum(t for _, t in targets) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for s, t in targets)
    taken = {}
    for r in got:
        source = (r.source_size, r.target)
        taken[source] = taken.get(source, 0) + r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s, t] - t) <= 7 for s, t in targets)
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    assert abs(out.select(F.sum(F.regexp_count("text", F.lit(common.WORD)))).first()[0] - sum(taken.values())) <= 12
    assert mixing.mix(docs.limit(0)).count() == mixing.repeat(docs.limit(0)).count() == 0


def test_running_start(spark):
    rows = spark.createDataFrame([(i % 17, i) for i in range(500)], "k long, v long").repartition(6)
    got = common.running_start(rows, [F.col("k"), F.col("v")], F.col("v"), "start").orderBy("k", "v").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.v


def test_columns_of_the_caller_stay(spark):
    names = ["words", "lines", "host", "bad", "host_key", "against", "order", "size", "copies", "copy", "source_key", "whole", "last", "part", "own", "first", "total", "salt", "_words", "_host", "_order"]
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven " + str(i), f"s{i % 3}", *range(len(names))) for i in range(9)], f"doc_id long, text string, source string, {', '.join(f'{n} long' for n in names)}")
    for out in (rules.judge(docs), mixing.repeat(docs)):
        rows = out.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(names)))]
    assert mixing.repeat(docs).columns == docs.columns
