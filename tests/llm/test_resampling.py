"""Importance resampling against brute force; CRCs of substrings against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from transcript_lake.llm import resampling


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 300_000])
def test_substrings(n):
    data = random.Random(n).randbytes(n)
    prefixes = resampling.prefix_crcs(np.frombuffer(data, np.uint8))
    pick = random.Random(n + 1)
    ends = [sorted((pick.randint(0, n), pick.randint(0, n))) for _ in range(60)]
    starts, ends = np.array(ends).T
    assert resampling.substring_crcs(prefixes, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, target, ngram, buckets, percent, least):
    features = lambda t: [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for w in [words_of(t)] for n in range(1, ngram + 1) for k in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize(("ngram", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 33)])
def test_against_brute_force(spark, ngram, buckets, percent):
    pick = random.Random(5)
    vocabulary = [f"Wörd{k}" if k % 3 else f"w{k}'s" for k in range(60)] + ["日本", "ß", "A1"]
    docs = [(k, " ,".join(pick.choices(vocabulary, k=pick.randint(0, 60)))) for k in range(300)]
    docs += [(None, "one two " * 15), (1000, None), (1001, ""), (1002, "---"), (1003, "A\x00b\tC " * 9), (1004, "long " * 200_000), (1005, "x" * 500_000), (1006, "same words here " * 10), (1006, "same words here " * 10)]
    target = ["Wörd1 wörd2 日本 " * 20, None, "w3's"]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, score string, n int").repartition(4)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(frame, aim, ngram, buckets, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, ngram, buckets, percent, 20)


def test_none(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    few = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.rank for r in resampling.resample(few, none).collect()} == {None}


def test_the_target_is_drawn(spark):
    """Documents like the target, a tenth of all, make most of the draw; the noise lets some others in."""
    rows = [(k, "target words of the kind " * 8 if k % 10 == 0 else "plain other text here now " * 8) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = {r.doc_id for r in resampling.resample(docs, docs.where("doc_id = 0"), percent=8).where("rank is not null").collect()}
    assert len(drawn) == 40 and sum(k % 10 == 0 for k in drawn) >= 30
