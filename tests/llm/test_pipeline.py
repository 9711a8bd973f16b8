"""The pipeline's stages against plain forms, each on its own input."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def documents(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words(rng.randrange(12, 200))), "en", f"s{i % 4}"))
    base = words(100)
    for i in range(120, 150):
        w = list(base)
        w[rng.randrange(100)] = "edited"
        rows.append((i, " ".join(w), "en", "s0"))
    rows += [(200, "too short", "en", "s1"), (201, "a b c d e " * 9, "en", "s1"), (202, "mail me at kim@mail.example.com " + " ".join(words(40)), "de", None), (203, None, None, None), (204, " ".join(base), "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = documents(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    seen = docs
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, None)
        out.write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert seen.columns == docs.columns
        kept[name] = Counter(r.doc_id for r in seen.select("doc_id").collect())
    assert set(kept["quality rules"]) == {*range(150), 202, 204}
    assert set(kept["near duplicates"]) == {*range(121), 202}
    assert kept["personal data"] == kept["near duplicates"]
    assert "kim@" not in " ".join(r.text for r in spark.read.parquet(f"{tmp_path}/2").collect())
    assert set(kept["mixing"]) <= set(kept["personal data"]) and max(kept["mixing"].values()) <= 3
    assert set(kept["packing"]) == set(kept["mixing"])
    assert corpus_pipeline.STAGES[1][1](spark, docs.union(docs.limit(3)), None).count() == corpus_pipeline.STAGES[1][1](spark, docs, None).count()
    assert all(stage(spark, docs.limit(0), None).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_rows_that_share_an_id(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(w)), (5, "clean words of another kind stand in this one text here"), (5, " ".join(w)), (9, " ".join([*w, "x"])), (None, " ".join(w)), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, x, "mark", 1) for i, x in rows], "doc_id long, text string, kept_id string, component long")
    got = sorted(map(repr, map(tuple, corpus_pipeline.keep_one_of_near(spark, docs, None).select("doc_id", "text").collect())))
    assert got == sorted(map(repr, [rows[0], rows[1], rows[4], rows[5], rows[6]]))
