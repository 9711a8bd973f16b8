"""The Jaccard join's classes against all pairs, with groups of copies and near copies."""

import random
import re

import numpy as np
import pytest

from transcript_lake.llm import graph, jaccard, slots
from transcript_lake.llm.graph import components
from transcript_lake.llm.shingles import shingle_sets, word_hashes


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [" ".join(words(rng.randrange(1, 90))) for _ in range(60)]
    passage = words(40)
    for size, length, edits in ((130, 150, 9), (40, 60, 3), (9, 700, 30), (60, 24, 2)):
        base = words(length)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(length)] = rng.choice(vocabulary)
            out.append(" ".join(w))
    out += [" ".join(passage + words(rng.randrange(1, 9))) for _ in range(50)]
    out += [out[0]] * 5 + [out[70].upper(), out[70].replace(" ", "\t\n"), "", " \n", None, "one", "One", "one two", "ONE TWO", "two one", "one two three"]
    return [(i, x) for i, x in enumerate(out)]


def brute(rows, k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "similarity"), [(3, (90, 100)), (5, (80, 100))])
def test_classes_match_all_pairs(spark, k, similarity):
    rows = corpus()
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, sig string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, k, similarity).collect()}
    assert got == brute(rows, k, *similarity)


def test_edges_of_the_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (8, None), (None, None), (None, "x")], "doc_id long, text string")
    got = sorted(jaccard.jaccard_classes(docs).collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8), (None, 0, None), (None, 1, None)], key=repr)
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_signatures_meet():
    """Two sets at the threshold always share a signature, whatever is frequent."""
    rng = np.random.default_rng(2)
    for trial in range(400):
        n = int(rng.integers(2, 300))
        levels = rng.integers(0, 40, 1 << 22, dtype=np.uint8) if trial < 2 else levels  # noqa: F821
        signer = jaccard.Signer(levels, (0, 20, 41)[trial % 3], 90, 100)
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(x) - -(-9 * len(x) // 10) + 1))
        y = x[drop:]
        if len(y) == len(x) or 100 * len(y) < 90 * len(x):
            continue
        assert set(signer.sign(x)[0].tolist()) & set(signer.sign(y)[0].tolist())


def test_bitmap_never_loses():
    rng = np.random.default_rng(4)
    signer = jaccard.Signer(np.zeros(1 << 22, np.uint8), 1, 90, 100)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 700)), dtype=np.uint64))
        y = x[rng.random(len(x)) < 0.9]
        if len(y):
            assert int(np.bitwise_count((jaccard.fold(x) ^ jaccard.fold(y)).view(np.uint64)).sum()) <= len(x) - len(y)
            assert jaccard.close(signer.bitmap(x), signer.bitmap(y), len(x) - len(y))


def test_words_of_algebraic_likeness_stay_apart(spark):
    """Thue and Morse's words, whose polynomials agree modulo 2**64 for any odd base, and words that differ far inside."""
    bit = [bin(i).count("1") % 2 for i in range(8192)]
    rows = [(1, "".join("ab"[x] for x in bit)), (2, "".join("ba"[x] for x in bit)), (3, "".join("ab"[x] for x in bit[:250])), (4, "".join("ba"[x] for x in bit[:250]))]
    got = dict(map(tuple, jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    texts = ["a" * n + x for n in (0, 3, 7, 8, 15, 16, 300) for x in "bc"] + ["A" * 300 + "B"]
    hashes = word_hashes(texts)[0].tolist()
    assert len(set(hashes)) == len(texts) - 1 and hashes[-1] == hashes[-3]


def test_rows_of_one_id_keep_the_links_of_both(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(5, " ".join(w)), (5, "another text altogether here"), (7, "another text altogether here"), (9, " ".join([*w, "x"])), (3, "alone here it is")]
    got = sorted(map(tuple, jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_bitmap_of_signatures_keeps_all_shared(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 9, 1, [int(x) for x in rng.integers(-(2**62), 2**62, 50)] + [i // 3 << 40]) for i in range(300)]
    got = jaccard.signatures(spark.createDataFrame(rows, "node long, n long, rare long, sigs array<long>").repartition(5)).collect()
    assert {(r.node, r.sig) for r in got} >= {(i, i // 3 << 40) for i in range(300)} and len(got) < 5000


def test_slots_are_added_up_once_for_many_blobs(monkeypatch):
    """A part's slots are passed over for as many slots as it has, not for each blob of a slice of text."""
    rng = np.random.default_rng(8)
    width, passes, bincount = 1 << slots.PART, [], np.bincount
    blobs = [np.sort(rng.integers(0, 2 * width, 50)).astype(np.uint32) for _ in range(300)]
    monkeypatch.setattr(np, "bincount", lambda *a, **b: passes.append(1) or bincount(*a, **b))
    got = slots.counted(slots.dealt(x, slots.PART + 1) for x in blobs)
    assert len(passes) == 2
    assert (np.concatenate([got[0], got[1]]) == bincount(np.concatenate(blobs), minlength=2 * width)).all()


def test_parts_of_the_sketch_are_counted_by_tasks_of_few_jobs(spark, monkeypatch):
    """As many parts as the sketch of a large table has, and no job for each of them."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "slots_for", lambda n, most: slots.PART + 5)
    monkeypatch.setattr(slots, "slots_for", lambda n, most: slots.PART + 5)
    jobs = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    before = jobs()
    levels, _ = jaccard.sketch(docs, 3)
    bitmap, bits = slots.shared_bits(spark.createDataFrame([([i // 2 << 57],) for i in range(40)], "x array<long>"))
    assert jobs() - before < 20
    counts = np.bincount(np.concatenate(shingle_sets([x or "" for _, x in rows], 3)) >> np.uint64(64 - slots.PART - 5), minlength=1 << slots.PART + 5)
    assert (levels == jaccard.level(counts)).all()
    assert bits == slots.PART + 5 and np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8))).tolist() == [j << 18 for j in range(20)]


def test_hashes():
    texts = ["A b  c\nd", "", "a B c d e", " é日 é日 ", "x"]
    words, first, starts, ends = word_hashes(texts)
    assert first.tolist() == [0, 4, 4, 9, 11, 12]
    assert (words[:4] == words[4:8]).all() and words[9] == words[10] and len(set(words.tolist())) == 7
    assert (ends > starts).all()
    assert [len(s) for s in shingle_sets(texts, 3)] == [2, 0, 3, 1, 1]


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_of_a_path_and_a_star(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_LINKS", small)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(500, 500)]
    rng = random.Random(1)
    rng.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
