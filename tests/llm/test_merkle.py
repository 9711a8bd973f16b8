"""The Merkle manifest against brute force: trees of several layers, ties, nulls, no rows."""

import hashlib
import zlib

import pytest

from transcript_lake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(levels, k):
    out = []
    for nodes in levels[:-1]:
        out.append((k % 16, nodes[k // 16 * 16 : k // 16 * 16 + 16]))
        k //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r[:5])
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {s: tree([leaf(r) for r in sorted(by[s], key=order)]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for k, r in enumerate(sorted(by[s], key=order)):
            at = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                at = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            others = []
            for place, nodes in path(trees[s], k) + path(top, i):
                others += nodes[:place] + nodes[place + 1 :]
                at = h(*nodes[:place], at, *nodes[place + 1 :])
            out.append((r[0], s, leaf(r), trees[s][-1][0], top[-1][0], h(*others), at, at == top[-1][0]))
    return sorted(out, key=repr)


def rows():
    made = [(k, "hot", "en", k * 7, f"Text {k} É") for k in range(700)] + [(k, f"s{k % 40}", None, None, "ABC é" if k % 3 else "") for k in range(300)]
    made += [(5, None, "en", 1, None), (None, "hot", "en", 2, "none"), (None, "hot", "en", 2, "NONE"), (7, "hot", "en", 3, "same ID"), (7, "hot", "en", 3, "same ID"), (9, "", "x", 1, "empty source"), (11, "日本", "ja", 2, "日本"), (12, "lone", "en", 1, "x" * 300_000)]
    return [(*r, "clash", "clash") for r in made]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_against_brute_force(spark, levels):
    """With superblocks of one level, the hot source has three layers and the sources two."""
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    found = merkle.manifest(docs, levels=levels)
    got = found.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = brute(rows())
    assert sorted(map(tuple, got), key=repr) == want
    assert any(not r[-1] for r in want) and sum(r[-1] for r in want) > len(want) / 2


def test_a_proof_stands_alone(spark):
    """A row's leaf and proof fold to the root without any other row, and not with a changed leaf."""
    found = merkle.manifest(spark.createDataFrame(rows(), SCHEMA), levels=1).where("verified").collect()
    for r in found[::37]:
        path = [s.asDict() for s in r.proof]
        assert merkle.folded(r.leaf, path) == r.root
        assert merkle.folded(h(r.leaf), path) != r.root


def test_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none).collect() == []
    one = merkle.manifest(spark.createDataFrame(rows()[-1:], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == leaf(rows()[-1][:5]) and one.proof == [] and one.proof_sha256 == h()
