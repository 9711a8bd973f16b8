"""The Pitman-Yor model: base score and counts by brute force, scores against a plain Gibbs sampler customer by customer."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcript_lake.llm import pitman_yor as hpy

SMALL = {"block_tokens": 60, "bucket_pairs": 40, "chunk_tokens": 100, "split_tokens": 40}


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def texts(n=160):
    """Sentences of a small grammar: what follows depends on the word before."""
    pick = random.Random(3)
    after = {None: "the a one".split(), "the": "red blue cat dog".split(), "a": "cat dog red".split(), "one": "cat bird".split(), "red": "cat dog".split(), "blue": "bird dog".split()}
    verbs, ends = "sees eats likes".split(), "x y z".split()
    out = []
    for _ in range(n):
        words = []
        for _ in range(pick.randint(1, 4)):
            w = None
            while True:
                w = pick.choice(after.get(w, verbs))
                words.append(w)
                if w in verbs:
                    words += [pick.choice("the a".split()), pick.choice("cat dog bird".split()), pick.choice(ends)]
                    break
        out.append(" ".join(words))
    return out


class Plain:
    """Teh's sampler as it is written: every customer leaves and comes back."""

    def __init__(self, docs, discounts, strength, seed):
        self.d, self.s, self.rng = discounts, strength, random.Random(seed)
        self.seats = [defaultdict(lambda: defaultdict(list)), defaultdict(list)]
        self.pairs = [(u, w) for t in docs for u, w in zip([None, *t[:-1]], t, strict=True)]
        self.known = len({w for _, w in self.pairs})
        for u, w in self.pairs:
            self.enter(u, w)

    def root(self, w):
        c = sum(map(sum, self.seats[1].values()))
        t = sum(map(len, self.seats[1].values()))
        mine = self.seats[1].get(w, [])
        return (sum(mine) - self.d[0] * len(mine) + (self.s + self.d[0] * t) / (self.known + 1)) / (self.s + c)

    def p(self, u, w):
        room = self.seats[0].get(u, {})
        c, t, mine = sum(map(sum, room.values())), sum(map(len, room.values())), room.get(w, [])
        return (sum(mine) - self.d[1] * len(mine) + (self.s + self.d[1] * t) * self.root(w)) / (self.s + c)

    def sit(self, tables, open_):
        """Sits down; whether a table opens."""
        weights = [x - open_[1] for x in tables] + [open_[0]]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def enter(self, u, w):
        room = self.seats[0][u]
        t = sum(map(len, room.values()))
        if self.sit(room[w], ((self.s + self.d[1] * t) * self.root(w), self.d[1])):
            t = sum(map(len, self.seats[1].values()))
            self.sit(self.seats[1][w], ((self.s + self.d[0] * t) / (self.known + 1), self.d[0]))

    def leave(self, tables):
        k = self.rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def sweep(self):
        for u, w in self.pairs:
            if self.leave(self.seats[0][u][w]):
                self.leave(self.seats[1][w])
            self.enter(u, w)


@pytest.fixture(scope="module")
def scored(spark):
    docs = [*enumerate(texts()), (None, "the cat"), (900, None), (901, ""), (902, " \n"), (903, "The CAT sees the ünknown wörd É"), (904, "red " * 300), (7, "the cat sees the dog x"), (7, "the cat sees the dog x")]
    rows = spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, score string, block int").repartition(3)
    return docs, hpy.score(rows, **SMALL).collect()


def test_base(scored):
    docs, got = scored
    train = Counter(w for i, x in docs if not held(i) for w in tokens(x))
    n, v = train.total(), len(train)
    want = sorted((str(i), held(i), len(t), sum(train[w] > 0 for w in t), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, x in docs for t in [tokens(x)])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_like_a_plain_sampler(scored):
    docs, got = scored
    train = [tokens(x) for i, x in docs if not held(i)]
    pairs = Counter((u, w) for t in train for u, w in zip([None, *t[:-1]], t, strict=True))
    words = Counter(w for t in train for w in t)
    many = lambda c, k: sum(x == k for x in c.values())
    plain = Plain(train, [hpy.discounted(many(words, 1), many(words, 2)), hpy.discounted(many(pairs, 1), many(pairs, 2))], hpy.STRENGTH, 1)
    sums, n = defaultdict(float), 0
    asked = {(u, w) for _, x in docs for t in [tokens(x)] for u, w in zip([None, *t[:-1]], t, strict=True)}
    for sweep in range(14):
        plain.sweep()
        if sweep >= 4:
            n += 1
            for u, w in asked:
                sums[u, w] += plain.p(u, w)
    mine = {(str(r.doc_id), r.n_tokens): r.score for r in got}
    want = {(str(i), len(t)): sum(math.log10(sums[u, w] / n) for u, w in zip([None, *t[:-1]], t, strict=True)) for i, x in docs for t in [tokens(x)]}
    apart = [abs(mine[k] - want[k]) / k[1] for k in want]
    assert max(apart) < 0.15 and sum(apart) / len(apart) < 0.02


def test_better_than_words_alone(scored):
    _, got = scored
    out = [r for r in got if r.held_out]
    assert len(out) > 8 and sum(r.score for r in out) > 0.75 * sum(r.base_score for r in out)
    assert sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_probabilities_add_up(spark):
    """Texts of one word, each known one and one unknown: all that can come first, but for the end. What follows the word is
    taken out by texts of the same word twice and three times, and the end's share is that of the empty text."""
    docs = [(i, x) for i, x in enumerate(texts(60)) if not held(i)]
    words = [*sorted({w for _, x in docs for w in tokens(x) if w}), "neverseen"]
    free = (i for i in range(10_000, 10**6) if held(i))
    asked = {(w, n): next(free) for w in words for n in (1, 2, 3)} | {("", 1): next(free)}
    rows = docs + [(i, " ".join([w] * n)) for (w, n), i in asked.items()]
    got = {r.doc_id: r.score for r in hpy.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # p(w w w) / p(w w) = p(w | w), so p(w w) / p(w | w) = p(w | start) p(end | w) = p(w): that must hold
    for w in words:
        one, two, three = (got[asked[w, n]] for n in (1, 2, 3))
        assert two - (three - two) == pytest.approx(one, abs=1e-4)
    # of an unknown word nothing is known to follow: the end has its root's probability, as after any unknown word
    unseen = got[asked["neverseen", 1]]
    assert all(got[asked[w, 1]] > unseen - 1.5 for w in words) and got[asked["", 1]] < -0.5


def test_a_bucket_adds_up():
    """In a restaurant, the dishes' probabilities add up to one under any seating, if the base's do."""
    rng = np.random.default_rng(0)
    customers, base = np.array([5, 1, 0, 900]), np.array([0.5, 0.2, 0.3, 0.4])
    rest, seating = hpy.Restaurants(np.array([0, 0, 0, 1]), customers, np.zeros(2)), hpy.Seating(np.array([5, 900]), 0.6)
    for _ in range(20):
        rest.sweep(rng, seating, base, 1.0)
        assert rest.predict(base, np.array([6, 900]), 0.6, 1.0)[:3].sum() == pytest.approx(1.0)
        assert ((1 <= rest.tables) | (customers == 0)).all() and (rest.tables <= customers).all()


@pytest.mark.parametrize(("customers", "others", "base"), [(2, 1.0, 0.3), (6, 0.8, 0.9), (200, 5.0, 0.4), (300, 2.0, 0.2), (2000, 1.5, 0.05), (3000, 80.0, 0.6)])
def test_tables(customers, others, base):
    """Drawn tables have the mean and spread that all weights give, also beyond EXACT."""
    rng, d, n = np.random.default_rng(customers), 0.7, 4000
    seating = hpy.Seating(np.full(n, customers), d)
    got = seating.draw(rng, np.arange(n), np.full(n, others), np.full(n, base))
    t = np.arange(1, customers + 1)
    weight = hpy.arrangements(d, customers)[customers, 1:] + np.cumsum(np.log((others + d * (t - 1)) * base))
    p = np.exp(weight - weight.max())
    p /= p.sum()
    mean = (p * t).sum()
    spread = math.sqrt((p * (t - mean) ** 2).sum())
    assert got.mean() == pytest.approx(mean, abs=0.1 * spread + 0.02 * mean) and got.std() == pytest.approx(spread, rel=0.1, abs=0.02)


def test_reruns_and_sizes(spark):
    """The base does not depend on how texts are dealt; an empty table has no rows, one without training rows only unknown words."""
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id long, text string")
    pick = lambda rows: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9)) for r in rows)
    assert pick(hpy.score(docs, **SMALL).collect()) == pick(hpy.score(docs.repartition(7)).collect())
    assert hpy.score(docs.limit(0)).collect() == []
    only = [i for i in range(400) if held(i)][:3]
    got = hpy.score(docs.limit(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in only])).alias("doc_id"), "text")).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in got)


def test_packing():
    for x in (np.array([], np.int64), np.array([0, 255, 256, 70_000, 2**40]), np.array([3, 3, 3])):
        assert hpy.opened(hpy.packed(x)).tolist() == x.tolist()
        assert hpy.risen(hpy.rising(np.sort(x))).tolist() == sorted(x.tolist())
    f = np.array([0.5, -1e-30, 3e20], np.float32)
    assert hpy.opened(hpy.packed(f), floats=True).tolist() == f.tolist()
