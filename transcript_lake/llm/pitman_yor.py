"""Language-model scores of a hierarchical Pitman-Yor process.

A restaurant for each context, the word before; its dishes are the words that follow there. Every table sends one customer to
the root restaurant, which all contexts share as their parent, and whose base is uniform over the words and one unknown word.
Seatings are drawn by Gibbs sampling; a word's probability is the average of what it has under several seatings.

How it is dealt out. Texts become blocks of tokens. Words are counted by ranges of their hashes (chunks), which answer each
block with its words' numbers and counts. Each block sends its distinct pairs of words to buckets, by context; contexts with
very many tokens take several buckets. A bucket holds its restaurants' seating, the root's lies in the chunks, and each sweep
is one exchange: buckets send tables to the chunks, these send back what a word has at the root. Restaurants in different
buckets are sampled at once, each knowing the others' tables as of the last exchange. At last each bucket answers the blocks
with its pairs' probabilities. All that travels are compressed arrays, one for each pair of parts that have to do with each
other, and no part grows with the corpus: their number does."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.binary import slices
from transcript_lake.llm.common import discard, materialise, table
from transcript_lake.llm.shingles import HASHED_CHARS, PRIME, mix, word_hashes

#: One in so many documents is held out.
FOLDS = 10

#: What the base score adds to each count.
SMOOTHING = 0.1

#: Tokens of a block, pairs of a bucket, and tokens of a hash range of words, about.
BLOCK_TOKENS, BUCKET_PAIRS, CHUNK_TOKENS = 2_000_000, 500_000, 1_000_000

#: A context of more tokens is dealt to several buckets; no more than SPLIT_MOST contexts are, those of the most tokens.
SPLIT_TOKENS, SPLIT_MOST = 250_000, 100_000

#: Exchanges between contexts and root; Gibbs passes over all dishes after each but the last; and passes after the last one,
#: after each of which probabilities are taken and averaged.
SWEEPS, MOVES, SAMPLES = 2, 4, 4

#: Customers up to which a dish's tables are drawn by exact weights, the numbers of tables that are weighed one by one beyond,
#: and how many weights are held at once.
EXACT, WINDOW, CELLS = 256, 64, 1_000_000

STRENGTH = 1.0
SEED = 11

#: The end of a text, and the context of its first word.
END = np.uint64(0)

#: Bits of a word's number within its chunk.
LOW = 24


def packed(x: np.ndarray) -> bytes:
    """Numbers that are not negative, or 32-bit floats, compressed by planes of bytes."""
    if x.dtype == np.float32:
        x = x.view(np.uint32)
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def opened(data: bytes, floats: bool = False) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:], max_output_size=1 << 31), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")
    return values.astype(np.uint32).view(np.float32) if floats else values.astype(np.int64)


def rising(x: np.ndarray) -> bytes:
    """Numbers that never fall, as their differences."""
    return packed(np.diff(x, prepend=0))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data))


def runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers (none below 0) begins and ends."""
    edges = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
    return list(zip(edges, [*edges[1:], len(x)], strict=True)) if edges else []


# --- seating ---------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def arrangements(discount: float, most: int) -> np.ndarray:
    """Row c, column t: the logarithm of how much the seatings of c customers at t tables weigh, each table by the product of
    1 - discount, 2 - discount, ... over its later customers (generalised Stirling numbers)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, most + 1):
        out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], np.log(np.maximum(c - 1 - discount * np.arange(1, c + 1), 1e-300)) + out[c - 1, 1 : c + 1])
    return out


def tables_at(y: np.ndarray, customers: np.ndarray, discount: float) -> np.ndarray:
    """The number of tables whose arrangements have their saddle point at 1 - exp(-y); it falls as y rises."""
    return customers * np.expm1(-discount * y) / discount / np.expm1(-y) * np.exp(-(1 - discount) * y)


def one_more(y: np.ndarray, discount: float) -> np.ndarray:
    """The logarithm of what one more table changes in the arrangements' weight at a saddle point, times the tables."""
    return np.log(-np.expm1(-discount * y) / discount)


def bisected(low: np.ndarray, high: np.ndarray, above) -> np.ndarray:
    """Where above, which is true from low up to some point, ends."""
    for _ in range(50):
        middle = (low + high) / 2
        up = above(middle)
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return low


class Seating:
    """Draws how many tables a dish has, given all other dishes' tables: with c customers, others = strength + discount * (the
    other dishes' tables) and base, the dish's probability at the parent, t tables weigh arrangements(c, t) * base**t *
    others * (others + discount) * ...: the full conditional of the seating with who sits where summed out, so a Gibbs step
    moves a dish's customers all at once. Up to EXACT customers by the numbers themselves; beyond, by their ratios at the
    saddle point (within 2 percent), and where many tables are likely by the normal curve around the likeliest."""

    def __init__(self, customers: np.ndarray, discount: float) -> None:
        self.customers, self.discount = customers, discount
        self.exact = arrangements(discount, EXACT)
        self.big, at = np.unique(customers[customers > EXACT], return_inverse=True)
        self.row = np.zeros(len(customers), np.int64)
        self.row[customers > EXACT] = at
        c, t = np.broadcast_arrays(self.big[:, None].astype(float), np.arange(1, WINDOW) + 0.5)
        saddles = bisected(np.full(c.shape, 1e-9), np.full(c.shape, 300.0), lambda y: tables_at(y, c, discount) > t)
        self.ratios = one_more(saddles, discount) - np.log(np.arange(1, WINDOW))

    def draw(self, rng: np.random.Generator, which: np.ndarray, others: np.ndarray, base: np.ndarray) -> np.ndarray:
        out, c = np.ones(len(which), np.int64), self.customers[which]
        order = np.argsort(c, kind="stable")
        for lo, hi in runs_of(c[order]):
            n = int(c[order[lo]])
            if not 1 < n <= EXACT:
                continue
            for first in range(lo, hi, max(1, CELLS // n)):
                rows = order[first : min(hi, first + max(1, CELLS // n))]
                steps = np.log((others[rows, None] + self.discount * np.arange(n)) * base[rows, None])
                out[rows] = self.pick(rng, self.exact[n, 1 : n + 1] + np.cumsum(steps, axis=1))
        many = np.flatnonzero(c > EXACT)
        if len(many):
            out[many] = self.far(rng, c[many].astype(float), self.ratios[self.row[which[many]]], others[many], base[many])
        return out

    @staticmethod
    def pick(rng: np.random.Generator, weights: np.ndarray) -> np.ndarray:
        """A column of each row, from 1, by logarithms of weights."""
        sums = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
        return 1 + np.minimum((sums < rng.random((len(sums), 1)) * sums[:, -1:]).sum(axis=1), weights.shape[1] - 1)

    def far(self, rng: np.random.Generator, c: np.ndarray, ratios: np.ndarray, others: np.ndarray, base: np.ndarray) -> np.ndarray:
        d = self.discount
        rises = lambda y, t: np.log((others + d * t) * base) + one_more(y, d) - np.log(t)
        y = bisected(np.full(len(c), 1e-9), np.full(len(c), 300.0), lambda y: rises(y, np.maximum(tables_at(y, c, d), 1e-9)) < 0)
        top = tables_at(y, c, d)
        near = y * (1 - 1e-3)
        other = tables_at(near, c, d)
        slope = (rises(near, other) - rises(y, top)) / np.maximum(other - top, 1e-12)
        wide = top + 0.5 + rng.standard_normal(len(c)) * np.sqrt(1 / np.maximum(-slope, 1e-12))
        steps = np.cumsum(np.log((others[:, None] + d * np.arange(1, WINDOW)) * base[:, None]) + ratios, axis=1)
        close = self.pick(rng, np.concatenate([np.zeros((len(c), 1)), steps], axis=1))
        return np.where(top > WINDOW / 3, np.clip(np.rint(wide), 1, c), close).astype(np.int64)


class Restaurants:
    """Dishes (the pairs) of the restaurants (the contexts) of a bucket, with customers and tables."""

    def __init__(self, context: np.ndarray, customers: np.ndarray, apart: np.ndarray, tables: np.ndarray | None = None) -> None:
        """context: each pair's, numbered from 0; apart: the tables that each context has in other buckets."""
        self.context, self.customers, self.apart = context, customers, apart
        self.tables = np.minimum(customers, 1) if tables is None else tables
        self.many = np.flatnonzero(customers > 1)

    def of_contexts(self) -> np.ndarray:
        """Each context's tables."""
        return self.apart + np.bincount(self.context, self.tables, len(self.apart))

    def sweep(self, rng: np.random.Generator, seating: Seating, base: np.ndarray, strength: float) -> None:
        """Every dish's tables drawn again, a random half of the dishes at a time, given the other half's."""
        half = rng.random(len(self.many)) < 0.5
        for part in (np.flatnonzero(half), np.flatnonzero(~half)):
            at = self.many[part]
            others = strength + seating.discount * np.maximum(self.of_contexts()[self.context[at]] - self.tables[at], 0)
            self.tables[at] = seating.draw(rng, part, others, base[at])

    def predict(self, base: np.ndarray, totals: np.ndarray, discount: float, strength: float) -> np.ndarray:
        """Each pair's probability under the seating; totals: the customers of each context."""
        found = self.customers - discount * self.tables + (strength + discount * self.of_contexts()[self.context]) * base
        return found / (strength + totals[self.context])


# --- blocks ----------------------------------------------------------------------------------------------------------------

BLOCKS = "block long, tokens long, row_block array<long>, row_at array<int>, doc_id array<long>, held array<boolean>, size array<int>, words binary, train binary, codes binary"


def blocks_of(docs: DataFrame, doc_id: str, text: str, folds: int, block_tokens: int) -> DataFrame:
    """The texts as blocks of tokens. A text that is longer than a block is cut, and each part begins with the token before it,
    as every text begins with END. words: the distinct hashes, in order; train: how often each is a token of a text that is not
    held out; codes: the tokens, as places among words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, parts, held, tokens = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            words, codes = np.unique(np.concatenate(parts), return_inverse=True)
            trains = np.repeat(~np.array(held), sizes)
            trains[np.cumsum(sizes) - sizes] = False  # what stands before a part is no token of it
            train = np.bincount(codes[trains], minlength=len(words))
            blob = zstandard.compress(words.tobytes(), 1)
            row = [number, int(sizes.sum() - len(sizes)), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], held, sizes.astype(np.int32).tolist(), blob, packed(train), packed(codes)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch, texts in slices(batches, 2, HASHED_CHARS):
            words, first, _, _ = word_hashes(texts)
            for k, (i, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                whole = np.concatenate([[END], words[first[k] : first[k + 1]], [END]])
                key = (number, len(parts), i)
                for lo in range(0, len(whole) - 1, block_tokens):
                    rows.append(key)
                    held.append(h)
                    parts.append(whole[lo : lo + block_tokens + 1])
                    tokens += len(parts[-1]) - 1
                    if tokens >= block_tokens:
                        yield block()
                        number, rows, parts, held, tokens = number + 1, [], [], [], 0
        if parts:
            yield block()

    out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))
    return docs.select(F.col(doc_id).cast("long"), out, F.col(text)).mapInArrow(cut, BLOCKS)


DICTIONARY = "chunk long, block long, numbers binary, counts binary, known long, trained long, once long, twice long"


def dictionary(blocks: DataFrame, bits: int) -> DataFrame:
    """Words counted by chunks of their hashes' first bits. Rows of a chunk: one for itself (block null: its words' counts,
    and how many are known, trained on, seen once and twice), and one for each block, its words' numbers and counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, train in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes, counts = np.frombuffer(zstandard.decompress(words), np.uint64), opened(train)
                chunk = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                found = [(int(chunk[lo]), block, hashes[lo:hi].tobytes(), packed(counts[lo:hi])) for lo, hi in runs_of(chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["chunk", "block", "hashes", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(at, np.concatenate([opened(x) for x in pdf["counts"]]), len(words)).astype(np.int64)
        chunk = int(pdf["chunk"].iloc[0])
        rows = [(chunk, None, b"", packed(counts), int((counts > 0).sum()), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()))]
        for block, mine in zip(pdf["block"], np.split(at, np.cumsum([len(x) for x in hashes])[:-1]), strict=True):
            rows.append((chunk, block, rising(mine), packed(counts[mine]), 0, 0, 0, 0))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in DICTIONARY.split(", ")])
        out["block"] = out["block"].astype("Int64")
        return out

    return blocks.select("block", "words", "train").mapInArrow(ask, "chunk long, block long, hashes binary, counts binary").groupBy("chunk").applyInPandas(answer, DICTIONARY)


FULL = "block long, row_block array<long>, row_at array<int>, doc_id array<long>, held array<boolean>, size array<int>, codes binary, numbers binary, counts binary"


def with_numbers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with their words' numbers and counts, in the order of words."""

    def put(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("chunk")
        numbers = np.concatenate([risen(x) + (c << LOW) for c, x in zip(right["chunk"], right["numbers"], strict=True)])
        counts = np.concatenate([opened(x) for x in right["counts"]])
        return left.assign(numbers=[rising(numbers)], counts=[packed(counts)])[[c.split()[0] for c in FULL.split(", ")]]

    return blocks.drop("words", "train", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(put, FULL)


class Pairs:
    """The distinct pairs of a block, ordered by bucket, context and word."""

    def __init__(self, codes: bytes, sizes: list[int], held: list[bool], numbers: bytes, counts: bytes, buckets: int, split_tokens: int) -> None:
        self.codes, self.sizes = opened(codes), np.asarray(sizes, np.int64)
        self.numbers, self.counts = risen(numbers), opened(counts)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        later = np.ones(len(self.codes), bool)
        later[self.firsts] = False
        self.tokens = np.flatnonzero(later)
        word, context = self.codes[self.tokens], self.codes[self.tokens - 1]
        both, self.place = np.unique(context * len(self.numbers) + word, return_inverse=True)
        self.train = np.bincount(self.place[~np.repeat(np.asarray(held, bool), self.sizes - 1)], minlength=len(both))
        context, word = both // len(self.numbers), both % len(self.numbers)
        u, w = self.numbers[context], self.numbers[word]
        shards = 1 + np.where(self.counts[context] >= split_tokens, self.counts[context] // SPLIT_TOKENS, 0)
        shard = (mix(w.astype(np.uint64) * PRIME) % shards.astype(np.uint64)).astype(np.uint64)
        bucket = (mix(u.astype(np.uint64) * PRIME + shard) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((w, u, bucket))
        self.bucket, self.u, self.w, self.total, self.n = bucket[order], u[order], w[order], self.counts[context][order], self.train[order]
        self.split = shards[order] > 1
        self.place = np.argsort(order)[self.place]

    def parts(self) -> Iterator[tuple[int, slice]]:
        for lo, hi in runs_of(self.bucket):
            yield int(self.bucket[lo]), slice(lo, hi)


REQUESTS = "bucket long, block long, u binary, runs binary, total binary, split binary, w binary, n binary"


def requests(full: DataFrame, buckets: int, split_tokens: int) -> DataFrame:
    """Each block's pairs for each bucket: the contexts with their tokens and whether they are split, the run of words of
    each, and how often a pair is in texts that are not held out."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, sizes, held, numbers, counts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                p = Pairs(codes, sizes, held, numbers, counts, buckets, split_tokens)
                rows = []
                for bucket, s in p.parts():
                    first = np.flatnonzero(np.diff(p.u[s], prepend=-1))
                    rows.append((bucket, block, rising(p.u[s][first]), packed(np.diff(first, append=s.stop - s.start)), packed(p.total[s][first]), packed(p.split[s][first]), packed(p.w[s]), packed(p.n[s])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 2 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in REQUESTS.split(", ")])

    return full.select("block", "codes", "size", "held", "numbers", "counts").mapInArrow(ask, REQUESTS)


# --- buckets ---------------------------------------------------------------------------------------------------------------

STATE = "bucket long, u binary, runs binary, total binary, split binary, w binary, words binary, n binary, tables binary, blocks array<long>, places array<binary>, once long, twice long, hot array<struct<u: long, tables: long>>"


class Bucket:
    """A bucket's pairs, ordered by context and word, and their seating."""

    def __init__(self, row, apart: dict[int, int] | None = None) -> None:
        self.u, runs, self.total, self.split = risen(row["u"]), opened(row["runs"]), opened(row["total"]), opened(row["split"]).astype(bool)
        self.words, self.w = risen(row["words"]), opened(row["w"])  # w: places among words
        of = np.repeat(np.arange(len(self.u)), runs)
        far = np.array([(apart or {}).get(x, 0) if s else 0 for x, s in zip(self.u.tolist(), self.split.tolist(), strict=True)], np.float64)
        self.rest = Restaurants(of, opened(row["n"]), far, opened(row["tables"]))

    def seating(self) -> dict:
        tables = self.rest.of_contexts() - self.rest.apart
        hot = [{"u": int(x), "tables": int(t)} for x, t in zip(self.u[self.split], tables[self.split], strict=True)]
        return {"tables": packed(self.rest.tables), "hot": hot}


def gathered(asked: DataFrame, discount: float, strength: float, moves: int, seed: int) -> DataFrame:
    """Buckets from all blocks' requests, their customers seated for the first time. The share of the bucket's own contexts in
    which a word stands is the parent's probability then; later sweeps have the root's."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        bucket = int(pdf["bucket"].iloc[0])
        us = [risen(x) for x in pdf["u"]]
        runs = [opened(x) for x in pdf["runs"]]
        u, w, n = np.concatenate([np.repeat(x, r) for x, r in zip(us, runs, strict=True)]), np.concatenate([opened(x) for x in pdf["w"]]), np.concatenate([opened(x) for x in pdf["n"]])
        contexts, first = np.unique(np.concatenate(us), return_index=True)
        total, split = np.concatenate([opened(x) for x in pdf["total"]])[first], np.concatenate([opened(x) for x in pdf["split"]])[first]
        words, word = np.unique(w, return_inverse=True)
        both, place = np.unique(np.searchsorted(contexts, u) * len(words) + word, return_inverse=True)
        customers = np.bincount(place, n, len(both)).astype(np.int64)
        context, word = both // len(words), both % len(words)
        there = customers > 0
        base = (np.bincount(word[there], minlength=len(words)) + 0.5) / (there.sum() + 0.5 * len(words))
        rng = np.random.default_rng([seed, 0, bucket])
        rest = Restaurants(context, customers, np.zeros(len(contexts)))
        seating = Seating(customers[rest.many], discount)
        for _ in range(moves):
            rest.sweep(rng, seating, base[word], strength)
        places = np.split(place, np.cumsum([r.sum() for r in runs])[:-1])
        tables = rest.of_contexts()
        hot = [{"u": int(x), "tables": int(t)} for x, t, s in zip(contexts, tables, split, strict=True) if s]
        row = [bucket, rising(contexts), packed(np.bincount(context, minlength=len(contexts))), packed(total), packed(split), packed(word), rising(words), packed(customers), packed(rest.tables), pdf["block"].tolist(), [rising(x) for x in places], int((customers == 1).sum()), int((customers == 2).sum()), hot]
        return pd.DataFrame([row], columns=[c.split()[0] for c in STATE.split(", ")][:13] + ["hot"])

    return asked.groupBy("bucket").applyInPandas(make, STATE)


NEWS = "bucket long, chunk long, root binary, tables double, customers double"


def root(state: DataFrame, known: int, discount: float, strength: float, moves: int, seed: int) -> DataFrame:
    """The root restaurant, by chunks: each word's customers are the tables of all buckets. A row for each bucket and chunk
    that have to do with each other: the words' customers less discount a table; and for each chunk (bucket null) its tables
    and customers. Averages over some Gibbs steps after the first seating."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row)
                tables = np.bincount(b.w, b.rest.tables, len(b.words)).astype(np.int64)
                chunk = b.words >> LOW
                rows = [(int(chunk[lo]), row["bucket"], rising(b.words[lo:hi] & (1 << LOW) - 1), packed(tables[lo:hi])) for lo, hi in runs_of(chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["chunk", "bucket", "words", "tables"])

    def sit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        chunk = int(pdf["chunk"].iloc[0])
        mine = [risen(x) for x in pdf["words"]]
        sums = np.bincount(np.concatenate(mine), np.concatenate([opened(x) for x in pdf["tables"]])).astype(np.int64)
        there = np.flatnonzero(sums)
        customers = sums[there]
        rng = np.random.default_rng([seed, 1, chunk])
        base = np.full(len(there), 1 / (known + 1))
        own = np.ones(len(there), np.int64)
        seating, each = Seating(customers, discount), np.arange(len(there))
        less, tables = np.zeros(len(sums)), 0.0
        for _ in range(max(1, moves)):
            # all tables of the root, by those of this chunk, which holds a random part of the words
            whole = known * own.sum() / max(1, len(there))
            own = seating.draw(rng, each, strength + discount * np.maximum(whole - own, 0), base)
            less[there] += (customers - discount * own) / max(1, moves)
            tables += own.sum() / max(1, moves)
        rows = [(None, chunk, None, tables, float(customers.sum()))] + [(b, chunk, packed(less[x].astype(np.float32)), 0.0, 0.0) for b, x in zip(pdf["bucket"], mine, strict=True)]
        out = pd.DataFrame(rows, columns=["bucket", "chunk", "root", "tables", "customers"])
        out["bucket"] = out["bucket"].astype("Int64")
        return out

    told = state.mapInArrow(tell, "chunk long, bucket long, words binary, tables binary")
    return told.groupBy("chunk").applyInPandas(sit, NEWS)


def hot_totals(state: DataFrame) -> DataFrame:
    """(bucket, chunk null, hot): the tables that each split context has in other buckets. As many rows as such contexts and
    their buckets, which are about the corpus's tokens by SPLIT_TOKENS."""
    hot = state.select("bucket", F.explode("hot").alias("h")).select("bucket", "h.u", "h.tables")
    both = hot.join(hot.groupBy("u").agg(F.sum("tables").alias("all")), "u")
    return both.groupBy("bucket").agg(F.collect_list(F.struct("u", (F.col("all") - F.col("tables")).alias("tables"))).alias("hot"))


def news(state: DataFrame, at_root: DataFrame) -> DataFrame:
    """What each bucket hears in an exchange."""
    words = at_root.where("bucket is not null").select("bucket", "chunk", "root", F.lit(None).cast("array<struct<u: long, tables: long>>").alias("hot"))
    return words.unionByName(hot_totals(state).select("bucket", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("root"), "hot"))


def heard(left: pd.DataFrame, right: pd.DataFrame, known: int, tables: float, customers: float, discount: float, strength: float) -> tuple[Bucket, np.ndarray]:
    """A bucket after an exchange, and each pair's probability at the root."""
    apart = {x["u"]: x["tables"] for hot in right["hot"] if hot is not None for x in hot}
    b = Bucket(left.iloc[0], apart)
    words = right[right["chunk"].notna()].sort_values("chunk")
    less = np.concatenate([opened(x, floats=True) for x in words["root"]]).astype(np.float64)
    return b, ((less + (strength + discount * tables) / (known + 1)) / (strength + customers))[b.w]


# --- scores ----------------------------------------------------------------------------------------------------------------

SCORED = "row_block long, row_at int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = FOLDS, sweeps: int = SWEEPS, moves: int = MOVES, samples: int = SAMPLES, strength: float = STRENGTH, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, bucket_pairs: int = BUCKET_PAIRS, chunk_tokens: int = CHUNK_TOKENS, split_tokens: int = SPLIT_TOKENS) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity. The model learns
    from rows whose CRC-32 of doc_id does not divide by folds; score is the base-10 logarithm of the text's probability, each
    word's given the one before, the end's included; base_score that of words alone, with SMOOTHING added to counts.

    Null or empty text: the end alone. Null doc_id: not held out. Repeated rows are learned as often as they come. No rows: no
    rows. Without anything to learn from, all words are unknown. Other columns are ignored. Discounts are estimated from how
    many pairs (words) are seen once and twice. The contexts that are split are those of split_tokens tokens or more, at most
    SPLIT_MOST; words are known by 64-bit hashes."""
    blocks = materialise(blocks_of(docs, doc_id, text, folds, block_tokens), "lm-blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    numbered = materialise(dictionary(blocks, (tokens // chunk_tokens).bit_length()), "lm-words")
    known, trained, once, twice = numbered.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "trained", "once", "twice")]).first()
    root_discount = discounted(once, twice)
    full = materialise(with_numbers(blocks, numbered.where("block is not null").select("block", "chunk", "numbers", "counts")), "lm-tokens")
    discard(blocks)
    buckets = tokens // (2 * bucket_pairs) + 1
    split = max(split_tokens, trained // SPLIT_MOST)
    state = materialise(gathered(requests(full, buckets, split), 0.75, strength, moves, seed), "lm-seats")
    discard(numbered)
    discount = discounted(*state.agg(F.sum("once"), F.sum("twice")).first())

    def again(sweep: int, tables: float, customers: float):
        def resumed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            b, base = heard(left, right, known, tables, customers, root_discount, strength)
            rng = np.random.default_rng([seed, 1 + sweep, int(left["bucket"].iloc[0])])
            seating = Seating(b.rest.customers[b.rest.many], discount)
            for _ in range(moves):
                b.rest.sweep(rng, seating, base, strength)
            new = b.seating()
            return left.assign(tables=[new["tables"]], hot=[new["hot"]])

        return resumed

    for sweep in range(1, sweeps + 1):
        at_root = materialise(root(state, known, root_discount, strength, moves, seed + 100 * sweep), "lm-root")
        tables, customers = at_root.where("bucket is null").agg(F.coalesce(F.sum("tables"), F.lit(0.0)), F.coalesce(F.sum("customers"), F.lit(0.0))).first()
        told = news(state, at_root)
        if sweep == sweeps:
            break

        after = materialise(state.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(again(sweep, tables, customers), STATE), "lm-seats")
        discard(state, at_root)
        state = after

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b, base = heard(left, right, known, tables, customers, root_discount, strength)
        bucket = int(left["bucket"].iloc[0])
        rng = np.random.default_rng([seed, 1 + sweeps, bucket])
        p, seating = np.zeros(len(base)), Seating(b.rest.customers[b.rest.many], discount)
        for _ in range(samples):
            b.rest.sweep(rng, seating, base, strength)
            p += b.rest.predict(base, b.total, discount, strength) / samples
        log = np.log10(p).astype(np.float32)
        found = [(block, bucket, packed(log[risen(x)])) for block, x in zip(left["blocks"].iloc[0], left["places"].iloc[0], strict=True)]
        return pd.DataFrame(found, columns=["block", "bucket", "log"])

    answers = materialise(state.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(answer, "block long, bucket long, log binary"), "lm-answers")
    discard(state, at_root)
    smooth = np.log10(trained + SMOOTHING * (known + 1)) if trained or known else np.log10(SMOOTHING)

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        p = Pairs(row.codes, row["size"], row.held, row.numbers, row.counts, buckets, split)
        right = right.sort_values("bucket")
        log = np.concatenate([opened(x, floats=True) for x in right["log"]]).astype(np.float64)[p.place]
        counts = p.counts[p.codes[p.tokens]]
        at = np.cumsum(p.sizes - 1) - (p.sizes - 1)
        sums = lambda x: np.add.reduceat(x, at)
        return pd.DataFrame({
            "row_block": row.row_block, "row_at": row.row_at, "doc_id": pd.array(list(row.doc_id), "Int64"), "held_out": row.held, "n_tokens": p.sizes - 1,
            "n_known": sums((counts > 0).astype(np.int64)), "base": sums(np.log10(counts + SMOOTHING)), "score": sums(log),
        })

    parts = full.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add, SCORED)
    whole = parts.groupBy("row_block", "row_at").agg(*[F.first(c).alias(c) for c in ("doc_id", "held_out")], *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(trained)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(smooth))).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )


def discounted(once: int | None, twice: int | None) -> float:
    """A discount from how many dishes have one and two customers."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
