"""N-gram Jaccard join by token-combination prefixes, and the classes that its links make.

1. A sketch of fixed size counts in how many rows each shingle lies.
2. Shingles are put in one order, rare ones first. A set x can miss at most len(x) - ceil(t len(x)) shingles of a
   similar set. A prefix of the order is extended until its shared shingles cannot all be missed:
   rare shingles count one each; frequent ones are dealt to classes by hash, and a class with c of them counts c - 1.
   Then two similar sets share a rare shingle, or a pair of frequent ones of one class, in their prefixes.
   How many classes there are follows from the set's size, by bands that similar sets share or have side by side.
3. A bitmap of signatures that more than one set has drops the others before they leave their task. Sets that share a
   signature are candidates. Each is compared with one pivot of the signature, the one with the
   fewest rare shingles; links make components; then, where a signature's sets still lie in different components, the
   pairs across components are compared whose sizes and folds of 256 bits allow it. So a group of near copies costs about one comparison a member, and no link
   between components is lost.
4. Candidates pass a parity bitmap (whose difference never exceeds the sets' own), then the sets themselves are compared.

Equal sets (by 128 bits of their hashes) are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.binary import slices
from transcript_lake.llm.common import discard, materialise, table
from transcript_lake.llm.graph import components
from transcript_lake.llm.shingles import HASHED_CHARS, PRIME, digest, mix, shingle_sets
from transcript_lake.llm.slots import PART, counted, dealt, level, parts_of, places_of_shared, shared_bits, slots_for

WORDS = 3
SIMILARITY = (90, 100)

#: The sketch: one byte a slot, as many slots as a quarter of the shingles, up to 2**MOST; it is broadcast.
MOST = 27

#: Up to so many ids (8 bytes each) are broadcast; checked by a count.
BROADCAST_IDS = 1_000_000

#: Shingles in so many rows, and in four times the mean of a slot, are frequent.
FREQUENT = 32

#: Bytes of a shingle's hash when sets are compared.
HASH_BYTES = 6


def sketch(docs: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """The level of each slot, and the one from which shingles are frequent. Slots that occur in a slice of text are sent
    to their part's task, which adds them up; the driver gets one byte a slot."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = slots_for(size // 6 // 4, MOST)  # a word and its blank are about six bytes
    width = 1 << PART

    def occur(batches):
        for _, texts in slices(batches, 0, HASHED_CHARS):
            sets = shingle_sets(texts, k)
            yield dealt(np.sort(np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.uint32), bits)

    def add(batches):
        counts = counted(batches)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([level(x).tobytes() for x in counts.values()], pa.binary()), pa.array([int(x.sum()) for x in counts.values()], pa.int64())], names=["part", "levels", "total"])

    found = docs.select("text").mapInArrow(occur, "part int, slots binary").repartition(1 << bits - PART, "part").mapInArrow(add, "part int, levels binary, total long")
    out, total = np.zeros(1 << bits, np.uint8), 0
    for p, x, n in parts_of(found):
        out[p * width : (p + 1) * width] = np.frombuffer(x, np.uint8)
        total += n
    return out, int(level(np.array([max(FREQUENT, 4 * total >> bits)]))[0])


def signatures(classes: DataFrame) -> DataFrame:
    """(sig, node, n, rare): the signatures of each set that another one may have too."""
    shared = classes.sparkSession.sparkContext.broadcast(shared_bits(classes.select("sigs")))

    def run(batches):
        for batch in batches:
            sigs, row, _ = places_of_shared(batch.column(3), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), *[pa.array(batch.column(j).to_numpy()[row]) for j in range(3)]], names=["sig", "node", "n", "rare"])

    return classes.select("node", "n", "rare", "sigs").mapInArrow(run, "sig long, node long, n long, rare long")


class Signer:
    """Signatures and bitmaps of sets, for one sketch and similarity num / den."""

    def __init__(self, levels: np.ndarray, frequent: int, num: int, den: int) -> None:
        self.levels, self.frequent, self.num, self.den = levels, frequent, num, den
        self.width = np.log(den / num) * 1.001
        self.shift = np.uint64(64 - (len(levels) - 1).bit_length())

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The signatures of a set of hashes (even: a rare shingle, odd: a pair of frequent ones), and how many of its shingles are rare."""
        n = len(s)
        lev = self.levels[s >> self.shift]
        s = s[np.lexsort((s, lev))]
        rare = int((lev < self.frequent).sum())
        need = n - -(-self.num * n // self.den) + 1
        out = [s[: min(rare, need)] & ~np.uint64(1)]
        if rare < need:
            own = int(np.log(n) / self.width)
            for band in (own, own + 1):
                classes = max(1, int((1 - self.num / self.den) * np.exp(band * self.width) / 3))
                rest = s[rare : rare + need - rare + classes]
                c = (rest % np.uint64(classes)).astype(np.int64)
                order = np.argsort(c, kind="stable")
                nth = np.empty(len(c), np.int64)
                nth[order] = np.arange(len(c)) - np.searchsorted(c[order], c[order])
                end = int(np.searchsorted(np.cumsum(nth > 0), need - rare)) + 1
                rest, c = rest[:end], c[:end]
                order = np.argsort(c, kind="stable")
                rest, c = rest[order], c[order]
                for gap in range(1, len(c)):
                    same = np.flatnonzero(c[gap:] == c[:-gap])
                    if not len(same):
                        break
                    a, b = rest[same], rest[same + gap]
                    out.append(mix((np.minimum(a, b) * PRIME ^ np.maximum(a, b)) + np.uint64(band + 1)) | np.uint64(1))
        return np.concatenate(out), rare

    def bitmap(self, s: np.ndarray) -> bytes:
        bits = 1 << max(6, (2 * len(s) - 1).bit_length())
        return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


FOLD = ("f0", "f1", "f2", "f3")


def fold(s: np.ndarray) -> np.ndarray:
    """256 bits of parity: those of two sets differ in no more bits than the sets in shingles."""
    bits = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def least_shared(a, b, num: int, den: int):
    """Shingles that sets of sizes a and b must share at least."""
    return -(-num * (a + b) // (num + den))


def close(x: bytes, y: bytes, most: int) -> bool:
    """Whether sets with these bitmaps can differ in at most most shingles; the longer bitmap is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= most


def short(s: np.ndarray) -> bytes:
    return np.sort(s)[:, None].view(np.uint8)[:, 8 - HASH_BYTES :].tobytes()


def wide(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // HASH_BYTES, 8), np.uint8)
    out[:, 8 - HASH_BYTES :] = np.frombuffer(x, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").reshape(-1)


def sketched_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per row of docs: doc_id, mark (of its text), n (size of its set), the set's key, rare, bitmap and signatures (null where n is 0)."""
    levels, frequent = sketch(docs, k)
    shared = docs.sparkSession.sparkContext.broadcast((levels.tobytes(), frequent))

    def run(batches):
        raw, freq = shared.value
        signer = Signer(np.frombuffer(raw, np.uint8), freq, num, den)
        for batch, texts in slices(batches, 2, HASHED_CHARS):
            cols, folds = [[], [], [], [], []], []
            for s in shingle_sets(texts, k):
                folds.append(fold(s))
                sigs, rare = signer.sign(s) if len(s) else (None, None)
                for col, x in zip(cols, (len(s), digest(s) if len(s) else None, rare, signer.bitmap(s) if len(s) else None, None if sigs is None else sigs.view(np.int64)), strict=True):
                    col.append(x)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)]
            folded = np.array(folds, np.int64).reshape(-1, len(FOLD))
            arrays += [pa.array(folded[:, j].copy()) for j in range(len(FOLD))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "mark", "n", "key", "rare", "bitmap", "sigs", *FOLD])

    return materialise(docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n long, key binary, rare long, bitmap binary, sigs array<long>" + "".join(f", {c} long" for c in FOLD)), "signed")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int, salt: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those that are similar; by bitmaps first, then by the sets, which are made again from the classes' texts."""
    ends = classes.select("node", "n", "bitmap")

    def near(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            most = na + nb - 2 * least_shared(na, nb, num, den)
            keep = [close(x, y, m) for x, y, m in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    both = pairs.join(ends.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma")), "a").join(ends.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb")), "b")
    left = materialise(both.select("a", "b", "na", "ma", "nb", "mb").mapInArrow(near, "a long, b long"), "near")

    def make(batches):
        for batch, texts in slices(batches, 0, HASHED_CHARS):
            sets = shingle_sets(texts, k)
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([short(s) for s in sets], pa.binary())], names=["key", "n", "hashes"])

    needed = materialise(classes.join(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), "node", "left_semi").select("rep").distinct(), "needed")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    # a text of another set under the same doc_id is made too, and finds no pair
    sets = materialise(docs.select("doc_id", "text").join(few, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInArrow(make, "key binary, n long, hashes binary").select(node_of(salt), "hashes"), "sets")

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = wide(x), wide(y)
                shared = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(den * shared >= num * (len(a) + len(b) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    whole = left.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    found = materialise(whole.select("a", "b", "ha", "hb").mapInArrow(similar, "a long, b long"), "similar")
    discard(left, needed, sets)
    return found


def node_of(salt: int) -> Column:
    return F.xxhash64("key", "n", F.lit(salt)).alias("node")


def jaccard_rows(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, mark (xxhash64 of its text), n_shingles, component_id, the least doc_id that links reach, and
    component, a number of all rows that links reach (null where n_shingles is 0).

    Two rows link if 100 times the shingles that they share is at least 90 times those in either (or as similarity says).
    Null text, or none of words: n_shingles 0, linked with nothing, component_id its own doc_id. Null doc_id: linked as
    any other; component_id is null unless links reach a row with a doc_id. Rows that share a doc_id are rows of their own;
    equal rows repeat. No rows: no rows. Other columns are ignored."""
    num, den = similarity
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = sketched_rows(docs, k, num, den)
    small = rows.select("doc_id", "mark", "n", "key")
    once = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "rare", "bitmap", "sigs", *FOLD)])
    keyed = materialise(once, "classes")
    salt = 0
    while keyed.groupBy(node_of(salt)).count().where("count > 1").limit(1).count():
        salt += 1
    classes = keyed.select("*", node_of(salt))

    signed = materialise(signatures(classes), "signatures")
    hot = signed.groupBy("sig").agg(F.count("*").alias("sets"), F.min(F.struct("rare", "node", "n")).alias("pivot")).where("sets > 1").select("sig", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.rare").alias("pivot_rare"))
    buckets = materialise(signed.join(hot, "sig"), "buckets")
    discard(signed)

    def sized(n1: str, r1: str, n2: str, r2: str) -> Column:
        """Whether sets of a signature can be similar by their sizes. A set with a pair of frequent shingles among its signatures
        has all its rare ones there too, so two such sets either meet by a rare one as well, or share none of the rare."""
        a, b = F.col(n1), F.col(n2)
        shared = F.when(F.col("sig").bitwiseAND(1) == 0, F.least(a, b)).otherwise(F.least(a - F.col(r1), b - F.col(r2)))
        return shared * den >= (a + b - shared) * num

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = materialise(buckets.where((F.col("node") != F.col("pivot")) & sized("n", "rare", "pivot_n", "pivot_rare")).select(*pair("node", "pivot")).distinct(), "stars")
    links = verified(stars, classes, docs, k, num, den, salt)

    every = components(links)
    at = materialise(buckets.select("sig", "node", "n", "rare").join(every, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    discard(buckets)
    mixed = at.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    open_ = materialise(at.join(mixed, "sig").join(classes.select("node", *FOLD), "node"), "open")
    other = open_.select("sig", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "rare", "component", *FOLD)])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in FOLD[1:]), F.bit_count(F.col(FOLD[0]).bitwiseXOR(F.col(f"{FOLD[0]}2"))))
    sizes = F.col("n") + F.col("n2")  # similar sets differ in at most sizes - 2 * least_shared shingles
    alike = (num + den) * (sizes - apart) >= 2 * num * sizes
    across = open_.join(other, "sig").where((F.col("component") < F.col("component2")) & sized("n", "rare", "n2", "rare2") & alike)
    more = materialise(across.select(*pair("node", "node2")).distinct().join(stars, ["a", "b"], "left_anti"), "across")
    discard(at, stars, open_)
    if more.limit(1).count():
        known = every.select(F.col("node").alias("a"), F.col("component").alias("b"))
        every = components(known.union(verified(more, classes, docs, k, num, den, salt)))
    discard(more, links)

    rooted = materialise(keyed.select("key", "rep", node_of(salt)).join(every, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component")), "rooted")
    least = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    classed = small.join(rooted.join(least, "component").select("key", "component", "component_id"), "key", "left")
    return classed.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def jaccard_classes(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, as jaccard_rows has them."""
    return jaccard_rows(docs, k, similarity, text, doc_id).select("doc_id", "n_shingles", "component_id")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
