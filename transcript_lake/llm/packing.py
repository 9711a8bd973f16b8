"""Packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.llm.binary import END_ID, VOCABULARY, slices
from transcript_lake.llm.common import materialise, running_start, table
from transcript_lake.llm.tokens import vocabulary, word_tokenizer

LENGTH = 1024

#: Tokens by which lengths are told apart in the linear program; lengths are rounded up to it.
GRAIN = 4

#: The linear program ends when its value is within this share of the optimum, by the pricing bound.
GAP = 2e-4

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents' ids, each ended by end_id, in pieces of length ids and one shorter rest. Null text: the end id alone."""
    path = path or vocabulary(VOCABULARY)

    def encode(batches):
        tokenizer = word_tokenizer(path)
        for batch, texts in slices(batches, 1):
            rows = []
            ids, starts = tokenizer.encode(texts, end_id)
            for key, first, last in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rows += [(key, lo - first, min(length, last - lo), zlib.crc32(ids[lo : min(last, lo + length)]), last - first) for lo in range(first, last, length)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(encode, PIECES)


def price(duals: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of most worth by knapsack dynamic programming: duals[w] is an item's worth at weight w; capacity len(duals) - 1."""
    capacity = len(duals) - 1
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = duals[1 : c + 1] + best[c - 1 :: -1][:c]
        w = int(worth.argmax())
        if worth[w] > best[c - 1] + 1e-12:
            best[c], took[c] = worth[w], w + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def relax(demand: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, from the linear program: cover demand[w] items of weight w with the fewest patterns.

    The basis starts with patterns of one weight each; each round the duals price a new pattern, which enters by the ratio test."""
    capacity, weights = len(demand) - 1, np.flatnonzero(demand)
    columns = np.zeros((len(weights), len(weights)))
    np.fill_diagonal(columns, capacity // weights)
    inverse = np.diag(1.0 / (capacity // weights))
    use = inverse @ demand[weights]
    for _ in range(40 * len(weights)):
        duals = np.zeros(capacity + 1)
        duals[weights] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = price(duals)
        if worth <= 1 + gap:
            break
        column = pattern[weights].astype(float)
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        ratios = use[rows] / step[rows]
        k = rows[int(ratios.argmin())]
        use -= step * ratios.min()
        use[k] = ratios.min()
        inverse[k] /= step[k]
        rest = np.arange(len(weights)) != k
        inverse[rest] -= np.outer(step[rest], inverse[k])
        columns[:, k] = column
    out = []
    for k in range(len(weights)):
        pattern = np.zeros(capacity + 1, np.int64)
        pattern[weights] = columns[:, k].round().astype(np.int64)
        out.append((pattern, float(max(0.0, use[k]))))
    return out


def patterns(demand: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold each item exactly once: the linear program's, rounded down, then the rest by first fit, longest first."""
    left, out, capacity = demand.astype(np.int64).copy(), [], len(demand) - 1
    for pattern, use in sorted(relax(demand, gap), key=lambda x: -x[1]) if demand.any() else []:
        held = pattern > 0
        times = int(min(np.floor(use + 1e-6), (left[held] // pattern[held]).min())) if held.any() else 0
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    while left.any():
        # the longest that still fits, again and again; the pattern is used as often as the rest allows
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        for w in np.flatnonzero(left)[::-1].tolist():
            n = min(room // w, int(left[w]))
            pattern[w], room = n, room - n * w
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def pack(pieces: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """pieces (with length, doc_id, start, ids_crc32) and the sequence_id and offset of each.

    What reaches the driver is the histogram of lengths, of length / grain counts at most. Pieces are ranked by length;
    a pattern takes so many ranks of each of its lengths, so a broadcast of the patterns gives each rank its sequence.
    Offsets add up the true lengths within a sequence, without gaps; padding is at its end."""
    pieces = materialise(pieces.withColumn("weight", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    spark, capacity = pieces.sparkSession, length // grain
    demand = np.zeros(capacity + 1, np.int64)
    for w, n in pieces.groupBy("weight").count().collect():
        demand[w] = n
    slots, taken, sequences = [], np.zeros(capacity + 1, np.int64), 0
    before = np.concatenate([[0], np.cumsum(demand)[:-1]])
    for pattern, times in patterns(demand):
        place = 0
        for w in np.flatnonzero(pattern)[::-1].tolist():
            n = int(pattern[w])
            lo = int(before[w] + taken[w])
            slots.append((w, lo, lo + n * times, sequences, n, place))
            taken[w] += n * times
            place += n
        sequences += times
    # at most as many patterns as lengths, and a few lengths in each
    found = F.broadcast(spark.createDataFrame(slots, "slot_weight int, lo long, hi long, first long, each int, place int"))
    ranked = running_start(pieces, [F.col(c) for c in ("weight", "doc_id", "start", "ids_crc32")], F.lit(1), "rank")
    at = ranked.join(found, (F.col("weight") == F.col("slot_weight")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    at = at.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("each"))).withColumn("slot", F.col("place") + F.pmod(nth, F.col("each")))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.sum("length").over(inside) - F.col("length")
    return at.withColumn("offset", offset).drop("weight", "slot_weight", "lo", "hi", "first", "each", "place", "rank", "slot")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Each document's pieces with their sequence and offset. Null text: one piece, the end id. Rows that share a doc_id,
    or are equal, are packed each on its own. No rows: no rows. Other columns are ignored."""
    return pack(cut(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
