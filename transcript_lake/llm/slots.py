"""Which 64-bit hashes occur more than once, by a bitmap that is counted in parts and broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_lake.llm.common import discard, materialise
from transcript_lake.llm.shingles import HASHED_CHARS

#: When they are counted, slots are dealt in parts of 2**PART; there are never fewer.
PART = 20

#: Eight bits a value, up to 2**MOST_BITS in all (128 MB): beyond, more values pass that occur once, and none is lost.
MOST_BITS = 30


def slots_for(n: int, most: int) -> int:
    """Bits of a slot's number for about n slots."""
    return min(most, max(PART, n.bit_length()))


def dealt(slot: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted slots of 2**bits, by part, each part as the differences of its slots."""
    width = 1 << PART
    cuts = np.searchsorted(slot, np.arange((1 << bits - PART) + 1) * width)
    blobs = [np.diff(slot[lo:hi], prepend=np.uint32(p * width)).astype("<u4").tobytes() for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    rows = [(p, x) for p, x in enumerate(blobs) if x]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "slots"])


def counted(batches) -> dict[int, np.ndarray]:
    """By part, how often each of its slots occurs in the batches that dealt made. A part's slots are added up when as many have come
    as it has slots: a pass over the part for each blob would grow with the blobs times the slots."""
    width = 1 << PART
    counts: dict[int, np.ndarray] = {}
    held: dict[int, list[np.ndarray]] = {}
    sizes: dict[int, int] = {}

    def add(p: int) -> None:
        counts[p] = counts.get(p, 0) + np.bincount(np.concatenate(held.pop(p)), minlength=width)
        del sizes[p]

    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            slot = np.cumsum(np.frombuffer(x, "<u4"), dtype=np.uint32)
            held.setdefault(p, []).append(slot)
            sizes[p] = sizes.get(p, 0) + len(slot)
            if sizes[p] >= width:
                add(p)
    for p in list(held):
        add(p)
    return counts


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as a byte: quarters of the binary logarithm."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def parts_of(found: DataFrame):
    """The rows of a table of parts, which is made by as many tasks at once as there are cores, written, and read one after the other."""
    parts = materialise(found, "parts")
    yield from parts.toLocalIterator()
    discard(parts)


def shared_bits(lists: DataFrame) -> tuple[bytes, int]:
    """A bitmap, and the bits of its slots' numbers, of the slots in which more than one value of all lists lies.
    lists has one column of arrays of 64-bit hashes; how often each value occurs is counted by slot, in parts."""
    n = lists.agg(F.sum(F.size(lists.columns[0]))).first()[0] or 0
    bits = slots_for(8 * n, MOST_BITS)

    def occur(batches):
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().view(np.uint64)
            for lo in range(0, len(values), HASHED_CHARS):
                yield dealt(np.sort(values[lo : lo + HASHED_CHARS] >> np.uint64(64 - bits)).astype(np.uint32), bits)

    return shared_slots(lists.mapInArrow(occur, "part int, slots binary"), bits)


def shared_slots(dealt_out: DataFrame, bits: int) -> tuple[bytes, int]:
    """The bitmap that shared_bits has, from rows (part, slots) that dealt made."""
    width = 1 << PART

    def add(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                once, twice = found.setdefault(p, (np.zeros(width, bool), np.zeros(width, bool)))
                steps = np.frombuffer(x, "<u4")
                slot = np.cumsum(steps)
                twice[slot[once[slot]]] = True
                twice[slot[1:][steps[1:] == 0]] = True
                once[slot] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(x).tobytes() for _, x in found.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for p, x in parts_of(dealt_out.repartition(1 << bits - PART, "part").mapInArrow(add, "part int, bits binary")):
        out[p * (width >> 3) : (p + 1) * (width >> 3)] = np.frombuffer(x, np.uint8)
    return out.tobytes(), bits


def has(values: np.ndarray, shared: tuple[bytes, int]) -> np.ndarray:
    """Which of the values lie in a slot of the bitmap."""
    raw, bits = shared
    slot = values >> np.uint64(64 - bits)
    return np.frombuffer(raw, np.uint8)[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def places_of_shared(lists: pa.ListArray, shared: tuple[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a column of lists that shared_bits has, the row of each, and its place among all values."""
    values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    keep = np.flatnonzero(has(values.view(np.uint64), shared))
    return values[keep], np.repeat(np.arange(len(sizes)), sizes)[keep], keep
