"""Token ids in files of fixed-width bit-packed blocks.

A file is a row (shard, block, doc_ids, n_ids, data); Spark's writer stores the rows, so that any file system that
Spark reaches will do and lost tasks are redone whole. data holds, little-endian:

    4 bytes   magic "TKB1"
    uint8     bits of an id: the least that the vocabulary needs
    uint32    documents of the block
    uint64    ids in the shard before this block
    uint64 x documents    where each document ends, in ids from the block's start
    groups of eight ids, each of as many bytes as an id has bits; an id's bits run from low to high

The eight ids of a group start at known bits, so a block unpacks by lanes and any id is read without those before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_lake.llm.common import materialise, table
from transcript_lake.llm.tokens import vocabulary, word_tokenizer

MAGIC = b"TKB1"
HEAD = struct.Struct("<4sBIQ")

#: Ids after which a block ends with the document that it is in.
BLOCK_IDS = 65_536

#: Characters of text that a task encodes at once.
SLICE_CHARS = 4_000_000

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, bits at most 32, as groups of eight; the last group is filled with zeros."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        at, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, at + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, count: int, bits: int, first: int = 0) -> np.ndarray:
    """count ids from the first-th on."""
    lo, hi = first // 8, -(-(first + count) // 8)
    groups = np.frombuffer(data, np.uint8, (hi - lo) * bits, lo * bits).reshape(-1, bits)
    out = np.zeros((hi - lo, 8), np.uint32)
    for lane in range(8):
        at, shift = divmod(lane * bits, 8)
        value = np.zeros(hi - lo, np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= groups[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[first - 8 * lo : first - 8 * lo + count]


def block(ends: list[int], ids: np.ndarray, bits: int, before: int) -> bytes:
    return HEAD.pack(MAGIC, bits, len(ends), before) + np.array(ends, "<u8").tobytes() + pack(ids, bits)


class Block:
    """A block's bytes, open for reading."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, n, self.before = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of packed token ids")
        self.ends = np.frombuffer(data, "<u8", n, HEAD.size).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.packed = memoryview(data)[HEAD.size + 8 * n :]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        return unpack(self.packed, hi - lo, self.bits, lo)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.ends[k]))


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in slices of about `most` characters, with the texts; null texts are empty."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        lo, chars = 0, 0
        for hi, x in enumerate(texts, 1):
            chars += len(x or "")
            if chars >= most or hi == len(texts):
                yield batch.slice(lo, hi - lo), [x or "" for x in texts[lo:hi]]
                lo, chars = hi, 0


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes the texts, ends each with end_id and writes the files; shards, blocks and documents ascend by doc_id.

    Null text: only the end id. Null doc_id: first. Rows that share a doc_id: by a hash of the text, which also spreads
    them over shards. No rows: no files. Other columns are ignored. Texts are dealt by ranges of doc_id before they are
    encoded, so that ids are made once and never shuffled."""
    path = path or vocabulary(VOCABULARY)

    def encode(batches):
        tokenizer, shard = word_tokenizer(path), TaskContext.get().partitionId()
        bits = bits_for(max(tokenizer.vocab_size, end_id + 1))
        before, number, doc_ids, ends, parts, size = 0, 0, [], [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": number, "doc_ids": doc_ids, "n_ids": size, "data": block(ends, np.concatenate(parts), bits, before)}], SCHEMA)

        for batch, texts in slices(batches, 1):
            ids, starts = tokenizer.encode(texts, end_id)
            for key, lo, hi in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                parts.append(ids[lo:hi])
                size += hi - lo
                doc_ids.append(key)
                ends.append(size)
                if size >= BLOCK_IDS:
                    yield row()
                    before, number, doc_ids, ends, parts, size = before + size, number + 1, [], [], [], 0
        if ends:
            yield row()

    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return materialise(dealt.select("doc_id", "text").mapInArrow(encode, "shard int, block int, doc_ids array<long>, n_ids long, data binary"), "token-files")


SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())])
READ = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers."""

    def decode(batches):
        for batch in batches:
            for shard, keys, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                x = Block(data)
                raw = memoryview(x.ids(0, int(x.ends[-1])).astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(x.starts.tolist(), x.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(x.before + x.starts), pa.array(x.ends - x.starts), pa.array(sums, pa.int64())], schema=READ)

    found = files.select("shard", "doc_ids", "data").mapInArrow(decode, "shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    first = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("first"))
    # one row a shard, of which there are as many as tasks wrote
    return found.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
