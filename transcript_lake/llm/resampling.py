"""Importance resampling towards a target distribution, by hashed n-grams whose CRCs come from prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.binary import slices
from transcript_lake.llm.common import materialise, running_start, table

BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
NGRAM = 1

#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)

#: Bytes that one row of the scan holds; all rows of a slice take a step together.
ROW = 64

#: Characters of text scanned at once.
SCANNED_CHARS = 1_000_000


def _steps() -> np.ndarray:
    """What one zero byte makes of each low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


STEP = _steps()


def over_zero(crc: np.ndarray) -> np.ndarray:
    """The registers after one more zero byte."""
    return STEP[crc & 255] ^ (crc >> 8)


def times(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map over GF(2), given by what it makes of each of the four bytes, of many registers."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(maxsize=64)
def shift_tables(power: int) -> np.ndarray:
    """The map of 2**power zero bytes, each the square of the one before."""
    if power:
        half = shift_tables(power - 1)
        return np.stack([times(half, t) for t in half])
    return np.stack([over_zero(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each register after its own number of zero bytes, by the binary digits of the number."""
    out, power = crc.copy(), 0
    while len(zeros) and (left := zeros >> power).any():
        at = np.flatnonzero(left & 1)
        out[at] = times(shift_tables(power), out[at])
        power += 1
    return out


def prefix_crcs(data: np.ndarray) -> np.ndarray:
    """The register (from 0, not inverted) after each prefix of the bytes, the empty one first. The bytes are laid in rows
    that advance a byte a step, all together; what comes in from the rows before is scanned likewise and added, as the register
    is linear over GF(2)."""
    n = len(data)
    if not n:
        return np.zeros(1, np.uint32)
    rows = -(-n // ROW)
    cells = np.zeros(rows * ROW, np.uint8)
    cells[:n] = data
    columns = np.ascontiguousarray(cells.reshape(rows, ROW).T)
    own = np.empty((ROW, rows), np.uint32)
    crc = np.zeros(rows, np.uint32)
    for k in range(ROW):
        crc = STEP[(crc ^ columns[k]) & 255] ^ (crc >> 8)
        own[k] = crc
    carry = carried(crc, ROW.bit_length() - 1)
    for k in range(ROW):
        carry = over_zero(carry)
        own[k] ^= carry
    return np.concatenate([np.zeros(1, np.uint32), own.T.reshape(-1)[:n]])


def carried(ends: np.ndarray, power: int) -> np.ndarray:
    """What comes into each row of 2**power bytes, from what each row makes of its own bytes: a scan in rows of rows."""
    n = len(ends)
    jump = shift_tables(power)
    if n <= ROW:
        out, at = np.zeros(n, np.uint32), np.zeros(1, np.uint32)
        for k in range(n):
            out[k] = at[0]
            at = times(jump, at) ^ ends[k : k + 1]
        return out
    rows = -(-n // ROW)
    cells = np.zeros(rows * ROW, np.uint32)
    cells[:n] = ends
    columns = cells.reshape(rows, ROW).T
    before, crc = np.empty((ROW, rows), np.uint32), np.zeros(rows, np.uint32)
    for k in range(ROW):
        before[k] = crc
        crc = times(jump, crc) ^ columns[k]
    add = carried(crc, power + ROW.bit_length() - 1)
    for k in range(ROW):
        before[k] ^= add
        add = times(jump, add)
    return before.T.reshape(-1)[:n]


def substring_crcs(prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each [start, end) of the bytes, from two prefixes: what stands before start, shifted over the substring's
    length, cancels; the same shift carries the initial ones of a CRC in."""
    return prefixes[ends] ^ shifted(prefixes[starts] ^ ONES, ends - starts) ^ ONES


#: Bytes that are part of a word, once letters are lower.
IN_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row as UTF-8, A-Z in lower case, each run of separators as one space; each word's start and end in it,
    and the first word of each text (and the end)."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    inside = IN_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    keep = inside.copy()
    keep[ends] = True  # the byte after a word stands for the separators
    data = np.where(inside, data, np.uint8(32))[keep]
    lengths = ends - starts
    ends = np.cumsum(lengths + 1) - 1
    return data, ends - lengths, ends, first


def feature_buckets(texts: list[str], ngram: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets of each text's features, runs of 1 to ngram words joined by a space, repeats and all; and its words' number."""
    data, starts, ends, first = normalised(texts)
    prefixes = prefix_crcs(data)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    found = []
    for n in range(1, ngram + 1):
        k = np.arange(max(0, len(starts) - n + 1))
        k = k[owner[k] == owner[k + n - 1]]
        crc = substring_crcs(prefixes, starts[k], ends[k + n - 1])
        found.append((owner[k], (crc % np.uint32(buckets)).astype(np.int32)))
    if ngram == 1:
        return np.split(found[0][1], first[1:-1]), np.diff(first)
    owners, all_ = np.concatenate([o for o, _ in found]), np.concatenate([b for _, b in found])
    order = np.argsort(owners, kind="stable")
    return np.split(all_[order], np.searchsorted(owners[order], np.arange(1, len(texts)))), np.diff(first)


def counted(docs: DataFrame, text: str, ngram: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket. Each task sends one array; buckets are summed by Spark, and as many
    rows as there are buckets come to the driver, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for _, texts in slices(batches, 0, SCANNED_CHARS):
            for found in feature_buckets(texts, ngram, buckets)[0]:
                sums += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(all_: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the logarithm of the target's smoothed share over the corpus's, floored."""
    n = len(all_)
    up = (target + 1).astype(float) * float(all_.sum() + n)
    down = (all_ + 1).astype(float) * float(target.sum() + n)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighted(docs: DataFrame, worth: np.ndarray, text: str, doc_id: str, ngram: int) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features and weight, the floored mean of its features' gains (none: 0)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1, SCANNED_CHARS):
            found, words = feature_buckets(texts, ngram, len(worth))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            sums = np.fromiter((worth[x].sum() for x in found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """A thousand times a Gumbel variate, fixed by seed and doc_id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score (weight and seeded Gumbel noise) and rank: of the documents with
    min_words words or more, the highest percent of 100 scores are drawn, ties to the smaller doc_id; others have none.

    Null text: no words, weight 0. Null doc_id: last among ties, with noise of its own. Rows that share a doc_id share their
    noise and are drawn each on its own, in any order among equal ones. An empty target: all features gain by smoothing
    only. No rows: no rows. Other columns are ignored. Texts are scanned twice, so nothing as large as they are is stored; ranks
    are places in ranges of the order, whose tasks need no more than the rows' scores."""
    worth = gains(counted(docs, text, ngram, buckets), counted(target, target_text, ngram, buckets))
    scored = weighted(docs, worth, text, doc_id, ngram).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialise(scored, "resampled")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    # no more than the drawn and their ties are put in order: every score above the least that is drawn
    by_score = F.desc("score")
    sums = running_start(able.groupBy("score").agg(F.count("*").alias("n")), [by_score], F.col("n"), "before")
    (least,) = sums.where(F.col("before") < drawn).agg(F.min("score")).first()
    top = F.col("score") >= F.lit(least) if least is not None else F.lit(False)
    high = F.coalesce((F.col("n_words") >= min_words) & top, F.lit(False))
    ranked = running_start(scored.where(high), [by_score, F.asc_nulls_last("doc_id")], F.lit(1), "before")
    rank = F.when(F.col("before") < drawn, F.col("before") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).union(scored.where(~high).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH tab AS (
  SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) r(i))),
low AS (
  SELECT row_number() OVER () AS r, doc_id, FALSE AS aim, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS t FROM documents
  UNION ALL SELECT row_number() OVER (), NULL, TRUE, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') FROM benchmark),
one AS (SELECT r, aim, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
crcs AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(w)), lambda k: ('0x' || substr(hex(encode(w)), (2 * k + 1)::BIGINT, 2))::BIGINT), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT w FROM one), tab),
f AS (SELECT r, aim, b FROM one JOIN crcs USING (w)),
sums AS (SELECT b, count(*) FILTER (NOT aim) AS s, count(*) FILTER (aim) AS t FROM f GROUP BY b),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gain AS (SELECT b, floor(1000 * ln(((sums.t + 1)::DOUBLE * (whole.s + 10000)::DOUBLE) / ((sums.s + 1)::DOUBLE * (whole.t + 10000)::DOUBLE)))::BIGINT AS g FROM sums, whole),
w AS (SELECT r, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM f JOIN gain USING (b) WHERE NOT aim GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM low LEFT JOIN w USING (r) WHERE NOT aim),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN k END AS rank FROM ranked
"""
