"""A media column of FLAC streams: encoding, checked decoding, PCM with seekable sample offsets.

Streams are mono, 8 bits a sample, 8 kHz, in frames of 192 samples. Both directions work on all frames of a batch at
once: a step handles one sample, or one byte, of every frame. decode_stream is the plain decoder of one stream, for any
mono stream; the fast one gives up what it does not know (other frame sizes, partitions, escapes) to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.common import materialise, table, unused

FRAME = 192
SEEK_FRAMES = 64
RATE = 8000

#: Sync code and fixed block size; 192 samples at 8 kHz; one channel of 8 bits.
START = np.array([0xFF, 0xF8, 0x14, 0x02], np.uint8)

#: Bytes of payload that are encoded or decoded at once.
BATCH_BYTES = 2_000_000

#: Precision and shift of the quantised second-order predictor.
PRECISION, SHIFT = 10, 7


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint32)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def checksums(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of buf[start : start + length] for each, a byte of all at a step."""
    rows, tab = np.argsort(-lengths, kind="stable"), CRC8 if bits == 8 else CRC16
    at, crc = starts[rows], np.zeros(len(rows), np.uint32)
    active = len(rows) - np.searchsorted(lengths[rows][::-1], np.arange(int(lengths.max(initial=0))), "right")
    for j, n in enumerate(active.tolist()):
        part = crc[:n]
        crc[:n] = ((part << np.uint32(8)) & np.uint32((1 << bits) - 1)) ^ tab[(part >> np.uint32(bits - 8)) ^ buf[at[:n] + j]]
    out = np.empty_like(crc)
    out[rows] = crc
    return out


def number_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 of frame headers: six bytes each, and how many count."""
    out, size = np.zeros((len(numbers), 6), np.uint8), 1 + sum((numbers >= x).astype(np.int64) for x in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    for n in range(1, 7):
        rows = np.flatnonzero(size == n)
        x = numbers[rows]
        if n == 1:
            out[rows, 0] = x
        else:
            out[rows, 0] = (0xFF00 >> n & 0xFF) | (x >> (6 * (n - 1)))
            for k in range(1, n):
                out[rows, k] = 0x80 | (x >> (6 * (n - 1 - k)) & 63)
    return out, size


def rice(res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter and bits of each row of residuals; rows with a code too long for one read cost too much."""
    folded = ((res << 1) ^ (res >> 31)).astype(np.uint16)
    most, cost = folded.max(axis=1), []
    for k in range(9):
        x = (folded >> k).sum(axis=1, dtype=np.int64) + folded.shape[1] * (k + 1)
        cost.append(np.where((most >> k) > 40, 1 << 30, x))
    cost = np.stack(cost)
    return cost.argmin(axis=0), cost.min(axis=0)


def second_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of the best second-order predictor of each row, by its autocorrelation, and the residuals."""
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = np.maximum(r0 * r0 - r1 * r1, 1)
    top = (1 << PRECISION - 1) - 1
    c = np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    c = np.clip(np.rint(c * (1 << SHIFT)), -top, top).astype(np.int32)
    return c, x[:, 2:] - ((c[:, :1] * x[:, 1:-1] + c[:, 1:] * x[:, :-2]) >> SHIFT)


def encode_frames(payload: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FRAME-byte rows of payload and their frame numbers -> all frames' bytes, and each frame's length."""
    x = payload.reshape(-1, FRAME).astype(np.int32) - 128
    n = len(x)
    trials = [(0, x), (1, np.diff(x, 1)), (2, np.diff(x, 2))]
    coef, res = second_order(x)
    trials.append((34, res))  # 32 and the order less one, twice: see kind below
    bits, params = np.full(n, 8 * FRAME), np.zeros(n, np.int64)
    kind = np.full(n, -1)  # -1 verbatim, 0 to 2 fixed order, 34 linear prediction of order 2
    for name, r in trials:
        k, cost = rice(r)
        cost = cost + 10 + 8 * (FRAME - r.shape[1]) + (9 + 2 * PRECISION if name == 34 else 0)
        better = cost < bits
        bits[better], params[better], kind[better] = cost[better], k[better], name
    digits, digit_size = number_bytes(numbers)
    head = 4 + digit_size + 1
    size = head + 1 + (bits + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = int(size.sum())
    ends_at, values = [], []

    def put(last: np.ndarray, value: np.ndarray) -> None:
        """value, its lowest bit at bit last - 1 counted from the buffer's start."""
        ends_at.append(last.reshape(-1))
        values.append(value.reshape(-1))

    body = 8 * (starts + head)
    put(body + 8, np.select([kind == -1, kind == 34], [2, 2 * 33], 2 * (8 + kind)))
    rows = np.flatnonzero(kind == -1)
    put(body[rows, None] + 16 + 8 * np.arange(FRAME), (x[rows] & 255))
    for name, r in trials:
        rows = np.flatnonzero(kind == name)
        if not len(rows):
            continue
        order = FRAME - r.shape[1]
        at = body[rows] + 8
        if order:
            put(at[:, None] + 8 * (np.arange(order) + 1), x[rows, :order] & 255)
            at = at + 8 * order
        if name == 34:
            put(at + 4, np.full(len(rows), PRECISION - 1))
            put(at + 9, np.full(len(rows), SHIFT))
            put(at[:, None] + 9 + PRECISION * (np.arange(2) + 1), coef[rows] & (1 << PRECISION) - 1)
            at = at + 9 + 2 * PRECISION
        put(at + 10, params[rows])
        k = params[rows, None]
        folded = (r[rows] << 1) ^ (r[rows] >> 31)
        put(at[:, None] + 10 + np.cumsum((folded >> k) + 1 + k, axis=1), (1 << k) | folded & (1 << k) - 1)
    last, value = np.concatenate(ends_at), np.concatenate(values).astype(np.int64)
    byte, shift = (last - 1) >> 3, (-last) & 7
    value <<= shift
    # codes share bytes but no bits, so sums are unions
    out = np.bincount(byte, value & 255, total) + np.bincount(byte - 1, value >> 8 & 255, total) + np.bincount(byte - 2, value >> 16, total)
    out = out.astype(np.uint8)
    for j in range(4):
        out[starts + j] = START[j]
    for j in range(6):
        rows = np.flatnonzero(digit_size > j)
        out[starts[rows] + 4 + j] = digits[rows, j]
    out[starts + head - 1] = checksums(out, starts, head - 1, 8)
    crc = checksums(out, starts, size - 2, 16)
    out[starts + size - 2], out[starts + size - 1] = crc >> 8, crc & 255
    return out, size


def wrapped(frames: bytes, sizes: np.ndarray, payload: bytes) -> bytes:
    """Stream marker, stream information and seek table, then the frames."""
    n = len(payload)
    info = FRAME.to_bytes(2) * 2 + int(sizes.min()).to_bytes(3) + int(sizes.max()).to_bytes(3)
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8) + hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[::SEEK_FRAMES].tolist()
    seek = b"".join((k * SEEK_FRAMES * FRAME).to_bytes(8) + x.to_bytes(8) + FRAME.to_bytes(2) for k, x in enumerate(at))
    return b"fLaC\0\0\0\x22" + info + b"\x83" + len(seek).to_bytes(3) + seek + frames


def encode(payloads: list[bytes]) -> list[bytes]:
    """Payloads of whole frames as FLAC streams."""
    counts = np.array([len(x) // FRAME for x in payloads])
    numbers = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out, sizes = encode_frames(np.frombuffer(b"".join(payloads), np.uint8), numbers)
    raw, ends, first, done = memoryview(out.tobytes()), np.cumsum(sizes), 0, []
    for x, n in zip(payloads, counts.tolist(), strict=True):
        lo = int(ends[first - 1]) if first else 0
        done.append(wrapped(bytes(raw[lo : int(ends[first + n - 1])]), sizes[first : first + n], x))
        first += n
    return done


class Bits:
    """The bits of one stream, read one field at a time."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, 8 * at

    def read(self, n: int) -> int:
        lo, hi = self.at >> 3, -(-(self.at + n) // 8)
        if hi > len(self.data):
            raise ValueError("the stream ends within a frame")
        value = int.from_bytes(self.data[lo:hi]) >> (8 * hi - self.at - n) & (1 << n) - 1
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def zeros(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
        return n


def crc_of(data: bytes, bits: int) -> int:
    tab, crc = CRC8 if bits == 8 else CRC16, 0
    for x in data:
        crc = (crc << 8 & (1 << bits) - 1) ^ int(tab[(crc >> bits - 8) ^ x])
    return crc


def subframe(b: Bits, n: int, depth: int) -> list[int]:
    head = b.read(8)
    if head & 0x80:
        raise ValueError("bad subframe")
    kind, wasted = head >> 1 & 63, 0
    if head & 1:
        wasted = b.zeros() + 1
        depth -= wasted
    if kind == 0:
        out = [b.signed(depth)] * n
    elif kind == 1:
        out = [b.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(depth) for _ in range(order)]
        if kind < 32:
            coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            precision, shift = b.read(4) + 1, b.signed(5)
            coef = [b.signed(precision) for _ in range(order)]
        wide, parts = (4, 5)[b.read(2)], b.read(4)
        for part in range(1 << parts):
            k = b.read(wide)
            raw = b.read(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if part == 0 else 0)):
                if raw is None:
                    u = b.zeros() << k | b.read(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = b.signed(raw)
                guess = sum(c * x for c, x in zip(coef, out[: -order - 1 : -1], strict=True)) if order else 0
                out.append(r + (guess >> shift))
    else:
        raise ValueError("reserved subframe")
    return [x << wasted for x in out]


def metadata(data: bytes) -> tuple[int, int, int, bytes]:
    """Where the frames begin, samples, bits a sample, and the MD5 of the samples."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info = 4, None
    while True:
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
        if last:
            break
    x = int.from_bytes(info[10:18])
    if x >> 41 & 7:
        raise ValueError("only mono streams are read")
    return at, x & (1 << 36) - 1, (x >> 36 & 31) + 1, info[18:34]


def decode_stream(data: bytes) -> list[int]:
    """The samples of a mono stream, field by field; header and frame checksums are verified."""
    at, total, depth, _ = metadata(data)
    out: list[int] = []
    while len(out) < total:
        b = Bits(data, at)
        if b.read(15) != 0x7FFC:
            raise ValueError("no frame here")
        b.read(1)
        size, rate, channel, bits = b.read(4), b.read(4), b.read(4), b.read(3)
        b.read(1)
        first = b.read(8)
        for _ in range(0 if first < 0x80 else 7 - (first ^ 0xFF).bit_length()):
            b.read(8)
        n = 192 if size == 1 else 576 << size - 2 if size <= 5 else b.read(8) + 1 if size == 6 else b.read(16) + 1 if size == 7 else 256 << size - 8
        b.read((0, 8, 16, 16)[max(0, rate - 11)] if rate >= 12 else 0)
        head = b.at >> 3
        if channel or crc_of(data[at:head], 8) != b.read(8):
            raise ValueError("bad frame header")
        out += subframe(b, n, {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(bits, depth))
        end = -(-b.at // 8)
        if crc_of(data[at:end], 16) != int.from_bytes(data[end : end + 2]):
            raise ValueError("bad frame checksum")
        at = end + 2
    return out[:total]


def frame_starts(buf: np.ndarray, lo: int, hi: int, first: int = 0) -> np.ndarray:
    """Where the frames of a stream in buf[lo:hi] begin: sync codes whose numbers go up by one from first."""
    x = buf[lo:hi]
    at = np.flatnonzero((x[:-8] == 0xFF) & (x[1:-7] == 0xF8) & (x[2:-6] == 0x14) & (x[3:-5] == 0x02)) + lo
    want, kept = 0, []
    digits, sizes = number_bytes(first + np.arange(len(at) + 1))
    for k in at.tolist():
        n = int(sizes[want])
        if (buf[k + 4 : k + 4 + n] == digits[want, :n]).all():
            kept.append(k)
            want += 1
    return np.array(kept, np.int64)


def residuals(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n residuals of each frame whose residual part begins at bit at, as rows of samples; and which frames are plain.
    words: the 64 bits from each byte on."""
    read = lambda p, bits: (words[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(64 - bits)
    head = read(at, 10).astype(np.int64)
    k = head & 15
    plain, p, out = (head >> 4 == 0) & (k != 15), at + 10, np.empty((n, len(at)), np.int32)
    above, low, one = (63 - k).astype(np.uint64), k.astype(np.uint64), np.uint64(1)
    for j in range(n):
        w = words[p >> 3] << (p & 7).astype(np.uint64)
        top = w >> np.uint64(11)
        plain &= top != 0
        q = np.minimum(1075 - (top.astype(np.float64).view(np.int64) >> 52), 52)
        rest = w << (q.astype(np.uint64) + one)
        u = (q.astype(np.uint64) << low | (rest >> one) >> above).astype(np.int64)
        out[j] = u >> 1 ^ -(u & 1)
        p += q + 1 + k
        np.minimum(p, 8 * (len(words) - 1), out=p)
    return out, plain


def decode_frames(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each frame (rows), and which frames were decoded with both checksums right."""
    good = (checksums(buf, starts, sizes - 2, 16) == (buf[starts + sizes - 2].astype(np.uint32) << 8 | buf[starts + sizes - 1])) & (sizes > 8)
    head = 4 + number_bytes(numbers)[1]
    good &= checksums(buf, starts, head, 8) == buf[starts + head]
    words = np.zeros(len(buf) - 7, np.uint64)
    for j in range(8):
        words |= buf[j : len(words) + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    body = starts + head + 1
    kind, out = buf[body], np.zeros((len(starts), FRAME), np.int32)
    signed = lambda x, bits: (x ^ 1 << bits - 1) - (1 << bits - 1)
    for name in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == name)
        at, kind_of = body[rows] + 1, name >> 1
        warm = lambda n: signed(buf[at[:, None] + np.arange(n)].astype(np.int32), 8)  # noqa: E731, B023
        if name & 0x81:
            good[rows] = False
        elif kind_of == 0:
            out[rows] = warm(1)
        elif kind_of == 1:
            out[rows] = warm(FRAME)
        elif 8 <= kind_of <= 12:
            order = kind_of - 8
            res, plain = residuals(words, 8 * (at + order), FRAME - order)
            good[rows] &= plain
            x = res.T
            for d in range(order - 1, -1, -1):  # undo the differences, outermost last
                start = np.diff(warm(order), d)[:, :1]
                x = np.cumsum(np.concatenate([start, x], axis=1), axis=1)
            out[rows] = x
        elif kind_of >= 32:
            order = kind_of - 31
            p = 8 * (at + order)
            read = lambda p, bits: ((words[p >> 3] << (p & 7).astype(np.uint64)) >> (64 - bits).astype(np.uint64)).astype(np.int64)
            precision, shift = read(p, np.full(len(p), 4)) + 1, read(p + 4, np.full(len(p), 5))
            coef = []
            for j in range(order):
                c = read(p + 9 + j * precision, precision)
                coef.append((c ^ 1 << precision - 1) - (1 << precision - 1))
            res, plain = residuals(words, p + 9 + order * precision, FRAME - order)
            good[rows] &= plain & (shift < 16)
            x = np.empty((FRAME, len(rows)), np.int64)
            x[:order] = warm(order).T
            for j in range(order, FRAME):
                guess = coef[0] * x[j - 1]
                for d in range(1, order):
                    guess += coef[d] * x[j - 1 - d]
                x[j] = res[j - order] + (guess >> shift)
            out[rows] = x.T
        else:
            good[rows] = False
    return out, good


def decode(streams: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """PCM (unsigned 8-bit samples) of each stream and the byte offset in it, by frames, of the seek points.
    Checksums and the MD5 are verified; streams that the fast way does not know go the plain way."""
    buf = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    at, first, per = 0, [], []
    for x in streams:
        lo = at + metadata(x)[0]
        starts = frame_starts(buf, lo, at + len(x))
        per.append((starts, at + len(x)))
        first.append(lo)
        at += len(x)
    starts = np.concatenate([s for s, _ in per])
    sizes = np.concatenate([np.diff(np.append(s, end)) for s, end in per])
    numbers = np.concatenate([np.arange(len(s)) for s, _ in per])
    samples, good = decode_frames(buf, starts, sizes, numbers)
    pcm, done, out = (samples + 128).astype(np.uint8), 0, []
    for x, (s, _), lo in zip(streams, per, first, strict=True):
        _, total, depth, md5 = metadata(x)
        n = len(s)
        if depth == 8 and n * FRAME == total and good[done : done + n].all() and bool(n) and s[0] == lo:
            raw = pcm[done : done + n].tobytes()
        else:
            raw = np.array([y + 128 for y in decode_stream(x)], np.uint8).tobytes()
        if hashlib.md5((np.frombuffer(raw, np.uint8) ^ 128).tobytes()).digest() != md5:
            raise ValueError("the samples' MD5 differs")
        out.append((raw, (s[::SEEK_FRAMES] - lo).tolist()))
        done += n
    return out


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in slices of about BATCH_BYTES of a text or binary column."""
    for batch in batches:
        values = batch.column(column).cast(pa.binary()).to_pylist()
        lo, size = 0, 0
        for hi, x in enumerate(values, 1):
            size += len(x or b"")
            if size >= BATCH_BYTES or hi == len(values):
                yield batch.slice(lo, hi - lo), values[lo:hi]
                lo, size = hi, 0


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled with blanks to whole frames, as a FLAC stream.

    Null or empty text: one frame of blanks. Each row on its own. No rows: no rows. Other columns are ignored."""

    def run(batches):
        for batch, values in parts(batches, 1):
            raw = [x or b"" for x in values]
            media = encode([x.ljust(max(1, -(-len(x) // FRAME)) * FRAME) for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """media (with a column media of FLAC streams) with pcm, seek (sample and byte offset of the seek points) and feature.

    feature: samples, mean and root mean square in sixteenths, peak, and crossings of zero of the decoded samples.
    A damaged stream fails the task; null media gives nulls."""
    rest = [c for c in media.columns if c not in ("media", "pcm", "seek", "feature")]

    def run(batches):
        for batch, values in parts(batches, len(rest)):
            here = [x for x in values if x is not None]
            got = iter(decode(here) if here else [])
            pcm, seek, feature = [], [], []
            for x in values:
                raw, points = next(got) if x is not None else (None, None)
                pcm.append(raw)
                seek.append(points and [{"sample": k * SEEK_FRAMES * FRAME, "byte": p} for k, p in enumerate(points)])
                feature.append(raw and features(raw))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(rest) + 1)], pa.array(pcm, pa.binary()), pa.array(seek, pa.list_(pa.struct([("sample", pa.int64()), ("byte", pa.int64())]))), pa.array(feature, pa.string())], names=[*rest, "media", "pcm", "seek", "feature"])

    schema = ", ".join(f"`{c}` {t}" for c, t in media.select(*rest).dtypes) + ", media binary, pcm binary, seek array<struct<sample: long, byte: long>>, feature string"
    return media.select(*rest, "media").mapInArrow(run, schema)


def read_block(stream: bytes, sample: int, byte: int) -> bytes:
    """The PCM block that begins at a seek point (its sample, and its byte from the first frame), decoded from there without
    the frames before: up to SEEK_FRAMES frames, with their checksums verified."""
    lo, first = metadata(stream)[0] + byte, sample // FRAME
    most = lo + SEEK_FRAMES * (FRAME + 20)  # a frame is never longer than its samples as they are, with its header and checksums
    buf = np.frombuffer(stream[lo:most] + bytes(16), np.uint8)
    end = len(buf) - 16
    starts = frame_starts(buf, 0, end, first)[: SEEK_FRAMES + 1]
    sizes = np.diff(np.append(starts, end) if len(starts) <= SEEK_FRAMES else starts)
    samples, good = decode_frames(buf, starts[: len(sizes)], sizes, first + np.arange(len(sizes)))
    if not len(sizes) or starts[0] or not good.all():
        raise ValueError("no intact block here")
    return (samples + 128).astype(np.uint8).tobytes()


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """Of what decode_media returns, a row a block of SEEK_FRAMES frames: the columns of decoded but media, pcm, seek and
    feature, and sample (its offset, in samples), byte (of its first frame in the stream, from the first one), and pcm, the
    block's samples. Ordered by sample, the blocks are the stream's PCM. Null media: no block. Columns of these names are replaced."""
    rest = [c for c in decoded.columns if c not in ("media", "pcm", "seek", "feature", "sample", "byte")]
    (point,) = unused(decoded, "point")
    rows = decoded.select(*[F.col(f"`{c}`") for c in rest], "pcm", F.explode("seek").alias(point))
    at = F.col(point)["sample"]
    return rows.select(*[F.col(f"`{c}`") for c in rest], at.alias("sample"), F.col(point)["byte"].alias("byte"), F.col("pcm").substr(at.cast("int") + 1, F.lit(SEEK_FRAMES * FRAME)).alias("pcm"))


def features(pcm: bytes) -> str:
    x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    return f"samples={len(x)} mean16={16 * int(x.sum()) // len(x)} rms16={int(16 * (float((x * x).sum()) / len(x)) ** 0.5)} peak={int(np.abs(x).max())} crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written, and all but the count of text bytes is computed from what is read back."""
    stored = materialise(encode_documents(table(spark, sf_dir, "documents")), "media")
    found = decode_media(stored)
    return found.select(
        "doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pcm, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.array_join(F.transform("seek", lambda p: F.concat_ws(":", p["sample"], p["byte"])), ",").alias("seek"),
    )
