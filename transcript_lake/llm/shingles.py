"""Word and shingle hashes of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Characters of text that are hashed at once; each takes some 60 bytes meanwhile.
HASHED_CHARS = 1_000_000

#: Words of more bytes are hashed one by one.
LONG_WORD = 256

#: MASKS[n] keeps the first n bytes of eight, little-endian.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, the index of each text's first word (and the end),
    and each word's first and last byte in the UTF-8 texts joined by newlines. Eight bytes of every word are mixed in at
    a step, so no sum over letters can make unlike words equal; very long words take a cryptographic hash."""
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    n = len(data) - 8
    blank = (data[:n] == 32) | ((data[:n] >= 9) & (data[:n] <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    eight = np.ndarray((n + 1,), "<u8", buffer=data, strides=(1,))
    length = ends - starts
    hashes = mix(length.astype(np.uint64) * PRIME)
    step, active = 0, np.arange(len(starts))
    while len(active) and step < LONG_WORD:
        hashes[active] = mix(hashes[active] ^ (eight[starts[active] + step] & MASKS[np.minimum(length[active] - step, 8)]))
        step += 8
        active = active[length[active] > step]
    for k in active.tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, first, starts, ends


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a sequence of hashes."""
    return hashlib.blake2b(np.ascontiguousarray(hashes).tobytes(), digest_size=16).digest()


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; of fewer words, the whole sequence as one; of none, none."""
    words, first, _, _ = word_hashes(texts)
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        whole = whole * PRIME + words[j : j + len(whole)]
    whole = mix(whole)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(whole[lo : hi - k + 1]))
        else:
            x = np.full(min(1, hi - lo), hi - lo, np.uint64)
            for w in words[lo:hi]:
                x = x * PRIME + w
            out.append(mix(x ^ np.uint64(0x5851F42D4C957F2D)))
    return out
