"""FLAC round trips, the fast decoder against the plain one, and damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from transcript_lake.llm import flac


def payloads():
    rng = random.Random(5)
    words = ["the", "of", "éa", "thing", "  ", "\n", "日本", "0123", "####"]
    out = [" ".join(rng.choice(words) for _ in range(n)).encode() for n in (1, 5, 60, 400, 9000)]
    out += [bytes(rng.randrange(256) for _ in range(700)), bytes(192), b"\xff" * 400, bytes([0, 255] * 300), bytes(i // 3 % 256 for i in range(1500))]
    return [x.ljust(max(1, -(-len(x) // 192)) * 192) for x in out] + [b" " * 192]


def test_round_trip_both_ways():
    raw = payloads()
    streams = flac.encode(raw)
    assert [x for x, _ in flac.decode(streams)] == raw
    for x, s in zip(raw, streams, strict=True):
        if len(x) < 20_000:
            assert bytes(y + 128 for y in flac.decode_stream(s)) == x
    slope = bytes(i // 3 % 256 for i in range(192 * 64))
    assert len(flac.encode([slope])[0]) < len(slope) / 2


def test_seek_points_are_frames():
    raw = payloads()
    for x, (_, seek), s in zip(raw, flac.decode(flac.encode(raw)), flac.encode(raw), strict=True):
        at = flac.metadata(s)[0]
        assert len(seek) == -(-len(x) // (192 * 64))
        assert all(s[at + p : at + p + 2] == b"\xff\xf8" for p in seek)


def test_damage_is_found():
    stream = bytearray(flac.encode([payloads()[3]])[0])
    stream[len(stream) // 2] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_plain_decoder_reads_partitions_and_escapes():
    """A frame of 192 samples, order 1, two Rice partitions, one of them escaped, put together bit by bit."""
    x = [int(50 * np.sin(i / 9)) for i in range(192)]
    res = [b - a for a, b in zip(x, x[1:], strict=False)]
    bits = f"{(8 + 1) << 1:08b}{x[0] & 255:08b}00{1:04b}"
    part = lambda rs: "".join("0" * ((2 * r if r >= 0 else -2 * r - 1) >> 2) + f"1{(2 * r if r >= 0 else -2 * r - 1) & 3:02b}" for r in rs)
    bits += f"{2:04b}" + part(res[:95]) + f"{15:04b}{6:05b}" + "".join(f"{r & 63:06b}" for r in res[95:])
    bits += "0" * (-len(bits) % 8)
    head = bytes(flac.START) + b"\0"
    head += bytes([flac.crc_of(head, 8)])
    frame = head + int(bits, 2).to_bytes(len(bits) // 8)
    frame += flac.crc_of(frame, 16).to_bytes(2)
    pcm = bytes(v + 128 for v in x)
    stream = flac.wrapped(frame, np.array([len(frame)]), pcm)
    assert flac.decode_stream(stream) == x
    assert flac.decode([stream])[0][0] == pcm


def test_documents(spark):
    rows = [(1, "abc", "x"), (2, None, "y"), (3, "", "z"), (None, "é" * 500, None), (1, "abc", "x"), (9, "lorem ipsum " * 4000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = flac.decode_media(flac.encode_documents(docs)).collect()
    assert len(got) == len(rows)
    for key, text, _ in rows:
        raw = (text or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        found = [r for r in got if r.doc_id == key and r.n_bytes == len(raw)]
        assert found and all(bytes(r.pcm) == want for r in found)
    assert flac.decode_media(flac.encode_documents(docs.limit(0))).count() == 0


def test_query(spark):
    from transcript_lake.llm.common import table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = flac.op2_flac(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        pad = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))


def test_blocks_are_the_stream_and_read_alone(spark):
    text = "lorem ipsum é " * 9000
    docs = spark.createDataFrame([(1, text, "x", 1), (2, None, "y", 2)], "doc_id long, text string, pcm string, sample long")
    decoded = flac.decode_media(flac.encode_documents(docs))
    whole = {r.doc_id: r for r in decoded.collect()}
    blocks = {}
    for r in flac.pcm_blocks(decoded).orderBy("doc_id", "sample").collect():
        blocks.setdefault(r.doc_id, []).append(r)
    assert len(blocks[1]) > 10 and len(blocks[2]) == 1
    for key, rows in blocks.items():
        assert b"".join(bytes(r.pcm) for r in rows) == bytes(whole[key].pcm)
        at = 0
        for r in rows:
            assert r.sample == at and flac.read_block(bytes(whole[key].media), r.sample, r.byte) == bytes(r.pcm)
            at += len(r.pcm)
    damaged = bytearray(whole[1].media)
    damaged[-40] ^= 1
    with pytest.raises(ValueError, match="block"):
        flac.read_block(bytes(damaged), blocks[1][-1].sample, blocks[1][-1].byte)
