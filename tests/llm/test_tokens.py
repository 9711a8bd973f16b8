"""Packed files, packing and token counts against the tokenizers library and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from transcript_lake.llm import binary, counts, packing
from transcript_lake.llm.tokens import word_tokenizer

ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\nb  ", "x   y", "a\x1c b \x1c", "don't  it's 'll", " \n", "a \x00 b", "<|endoftext|> a<|endoftext|>b", "日本 語 テ", "a\t b\tc", "x\x85 y", "é 𝒳e", "\n", "a\nb\n", "word " * 3000]
ROWS = [(i, x, f"s{i % 3}") for i, x in enumerate(ODD)] + [(100, None, None), (None, "no id here", "s1"), (5, "a\n\nb  ", "s2"), (5, "a\n\nb  ", "s2")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, length string")


def expected(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_pieces_encode_as_the_whole(tokenizer):
    own = word_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        ids, starts = own.encode(ODD, 0)
        for x, lo, hi in zip(ODD, starts[:-1], starts[1:], strict=True):
            assert ids[lo:hi].tobytes() == expected(tokenizer, x), x


@given(st.lists(st.text(st.sampled_from("ab0Zé .,!'#\n\t\u00a0\u2028\x1c\x85日\u0301_\x00"), max_size=30), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_any_text_encodes_as_the_whole(texts):
    own = word_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids, starts = own.encode(texts)
    for x, lo, hi in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[lo:hi].tolist() == own.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 24, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = binary.pack(ids, bits)
    assert len(data) == -(-1003 // 8) * bits
    assert (binary.unpack(data, 1003, bits) == ids).all()
    assert (binary.unpack(data, 5, bits, 777) == ids[777:782]).all()


def test_files(spark, docs, tokenizer):
    got = sorted(map(tuple, binary.read_tokens(binary.write_tokens(docs)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert [x[1] for x in got] == sorted((r[0] for r in ROWS), key=lambda k: -1 if k is None else k)
    at = 0
    for start, key, n, crc in got:
        raw = next(expected(tokenizer, r[1]) for r in ROWS if r[0] == key)
        assert (start, n, crc) == (at, len(raw) // 4, zlib.crc32(raw))
        at += n
    assert binary.read_tokens(binary.write_tokens(docs.limit(0))).count() == 0


def test_packing(spark, docs, tokenizer):
    got = packing.pack_documents(docs).collect()
    whole, held = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        held[r.sequence_id].append((r.offset, r.length))
    for key, text, _ in ROWS:
        raw = expected(tokenizer, text)
        want = [(lo // 4, len(raw[lo : lo + 4096]) // 4, zlib.crc32(raw[lo : lo + 4096]), len(raw) // 4) for lo in range(0, len(raw), 4096)]
        assert sorted(set(whole[key])) == want
    assert len(whole[5]) == 3  # the odd text and two rows that repeat it
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_patterns_hold_each_item_once_with_little_waste():
    rng = np.random.default_rng(3)
    demand = np.zeros(65, np.int64)
    np.add.at(demand, rng.integers(1, 65, 5000), 1)
    found = packing.patterns(demand)
    assert (sum(times * pattern for pattern, times in found) == demand).all()
    assert all(pattern @ np.arange(65) <= 64 for pattern, _ in found)
    assert sum(times for _, times in found) <= np.ceil(demand @ np.arange(65) / 64) * 1.02 + 1


def test_relaxation_reaches_the_bound():
    # 10 items of 3 and 10 of 2 in bins of 5: ten bins, one of each
    demand = np.zeros(6, np.int64)
    demand[[2, 3]] = 10
    assert sum(use for _, use in packing.relax(demand, 0)) == pytest.approx(10)


def test_counts_follow_the_tokenizer(spark, docs):
    model = counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(Unigram(model.pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = np.random.default_rng(1)
    more = ["".join(rng.choice(list("abcdeiou strn▁é日\U0001d4b3"), 60)) for _ in range(300)]
    for x in ODD[1:] + more:
        assert model.text(x)[1] == len(t.encode(x, add_special_tokens=False).ids), x
    got = counts.count_tokens(docs)
    assert got.count() == len(ROWS) and got.where("doc_id = 100").first().n_tokens == 0
