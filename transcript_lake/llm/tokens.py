"""Token ids by a public tokenizer, fast on text in which words repeat."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of which a Python worker keeps the ids.
CACHE_WORDS = 500_000

#: White space, as any of the libraries understands it, beside a blank or newline: cutting there could split one run.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
RUN = rf"{SPACE}[ \n]|\n{SPACE}|\x00"
CUT = re.compile(r"(?<=\S)(?=[ \n])")

#: Between a letter or digit and a sign (not an apostrophe, which begins an ending) a new token always begins.
SIGN = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([!-&(-/:-@\\[-`{-~])"


class WordTokenizer:
    """Encodes a text as the tokenizers library does on the whole, from the ids of its pieces.

    The tokenizer's own splitting never joins a non-blank character with white space after it, nor a letter or digit
    with a sign after it, so pieces cut between the two have the ids that they have within the text. Texts with white
    space side by side or with special tokens are cut with more care. The library encodes each distinct piece of a batch; up to CACHE_WORDS
    are kept, those met first, among which are the frequent ones."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.newline = self.tokenizer.token_to_id("\u010a")
        self.kept: dict[str, bytes] = {"": b""}
        special = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.careful = "|".join([RUN, *special])

    def encoded(self, new: list[str]) -> dict[str, bytes]:
        """The ids of each piece. Pieces without newlines are encoded many at a time, with a newline between, which is a token of its own there."""
        found = {}
        plain = [x for x in new if "\n" not in x]
        for lo in range(0, len(plain), 2048):
            part = plain[lo : lo + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            if len(ends) == len(part):
                raw, at = ids.tobytes(), 0
                for piece, end in zip(part, ends.tolist(), strict=True):
                    found[piece] = raw[4 * at : 4 * end]
                    at = end + 1
        rest = [x for x in new if x not in found]
        if rest:
            found |= {x: np.array(e.ids, "<u4").tobytes() for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        return found

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Each text's pieces."""
        runs = pc.match_substring_regex(texts, self.careful)
        plain = pc.replace_substring_regex(pc.if_else(runs, "", texts), SIGN, "\\1\0\\2")
        plain = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
        out = pc.split_pattern(plain, "\0")
        if not pc.any(runs).as_py():
            return out
        careful = iter([CUT.split(x) for x in texts.filter(runs).to_pylist()])
        return pa.array([next(careful) if run else x for run, x in zip(runs.to_pylist(), out.to_pylist(), strict=True)], out.type)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, with end after each if it is given, and where each text's ids begin (and the last's end)."""
        lists = self.cut(pa.array(texts, pa.large_string()))
        codes = lists.flatten().dictionary_encode()
        words = codes.dictionary.to_pylist()
        found = list(map(self.kept.get, words))
        if None in found:
            new = self.encoded([w for w, x in zip(words, found, strict=True) if x is None])
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if (room := CACHE_WORDS - len(self.kept)) > 0:
                self.kept.update(islice(new.items(), room))
        flat, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = codes.indices.to_numpy()
        lengths = sizes[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        starts = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], lengths)]
        if end is None:
            return ids, starts
        out = np.full(len(ids) + len(texts), end, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(starts))] = ids
        return out, starts + np.arange(len(texts) + 1)


def vocabulary(name: str) -> str:
    """The path of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
