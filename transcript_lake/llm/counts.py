"""Token counts by a count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.binary import slices
from transcript_lake.llm.common import table
from transcript_lake.llm.tokens import CACHE_WORDS, vocabulary

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"

#: What an unknown character scores below the vocabulary's least score; the tokenizer's own constant.
UNKNOWN_PENALTY = 10.0


class Counter:
    """Best score and piece count of words under a unigram vocabulary with byte fallback.

    An Aho-Corasick automaton lists the vocabulary's pieces that end at each character, longest first. A piece replaces
    the best so far only if it scores more, so of equal paths the one whose last piece starts first stays, as in the
    tokenizer. A character that no piece of its own covers may stand as unknown, at the least score less the penalty,
    and counts as its UTF-8 bytes. Only score and count are carried, no back pointers."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]
        self.unknown = min(score for _, score in self.pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.kept: dict[str, tuple[float, int]] = {}

    def word(self, word: str) -> tuple[float, int]:
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, piece in self.automaton.iter(word):
            ends[end].append(piece)
        best, count = [0.0], [0]
        for end, here in enumerate(ends):
            top = n = None
            single = False
            for length, score in here:
                single |= length == 1
                score += best[end + 1 - length]
                if top is None or score > top:
                    top, n = score, count[end + 1 - length] + 1
            if not single and (top is None or best[end] + self.unknown > top):
                top, n = best[end] + self.unknown, count[end] + len(word[end].encode())
            best.append(top)
            count.append(n)
        return best[-1], count[-1]

    def text(self, text: str) -> tuple[float, int]:
        """Blanks become marks, one is put in front where none stands, and each mark starts a word."""
        if not text:
            return 0.0, 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        out = list(map(self.kept.get, words))
        if None in out:
            new = {w: self.word(MARK + w) for w in {w for w, x in zip(words, out, strict=True) if x is None}}
            out = [x or new[w] for w, x in zip(words, out, strict=True)]
            if (room := CACHE_WORDS - len(self.kept)) > 0:
                self.kept.update(islice(new.items(), room))
        scores, counts = zip(*out, strict=True)
        return float(sum(scores)), sum(counts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_tokens and score of its best segmentation.

    Null or empty text: no tokens, score 0. Each row on its own, so repeated rows repeat. No rows: no rows. Other columns are ignored."""
    path = path or vocabulary(VOCABULARY)

    def count(batches):
        model = counter(path)
        for batch, texts in slices(batches, 1):
            found = [model.text(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(count, "doc_id long, n_tokens long, score double")


def op7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
