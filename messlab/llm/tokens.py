"""Operator 6, token counts: a Viterbi search that carries only score and piece count.

A text is cut before every space (U+0020), each part is led by U+2581, and every
part is segmented alone into the vocabulary pieces of highest total score.  An
Aho-Corasick automaton lists the pieces that end at each character, longest
first.  Of equal totals the piece that starts first stays, as in the tokenizers
library: a later candidate must be strictly better.  A character without a piece
of its own costs the lowest score less 10; it counts one piece, with neighbours
of its kind together, or one piece per byte under byte fallback.  Sums are
double precision, added from left to right.

Nulls and empty texts have 0 pieces.  Rows are treated alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import functions as F

#: Distinct parts that a worker remembers, and the longest of them.
KEPT, KEPT_LENGTH = 500_000, 64
SPACE = "▁"
UNKNOWN_PENALTY = 10.0

Vocabulary = tuple[tuple[str, float], ...]


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model, control and unknown pieces left out.

    Read on the driver; bounded by the vocabulary.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
                 if not model.is_control(i) and not model.is_unknown(i))


class Counter(dict):
    """Part of a text -> number of pieces; parts not met yet are searched."""

    def __init__(self, vocabulary: Vocabulary, byte_fallback: bool):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def __missing__(self, part: str) -> int:
        count = self.search(part)
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[part] = count
        return count

    def search(self, part: str) -> int:
        """Pieces on the best path.  Three lists as long as the part; no path is kept."""
        n = len(part)
        score, count, known = [0.0] * (n + 1), [0] * (n + 1), [True] * (n + 1)
        matches, waiting = self.automaton.iter(part) if n else iter(()), None
        waiting = next(matches, None)
        for end in range(1, n + 1):
            best, start, single = None, end - 1, False
            while waiting is not None and waiting[0] == end - 1:
                length, own = waiting[1]
                total = own + score[end - length]
                if best is None or total > best:
                    best, start = total, end - length
                single = single or length == 1
                waiting = next(matches, None)
            if not single and (best is None or self.unknown + score[end - 1] > best):
                score[end], known[end] = self.unknown + score[end - 1], False
                if self.byte_fallback:
                    count[end] = count[end - 1] + len(part[end - 1].encode())
                else:
                    count[end] = count[end - 1] + (end == 1 or known[end - 1])
            else:
                score[end], count[end] = best, count[start] + 1
        return count[n]

    def total(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        if not parts[0]:
            del parts[0]
        return sum(map(self.__getitem__, [SPACE + p for p in parts]))


@functools.lru_cache(maxsize=2)
def counter(vocabulary: Vocabulary, byte_fallback: bool) -> Counter:
    return Counter(vocabulary, byte_fallback)


def token_counter(vocabulary: Vocabulary, byte_fallback: bool = True):
    """A column function: text to its number of pieces."""
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary, byte_fallback)
        for texts in batches:
            yield pd.Series([own.total(t or "") for t in texts], dtype="int64")
    return count
