"""Operator 7, byte-level BPE: a sentencepiece model written straight from a rank file.

Each byte becomes one printable character, each vocabulary entry one piece whose
score is its negative rank, so that the library's "best score first, leftmost
first" merging is the merging by lowest rank.  The normaliser is the identity.
Texts are cut into pre-tokens by a pattern; every pre-token is encoded alone.
Decoding maps ids back to the characters and those back to bytes.

Nulls count as empty texts; an empty text has no ids.  Whole texts are encoded,
whatever their length.  Every row is treated alone, so repeated rows, ties and
empty tables need no rule.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column, functions as F

#: Distinct pre-tokens that a worker keeps the ids of, and the longest of them; others are encoded anew.
KEPT, KEPT_LENGTH = 250_000, 64

NORMAL, UNKNOWN, BPE = 1, 2, 2


def byte_characters() -> list[str]:
    """The character of each byte: visible Latin-1 bytes stand for themselves, others follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and rank.  Read on the driver; bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i is the token of rank i; the unknown piece follows the last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1, each once")
    characters, unknown = byte_characters(), "⁇"

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("".join(characters[b] for b in token), -rank, NORMAL)
              for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(piece(unknown, -len(ranks), UNKNOWN))
    # Trainer: model type, size, places of the special pieces (-1 as ten bytes: none), name of the unknown piece.
    none = (1 << 64) - 1
    trainer = (_number(3, BPE) + _number(4, len(pieces)) + _number(40, len(ranks)) + _number(41, none)
               + _number(42, none) + _number(43, none) + _block(45, unknown.encode()))
    # Normaliser: its name, no dummy prefix, white space neither removed nor escaped.
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encodes and decodes with one serialised model and one pre-token pattern."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        characters = byte_characters()
        self.to_characters = dict(enumerate(characters))
        back = {c: b for b, c in enumerate(characters)}
        last = self.processor.get_piece_size() - 1
        self.token_bytes = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(last)]
        self.whole = {token: [i] for i, token in enumerate(self.token_bytes)}
        self.kept: dict[str, list[int]] = {}

    def _encode_new(self, pretokens: Iterable[str]) -> dict[str, list[int]]:
        """Ids of pre-tokens; one that is a vocabulary entry is that entry."""
        found, rest = {}, []
        for x in pretokens:
            ids = self.whole.get(x.encode())
            if ids is None:
                rest.append(x)
            else:
                found[x] = ids
        mapped = [x.encode().decode("latin-1").translate(self.to_characters) for x in rest]
        found.update(zip(rest, self.processor.encode(mapped, num_threads=1) if mapped else []))
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        pretokens = self.split(text)
        kept = self.kept
        new = {x for x in pretokens if x not in kept}
        if new:
            if len(kept) + len(new) > KEPT:
                kept.clear()
                new = set(pretokens)
            found = self._encode_new(new)
            long = {x: ids for x, ids in found.items() if len(x) > KEPT_LENGTH}
            kept.update((x, ids) for x, ids in found.items() if x not in long)
            if long:
                return [i for x in pretokens for i in (long.get(x) or kept[x])]
        return [i for x in pretokens for i in kept[x]]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.token_bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encoder(model: bytes, pattern: str):
    """A column function: text to an array of ids."""
    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model, pattern)
        for texts in batches:
            yield pd.Series([own.encode(t or "") for t in texts], dtype=object)
    return encode


def decoder(model: bytes, pattern: str):
    """A column function: array of ids to bytes.  A null array gives no bytes."""
    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model, pattern)
        for rows in batches:
            yield pd.Series([own.decode([] if ids is None else ids) for ids in rows], dtype=object)
    return decode


def round_trip(model: bytes, pattern: str):
    """A column function: text to (n_tokens, ids_sha256, decoded_sha256), encoded and decoded in one pass."""
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(model, pattern)
        decimal = [str(i) for i in range(len(own.token_bytes))]
        try:
            for texts in batches:
                rows = []
                for text in texts:
                    ids = own.encode(text or "")
                    rows.append((len(ids),
                                 hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                                 hashlib.sha256(own.decode(ids)).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:  # the worker lives on; a later stage needs the memory
            own.kept.clear()
    return digest.asNondeterministic()


def digests(text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """The struct of :func:`round_trip` for a text column."""
    return round_trip(serialise(ranks), pattern)(text)
