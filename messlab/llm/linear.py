"""Hashed text features and sparse logistic regression, shared by the trained operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes looked at in one go; longer texts are cut between words, two words of each piece seen again.
PIECE = 1 << 20
IS_WORD = np.array([chr(b).isalnum() or b == 0x27 if b < 128 else True for b in range(256)])
ODD = np.uint64(0x9E3779B97F4A7C15)
SECOND, SKIPPED = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for k in range(1, n):
        out[k] = out[k - 1] * np.uint64(0x5851F42D4C957F2D)
    return out


with np.errstate(over="ignore"):
    POWERS = _powers(256)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


CODES = mix(np.arange(1, 257, dtype=np.uint64))


def pieces(texts: Iterable[str | None], lower: bool) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(row numbers, texts as bytes) of about ``PIECE`` bytes at most."""
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0
    for r, text in enumerate(texts):
        data = ((text or "").lower() if lower else text or "").encode()
        start = 0
        while start < len(data):
            stop = len(data)
            if stop - start > PIECE:
                stop = data.rfind(b" ", start, start + PIECE)
                stop = stop if stop > start else start + PIECE
            if held + stop - start > PIECE and parts:
                yield np.array(rows), parts
                rows, parts, held = [], [], 0
            rows.append(r)
            parts.append(data[start:stop])
            held += stop - start
            if stop < len(data):
                back = data.rfind(b" ", start, max(start, data.rfind(b" ", start, stop)))
                stop = back if back > start + PIECE // 2 else stop
            start = stop
    if parts:
        yield np.array(rows), parts


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the part, hash) of every word: letters, digits and apostrophes."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    word = IS_WORD[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    edges = np.concatenate([[0], edges]) if word[0] else edges
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    values = CODES[data[word]] * POWERS[within & 255]
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return np.searchsorted(begins, starts, "right") - 1, mix(np.add.reduceat(values, first))


def word_grams(parts: list[bytes], grams: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(part, hash) of single words, of neighbours and of words with one between them."""
    part, word = word_hashes(parts)
    if "word" in grams:
        yield part, mix(word)
    if "pair" in grams:
        near = part[:-1] == part[1:]
        yield part[1:][near], mix((word[:-1] * SECOND + word[1:])[near])
    if "skip" in grams:
        near = part[:-2] == part[2:]
        yield part[2:][near], mix((word[:-2] * SKIPPED + word[2:])[near])


def char_grams(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, hash) of all ``size`` neighbouring bytes of a part, as they are."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    lengths = np.array([len(p) for p in parts])
    n = max(0, len(data) - size + 1)
    packed = np.zeros(n, np.uint64)
    for k in range(size):
        packed = packed << np.uint64(8) | data[k:k + n]
    part = np.repeat(np.arange(len(parts)), lengths)
    inside = part[:n] == part[size - 1:size - 1 + n]
    return part[:n][inside], mix(packed[inside] * ODD)


def features(texts: Iterable[str | None], grams: tuple[str, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature number below 2^bits), repeats included.  ``grams``: word, pair, skip (lower case), char4 (as is)."""
    shift = np.uint64(64 - bits)
    if {"word", "pair", "skip"} & {*grams}:
        for rows, parts in pieces(texts, lower=True):
            for part, hashed in word_grams(parts, grams):
                yield rows[part], (hashed >> shift).astype(np.int64)
    if "char4" in grams:
        for rows, parts in pieces(texts, lower=False):
            part, hashed = char_grams(parts, 4)
            yield rows[part], (hashed >> shift).astype(np.int64)


@dataclass
class Model:
    """Sparse weights over hashed features: one set for each class, presence counts once."""

    grams: tuple[str, ...]
    bits: int
    bias: np.ndarray
    places: list[np.ndarray]
    values: list[np.ndarray]
    dense: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"dense": None}

    def margins(self, texts: list[str | None], group: int = 256) -> np.ndarray:
        """(rows, classes) sums of the weights of the features that a text has, plus bias; for some texts at a time."""
        if self.dense is None:
            self.dense = np.zeros((1 << self.bits, len(self.bias)), np.float32)
            for k, (at, w) in enumerate(zip(self.places, self.values)):
                self.dense[at, k] = w
            self.used = (self.dense != 0).any(1)
        own = [self._margins(texts[k:k + group]) for k in range(0, len(texts), group)]
        return np.concatenate([np.zeros((0, len(self.bias))), *own])

    def _margins(self, texts: list[str | None]) -> np.ndarray:
        met = [np.zeros(0, np.int64)]
        for rows, at in features(texts, self.grams, self.bits):
            some = np.flatnonzero(self.used[at])
            met.append(distinct(rows[some] << self.bits | at[some]))
        met = distinct(np.concatenate(met))
        rows, weights = met >> self.bits, self.dense[met & (1 << self.bits) - 1].astype(np.float64)
        return np.stack([np.bincount(rows, weights[:, k], len(texts)) + self.bias[k]
                         for k in range(len(self.bias))], 1)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def ftrl(examples: list[np.ndarray], truth: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float,
         rounds: int, positive: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal logistic regression: (bias, places, weights).  ``positive`` weighs the true examples.

    Each coordinate has its own learning rate, alpha / (beta + root of its summed
    squared gradients); coordinates whose sum stays within ``l1`` have weight 0.
    The last place of z and n is the bias, which is not shrunk.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.arange(len(examples))
    for turn in range(rounds):
        np.random.default_rng(turn).shuffle(order)
        for k in order.tolist():
            at = examples[k]
            own, seen = z[at], np.sqrt(n[at])
            w = np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + seen) / alpha + l2))
            b = -z[size] * alpha / (beta + math.sqrt(n[size]))
            gradient = 1 / (1 + math.exp(-max(-500.0, min(500.0, w.sum() + b)))) - truth[k]
            gradient *= positive if truth[k] else 1.0
            square = gradient * gradient
            z[at] = own + gradient - (np.sqrt(n[at] + square) - seen) / alpha * w
            n[at] += square
            z[size] += gradient - (math.sqrt(n[size] + square) - math.sqrt(n[size])) / alpha * b
            n[size] += square
    own, seen = z[:size], np.sqrt(n[:size])
    w = np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + seen) / alpha + l2))
    places = np.flatnonzero(w)
    return float(-z[size] * alpha / (beta + math.sqrt(n[size]))), places, w[places].astype(np.float32)


def examples_of(texts: list[str | None], grams: tuple[str, ...], bits: int, group: int = 256) -> list[np.ndarray]:
    """The distinct features of each text, found for some texts at a time."""
    examples: list[np.ndarray] = []
    for k in range(0, len(texts), group):
        own = texts[k:k + group]
        met = [np.zeros(0, np.int64)]
        met += [distinct(rows << bits | at) for rows, at in features(own, grams, bits)]
        met = distinct(np.concatenate(met))
        cuts = np.searchsorted(met >> bits, np.arange(1, len(own)))
        places = (met & (1 << bits) - 1).astype(np.int32)
        examples += [x.copy() for x in np.split(places, cuts)]
    return examples


def labelled(docs: DataFrame, labels: DataFrame, truth: Column, usable: Column, id: str, text: str,
             sample: int) -> DataFrame:
    """(id, text, truth) of about ``sample`` labelled documents at most, chosen by a hash of their id.

    ``truth`` is an expression over the labels, null where a row says nothing; of
    several rows of an id the mean counts, rounded up.  An id with several texts
    gives its least text.
    """
    said = labels.select(F.col(id).alias("id"), truth.alias("truth")).where("id is not null and truth is not null")
    said = said.groupBy("id").agg(F.floor(F.avg("truth") + 0.5).cast("int").alias("truth")).where(usable)
    share = min(1.0, sample / max(1, said.count()))
    chosen = said.where(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The chosen rows are bounded by ``sample``, so they are sent to the documents.
    return rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"),
                                                                 F.first("truth").alias("truth"))


def fit(rows: DataFrame, grams: tuple[str, ...], classes: int, bits: int = 20, alpha: float = 1.0, beta: float = 1.0,
        l1: float = 8.0, l2: float = 0.01, rounds: int = 4, positive: float = 1.0, holdout: int = 0) -> tuple[Model, np.ndarray, np.ndarray]:
    """A model per class against the rest, fitted in one task over the bounded sample (id, text, truth).

    With two classes only class 1 has a model.  Every ``holdout``-th row is left
    out and its margins and truths are returned for calibration.  What comes to
    the driver is bounded by the feature space and the sample.
    """
    wanted = [1] if classes == 2 else list(range(classes))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, truths = [], []
        for batch in batches:
            examples += examples_of(batch.column("text").to_pylist(), grams, bits)
            truths += batch.column("truth").to_pylist()
        truth = np.array(truths)
        apart = np.arange(len(truth)) % holdout == 0 if holdout else np.zeros(len(truth), bool)
        for k in wanted:
            kept = np.flatnonzero(~apart)
            bias, places, values = ftrl([examples[i] for i in kept], (truth[kept] == k).astype(float), bits, alpha, beta,
                                        l1, l2, rounds, positive)
            dense = np.zeros(1 << bits)
            dense[places] = values
            tests = np.flatnonzero(apart)
            kinds = np.concatenate([[0], np.full(len(places), 1), np.full(len(tests), 2)])
            at = np.concatenate([[0], places, truth[tests].astype(int)])
            value = np.concatenate([[bias], values, [dense[examples[i]].sum() + bias for i in tests]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), k)), pa.array(kinds), pa.array(at),
                                              pa.array(value.astype(float))], ["class", "kind", "at", "value"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    found = ordered.mapInArrow(train, "class long, kind long, at long, value double").toArrow()
    label, kind, at, value = (found.column(c).to_numpy() for c in ("class", "kind", "at", "value"))
    of = [label == k for k in wanted]
    bias = np.array([value[o & (kind == 0)].sum() for o in of])
    model = Model(grams, bits, bias, [at[o & (kind == 1)] for o in of],
                  [value[o & (kind == 1)].astype(np.float32) for o in of])
    tests = [o & (kind == 2) for o in of]
    return model, np.stack([value[t] for t in tests], 1), at[tests[0]]
