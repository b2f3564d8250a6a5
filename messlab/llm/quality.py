"""Operator 9, quality rules: counted base rules and a calibrated classifier.

Words are runs of characters other than U+0020 and U+0009 to U+000D.  A text
fails the base rules with fewer than 20 words, or when more than 30 % of its
words lie in eight-word windows that occur twice or more in it.  The others are
kept or not by a logistic regression over hashed words, word pairs and
four-byte character grams, trained on a bounded sample of rows labelled good or
bad.  A part of the sample is left out of training and calibrates the margin
(two-parameter logistic fit); the probability of a bad text is then compared
with a fixed threshold.

Null and empty texts have no words and fail.  A text that labels say nothing
about is scored like any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from messlab.llm.linear import Model, fit, labelled, sigmoid
from messlab.llm.storage import free

GRAMS = ("word", "pair", "char4")
#: Labelled documents that training sees at most; every so many of them calibrate; bad from this probability on.
SAMPLE, HOLDOUT, THRESHOLD = 10_000, 4, 0.8
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more.

    Hashes of the windows find texts without any repeat; the others are counted on the words themselves.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.array(list(map(hash, words)), np.int64).view(np.uint64)
    combined = np.zeros(n, np.uint64)
    for k in range(window):
        combined = combined * np.uint64(0x5851F42D4C957F2D) + codes[k:k + n]
    ordered = np.sort(combined)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(combined, twice)).tolist()
    seen = Counter(tuple(words[p:p + window]) for p in places)
    covered = np.zeros(len(words) + 1, np.int64)
    for p in places:
        if seen[tuple(words[p:p + window])] > 1:
            covered[p] += 1
            covered[p + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The base counts of one whole text."""
    text = text or ""
    words = text.encode().split()  # splits at 0x20 and 0x09 to 0x0D
    spaces = sum(map(text.count, SPACES))
    lines = [line for line in text.split("\n") if line.strip(SPACES)] if "\n" in text else []
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))


def calibrate(margin: np.ndarray, truth: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic fit by Newton steps, with smoothed targets."""
    good, bad = (truth == 0).sum(), (truth == 1).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(truth == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ at)
        slope = x.T @ (p - target) + 1e-3 * (at - [1.0, 0.0])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), slope)
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> tuple[Model, tuple[float, float]]:
    """The model of bad texts (label 0) and its calibration."""
    rows = labelled(docs, labels, 1 - F.col(label), F.lit(True), id, text, sample)
    model, margins, truth = fit(rows, GRAMS, 2, holdout=HOLDOUT)
    return model, calibrate(margins[:, 0], truth)


def verdict(model: Model, calibration: tuple[float, float], threshold: float = THRESHOLD):
    """A column function: text to its counts, base_failed, the probability of a bad text, and kept."""
    kind = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, p_bad double, kept boolean"

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            out = pd.DataFrame([counts(t) for t in texts], columns=COUNTS, dtype="int64")
            out["base_failed"] = (out.n_words < LEAST_WORDS) | (100 * out.n_repeat_words > MOST_REPEATED * out.n_words)
            slope, offset = calibration
            out["p_bad"] = sigmoid(slope * model.margins(texts)[:, 0] + offset)
            out["kept"] = ~out.base_failed & (out.p_bad < threshold)
            yield out
    return judge.asNondeterministic()


def judged(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, the counts, base_failed, p_bad and kept."""
    found = verdict(*train(docs, labels, id=id, text=text))
    return docs.select(F.col(id).alias(id), found(F.col(text)).alias("_verdict")).select(id, "_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents kept, all their columns."""
    found: Column = verdict(*train(docs, labels, id=id, text=text))(F.col(text))
    own = free(docs, "_verdict")
    return docs.withColumn(own, found).where(F.col(f"{own}.kept")).drop(own)
